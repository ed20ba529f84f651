from pyspark.sql import functions as F

from ledgerloom.sources import files
from ledgerloom.sources.objects import run_key, write_objects


def test_objects_are_written_under_their_keys(spark, tmp_path):
    rows = [("staging/r1/ocr_text.json", '{"a": 1}'), ("staging/r1/é.txt", "é"), ("a", ""), ("../x", "out"), ("", "x"), (None, "x"), ("b/c", None), ("d//e", "x"), ("twice", "a"), ("twice", "b")]
    df = spark.createDataFrame(rows, "key string, content string").repartition(3)
    told = {r.key: (r.size, r.error) for r in write_objects(df, f"file://{tmp_path}/bucket").collect()}
    assert told["staging/r1/ocr_text.json"] == (8, None) and told["staging/r1/é.txt"] == (2, None) and told["a"] == (0, None) and told["twice"] == (1, None)
    assert {k for k, (_, e) in told.items() if e} == {"../x", "", None, "b/c", "d//e"}
    assert (tmp_path / "bucket/twice").read_text() == "b" and not (tmp_path / "x").exists()
    assert not [p for p in (tmp_path / "bucket").rglob(".*") if not p.name.endswith(".crc")]
    assert files.read_object(spark, f"{tmp_path}/bucket/staging/r1/ocr_text.json", "json").first().a == 1
    data = spark.createDataFrame([("staging/r1/ocr_text.json", bytearray(b"\x00\xff"))], "key string, content binary")
    assert write_objects(data, f"file://{tmp_path}/bucket").first().size == 2  # replaces
    assert files.read_object(spark, f"{tmp_path}/bucket/staging/r1/ocr_text.json", "bytes").first().content == b"\x00\xff"


def test_keys_of_runs(spark):
    df = spark.createDataFrame([("r1", "ocr_text.json"), ("r 2", "x.PDF"), ("", "x"), (None, "x"), ("a/b", "x"), ("r", ".."), ("r", None)], "run string, name string")
    assert [r[0] for r in df.select(run_key("staging", "run", F.col("name"))).collect()] == ["staging/r1/ocr_text.json", "staging/r 2/x.PDF", None, None, None, None, None]
