import os
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .test_selection import brute_measures, junk  # noqa: E402
from .test_similarity import brute  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}," for i in range(400)]
    rows = []
    for i in range(120):
        text = junk(rng) if i % 4 == 0 else " ".join(rng.choices(words, k=rng.randint(30, 140)))
        rows.append((i, text))
    rows += [(200 + i, rows[i * 4 + 1][1]) for i in range(10)] + [(300, None), (301, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    first = pipeline.STAGES[0][1](spark, docs, sf)
    expected = {i for i, t in rows if i % 4 and brute_measures(t)[0] >= 50} | {200 + i for i in range(10) if brute_measures(rows[i * 4 + 1][1])[0] >= 50}
    expected = {i for i in expected if brute_measures(dict(rows)[i])[2] == 0}
    assert {r.doc_id for r in first.collect()} == expected and first.columns == names
    second = pipeline.STAGES[1][1](spark, first, sf)
    good = {r.doc_id for r in second.collect()}
    assert second.columns == names and len(good) >= 0.8 * len(expected)
    third = pipeline.STAGES[2][1](spark, second, sf)
    unique = {c for _, c in brute([(i, t) for i, t in rows if i in good], 90).values()}
    assert third.columns == names and {r.doc_id for r in third.collect()} == unique
    packed = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == unique


def brute_five_words(rows):
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    first = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 10 * both >= 8 * len(sets[i] | sets[j]):
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = {k: new if v == old else v for k, v in first.items()}
    return set(first.values())


def test_near_copies_at_five_words(spark):
    rng = random.Random(21)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows.append((10 * i, " ".join(words)))
        for c in range(1, 5):  # c words changed far apart: Jaccard falls from 0.90 over 0.81 to below 0.8
            words[20 * c] = f"changed{i}x{c}"
            rows.append((10 * i + c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert kept == brute_five_words(rows) == {10 * i for i in range(40)}  # linked step by step
    apart = [(d, t) for d, t in rows if d % 10 in (0, 2)]  # 5 words: 86 of 106, 3 words: 92 of 104, below 0.9
    docs = spark.createDataFrame(apart, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.STAGES[2][1](spark, docs, "").collect()} == brute_five_words(apart) == {10 * i for i in range(40)}
    far = [(d, t) for d, t in rows if d % 10 in (0, 4)]  # 5 words: below 0.8
    docs = spark.createDataFrame(far, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.STAGES[2][1](spark, docs, "").collect()} == brute_five_words(far) == {d for d, _ in far}


def test_batches_are_bounded_by_bytes_unless_the_session_says_otherwise(spark):
    from ledgerloom.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(300, numPartitions=1).selectExpr("id as doc_id", "repeat('long text ', 10000) as text")
    try:
        spark.conf.unset(key)
        common.bound_batches(spark)
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 300 and max(found) <= common.BATCH_BYTES // 100_000 + 1
        spark.conf.set(key, "1g")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "1g"
        assert [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()] == [300]
    finally:
        spark.conf.unset(key)


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in (1, 2)] + [(3, " ".join(f"w1x{j}" for j in range(60)))], "doc_id long, text string")
print("ids", sorted({r.doc_id for r in dict(corpus_pipeline.STAGES)[sys.argv[3]](spark, docs, "").collect()}))
"""


@pytest.mark.parametrize("stage, ids", [("near_duplicates", [1, 2]), ("sequences", [1, 2, 3])])
def test_a_stage_may_be_the_first_that_a_session_runs(tmp_path, stage, ids):
    """Workers that cannot import the package from where they are get it from the stage itself."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    root = str(Path(pipeline.__file__).resolve().parent)
    (tmp_path / "elsewhere").mkdir()
    ran = subprocess.run([sys.executable, "-c", ALONE, root, str(tmp_path), stage], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert f"ids {ids}" in ran.stdout, ran.stderr[-2000:]
