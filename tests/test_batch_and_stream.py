import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import batch, cross_rules
from ledgerloom.operators.incremental import RuleBook
from ledgerloom.schemas import TABLE
from ledgerloom.sources import files
from ledgerloom.sources.record_store import RecordStore
from ledgerloom.streaming import dropzone, keyed


def handle(path, content):
    text = content.decode()
    if text.startswith("poison"):
        raise ValueError("poisoned")
    if text.startswith("slow"):
        time.sleep(30)
    if text.startswith("kind"):
        return {"distributions": "not a number"}
    ein, tin, year, amount = text.split()
    return {"partnership_ein": ein, "partner_tin": tin, "tax_year": year if year != "-" else None, "run_id": path.rsplit("/", 1)[-1], "ingested_at": "2025", "distributions": float(amount), "partner_share_percentage": 60.0}


def dropped(spark, folder, contents):
    folder.mkdir()
    for name, text in contents.items():
        (folder / name).write_text(text)
    return spark.read.format("binaryFile").load(str(folder)).repartition(4)


def test_one_poisoned_file_in_a_hundred(spark, tmp_path):
    contents = {f"{i:03d}.pdf": f"e{i % 7} t{i} 2024 {i}" for i in range(99)} | {"099.pdf": "poison"}
    records = RecordStore(spark, f"file://{tmp_path}/records")
    book = RuleBook(spark, f"file://{tmp_path}/rules", records)
    found = batch.run_batch(dropped(spark, tmp_path / "drop", contents), handle, records, book, f"{tmp_path}/dead")
    assert records.read().count() == 99 and found.rules_error is None
    dead = spark.read.json(f"{tmp_path}/dead").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.attempts) for r in dead] == [("099.pdf", 2)] and "ValueError: poisoned (handle" in dead[0].error
    total = found.summary.first()
    assert (total.runs, total.successes, total.failures) == (100, 99, 1) and total.seconds_a_document >= 0
    assert {r.attempts for r in found.files.where("succeeded").collect()} == {1}
    assert book.results().where("rule_id = 'A1'").count() == 7 == cross_rules.all_rules(records.read()).where("rule_id = 'A1'").count()


def test_failures_of_every_kind_and_retries(spark, tmp_path):
    contents = {"a.pdf": "slow", "b.pdf": "kind", "c.pdf": "e t - 1", "d.pdf": "e t 2024 5", "e.pdf": "one word", "f.pdf": "\x00"}
    records = RecordStore(spark, f"file://{tmp_path}/records")
    found = batch.run_batch(dropped(spark, tmp_path / "drop", contents), handle, records, None, f"{tmp_path}/dead", limit=1, attempts=1)
    errors = {r.path.rsplit("/", 1)[-1]: r.error for r in found.files.collect()}
    assert errors["a.pdf"].startswith("OverTime: more than 1 seconds") and errors["c.pdf"] == "missing tax_year" and errors["d.pdf"] is None
    assert all(errors[k] for k in ("b.pdf", "e.pdf", "f.pdf")) and [r.distributions for r in records.read().collect()] == [5.0]

    marks = tmp_path / "marks"
    marks.mkdir()

    def second_time(path, content):  # fails until it was tried once
        mark = marks / path.rsplit("/", 1)[-1]
        if content == b"flaky" and not mark.exists():
            mark.write_text("")
            raise OSError("not yet")
        return {"run_id": "r"}

    again = batch.run_files(dropped(spark, tmp_path / "more", {"x.pdf": "flaky", "y.pdf": "fine"}), second_time, TABLE, attempts=3)
    assert {(r.path.rsplit("/", 1)[-1], r.error, r.attempts) for r in again.collect()} == {("x.pdf", None, 2), ("y.pdf", None, 1)}
    assert batch.run_files(again.sparkSession.createDataFrame([], "path string, content binary"), handle, TABLE).count() == 0


def test_a_failing_rule_step_is_reported(spark, tmp_path, monkeypatch):
    records = RecordStore(spark, f"file://{tmp_path}/records")
    book = RuleBook(spark, f"file://{tmp_path}/rules", records)
    monkeypatch.setattr(book, "apply", lambda change: (_ for _ in ()).throw(RuntimeError("no rules today")))
    found = batch.run_batch(dropped(spark, tmp_path / "drop", {"a.pdf": "e t 2024 5"}), handle, records, book)
    assert found.rules_error == "RuntimeError: no rules today" and records.read().count() == 1


def record_rows(spark, rows):
    df = spark.createDataFrame(rows, "partnership_ein string, partner_tin string, tax_year string, run_id string, ingested_at string, distributions double")
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields))


BATCHES = [
    [("e", "t", "2024", "r2", "2025-02", 2.0), ("e", "u", "2024", "r1", "2025-01", 1.0), ("e", "u", "2024", "r3", "2025-01", 3.0), (None, "u", "2024", "r9", "2025-01", 9.0)],
    [("e", "t", "2024", "r1", "2025-01", 1.0), ("f", "t", "2024", "r4", "2025-03", 4.0), ("e", "u", "2024", "r3", "2025-01", 3.0)],
    [("e", "t", "2024", "r5", "2025-02", 5.0)],
]


@pytest.mark.parametrize("restarts", [False, True])
def test_newest_record_of_a_key_whatever_the_order(spark, tmp_path, restarts):
    source = tmp_path / "in"
    store = RecordStore(spark, f"file://{tmp_path}/records")
    seen = []

    def go():
        stream = spark.readStream.schema(TABLE.simpleString()[7:-1].replace(":", " ")).option("maxFilesPerTrigger", "1").parquet(str(source))
        keyed.store_stream(stream, store, f"{tmp_path}/check", after=lambda s: seen.append(s.version()), once=True).awaitTermination()

    for n, rows in enumerate(BATCHES):
        record_rows(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/new{n}")
        source.mkdir(exist_ok=True)
        part = next((tmp_path / f"new{n}").glob("part-*"))
        part.rename(source / f"{n}.parquet")
        if restarts:  # a query of its own for every batch: state comes from the checkpoint
            go()
    if not restarts:
        go()
    found = sorted((r.partnership_ein, r.partner_tin, r.run_id, r.distributions) for r in store.read().collect())
    assert found == [("e", "t", "r5", 5.0), ("e", "u", "r3", 3.0), ("f", "t", "r4", 4.0)] and seen == sorted(seen) and len(seen) >= 3


def runs_of(spark, tmp_path, batches, wait, pause=0.0):
    """What ``assembled`` tells over batches, each read by a query of its own."""
    source, out = tmp_path / "parts", []
    source.mkdir()
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("".join(json.dumps(dict(zip(("run_id", "part", "payload"), r))) + "\n" for r in rows))
        stream = spark.readStream.schema("run_id string, part string, payload string").json(str(source))
        found = keyed.assembled(stream, ["ingested", "extracted"], wait_seconds=wait)
        query = found.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60  # a query with timers goes on by itself
        while sum(p.numInputRows for p in query.recentProgress) < len(rows) and time.time() < until and query.isActive:
            time.sleep(0.2)
        time.sleep(pause)
        query.stop()
    return [(r.run_id, r.status, json.loads(r.parts)) for r in out]


def test_parts_of_a_run_meet_over_batches(spark, tmp_path):
    batches = [
        [("r1", "ingested", "i"), ("r2", "ingested", "i"), ("r3", "ingested", "i"), (None, "ingested", "x")],
        [("r1", "extracted", "x"), ("r1", "ingested", "again"), ("r2", "notes", None)],
        [("r1", "extracted", "repeat"), ("r2", "extracted", "x")],
    ]
    told = runs_of(spark, tmp_path, batches, 3600)
    assert told == [("r1", "complete", {"ingested": "again", "extracted": "x"}), ("r2", "complete", {"ingested": "i", "notes": "", "extracted": "x"})]


def test_a_run_that_stays_incomplete_and_its_late_part(spark, tmp_path):
    batches = [[("r3", "ingested", "i")], [("other", "ingested", "o")], [("r3", "extracted", "late one")]]
    told = runs_of(spark, tmp_path, batches, 1, pause=2)
    assert [x for x in told if x[0] == "r3"] == [("r3", "incomplete", {"ingested": "i"}), ("r3", "late", {"extracted": "late one"})]


def test_archive_and_hook_of_the_drop_zone(spark, tmp_path):
    drop, archive = tmp_path / "drop", tmp_path / "archive"
    drop.mkdir()
    store = RecordStore(spark, f"file://{tmp_path}/records")
    counts = []

    def to_records(rows):
        parts = F.split(F.decode("content", "UTF-8"), " ")
        named = rows.select(parts[0].alias("partnership_ein"), parts[1].alias("partner_tin"), parts[2].alias("tax_year"), F.col("path").alias("run_id"), F.lit("2025").alias("ingested_at"))
        every = named.select(*(F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields))
        return every.withColumn("error", F.when(F.col("tax_year").isNull(), "no year"))

    for n in range(3):
        (drop / f"{n}.pdf").write_text(f"e t{n} 2024")
        dropzone.start(spark, str(drop), store, to_records, f"{tmp_path}/check", f"{tmp_path}/dead", archive=str(archive), once=True, after=lambda t: counts.append(t.count())).awaitTermination()
    assert counts == [1, 2, 3] and store.read().count() == 3
    assert [p.name for p in archive.rglob("*.pdf")] and files.list_files(spark, str(drop), "*.pdf").count() < 3
