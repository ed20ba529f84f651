import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.schemas import KEY, TABLE
from ledgerloom.sources import record_store
from ledgerloom.sources.record_store import Connector, Folder, Manifest, RecordStore

COLUMNS = "partnership_ein string, partner_tin string, tax_year string, run_id string, ingested_at string, distributions double"


def rows(spark, found):
    df = spark.createDataFrame(found, COLUMNS)
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields))


def kept(df):
    return sorted((r.partnership_ein, r.partner_tin, r.tax_year, r.distributions) for r in df.collect())


def files_of(store):
    return {f["path"]: (f["bucket"], f["part"]) for f in store.folder.manifest().files}


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, f"file://{tmp_path}/records", leaf_bytes=6000)


def many(n, eins=20, hot=0, run="a", value=1.0):
    return [(f"{0 if i < hot else i % eins:02d}", f"t{i}", str(2020 + i % 4), run, "2025", value * i) for i in range(n)]


def test_round_trip_and_filters(spark, store):
    store.upsert(rows(spark, many(400)))
    assert kept(store.read()) == sorted((e, t, y, d) for e, t, y, _, _, d in many(400))
    everything = len(store.folder.manifest().files)
    assert everything > 3

    for test, pick in [
        ("partnership_ein = '03'", lambda r: r[0] == "03"), ("tax_year = '2021'", lambda r: r[2] == "2021"), ("tax_year IN ('2021', '1900') AND partnership_ein IN ('05', '01')", lambda r: r[2] == "2021" and r[0] in ("05", "01")),
        ("partnership_ein = '03' AND partner_tin = 't3'", lambda r: r[:2] == ("03", "t3")), ("tax_year = '1999'", lambda r: False), ("distributions > 100", lambda r: r[5] > 100), ("tax_year <=> '2020' AND distributions < 50", lambda r: r[2] == "2020" and r[5] < 50),
    ]:
        assert kept(store.read().where(test)) == sorted((r[0], r[1], r[2], r[5]) for r in many(400) if pick(r))
    reader = record_store.RecordReader(store.options)
    assert list(reader.pushFilters([record_store.EqualTo(("partnership_ein",), "03"), record_store.EqualTo(("distributions",), 1.0)])) == [record_store.EqualTo(("distributions",), 1.0)]
    assert 0 < len(reader.files()) < everything and {f["bucket"] for f in reader.files()} == {reader.files()[0]["bucket"]}
    plan = store.read().where("tax_year = '2021'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "+- Filter" not in plan


def test_upsert_touches_only_the_leaves_of_its_keys(spark, store):
    store.upsert(rows(spark, many(400)))
    before = files_of(store)
    change = store.upsert(rows(spark, [("03", "t3", "2023", "b", "2025", -1.0), ("03", "new", "2023", "b", "2025", -2.0), ("03", "new", "2023", "a", "2024", -9.0), (None, "x", "2023", "b", "2025", 0.0)]))
    after = files_of(store)
    assert kept(change.replaced) == [("03", "t3", "2023", 3.0)] and kept(change.added) == [("03", "new", "2023", -2.0), ("03", "t3", "2023", -1.0)]
    changed = {before[p] for p in set(before) - set(after)}
    assert changed and {after[p] for p in set(after) - set(before)} == changed and len(changed) <= 2 < len(before)
    expected = {tuple(r[:3]): r[5] for r in many(400)} | {("03", "t3", "2023"): -1.0, ("03", "new", "2023"): -2.0}
    assert kept(store.read()) == sorted((*k, v) for k, v in expected.items())
    # the version before is still there for its readers
    assert kept(store.read(version=str(change.before))) == sorted((e, t, y, d) for e, t, y, _, _, d in many(400))


def test_a_hot_partnership_is_split_and_buckets_grow_with_the_data(spark, store):
    store.upsert(rows(spark, many(60)))
    small = len(store.folder.manifest().parts)
    store.upsert(rows(spark, many(3000, hot=2400, run="b")))
    store.upsert(rows(spark, [("00", "one", "2020", "c", "2025", 5.0)]))
    manifest = store.folder.manifest()
    assert len(manifest.parts) > small and max(manifest.parts) > 1
    hot = next(b for b, p in enumerate(manifest.parts) if p > 1)
    assert len({f["part"] for f in manifest.files if f["bucket"] == hot}) > 1
    expected = {tuple(r[:3]): r[5] for r in many(60)} | {tuple(r[:3]): r[5] for r in many(3000, hot=2400)} | {("00", "one", "2020"): 5.0}
    assert kept(store.read()) == sorted((*k, v) for k, v in expected.items())
    assert kept(store.read().where("partnership_ein = '00' AND partner_tin = 'one'")) == [("00", "one", "2020", 5.0)]


def test_random_batches_equal_a_dictionary(spark, store):
    rng, model = random.Random(2), {}
    for turn in range(4):
        batch = [(f"{rng.randrange(6)}", f"t{rng.randrange(9)}", rng.choice(["2023", "2024", "junk/..", "é"]), f"r{turn}", "2025", float(rng.randrange(1000))) for _ in range(25)]
        batch = list({tuple(r[:3]): r for r in batch}.values())
        store.upsert(rows(spark, batch).repartition(3))
        model |= {tuple(r[:3]): r[5] for r in batch}
        assert kept(store.read()) == sorted((*k, v) for k, v in model.items())
    assert store.version() == 4 and store.folder.versions() == [3, 4]
    assert kept(store.read().where("tax_year = 'junk/..'")) == sorted((*k, v) for k, v in model.items() if k[2] == "junk/..")
    named = {f["path"] for v in (3, 4) for f in store.folder.manifest(v).files}
    there = {f"data/{d.base_name}/{f.base_name}" for d in store.folder.names("data") for f in store.folder.names(f"data/{d.base_name}")}
    assert there == named
    store.upsert(rows(spark, []))
    assert kept(store.read()) == sorted((*k, v) for k, v in model.items())


def test_second_writer_of_a_version_fails_and_leaves_nothing(spark, store, monkeypatch):
    store.upsert(rows(spark, many(40)))
    before, folders = kept(store.read()), {f.base_name for f in store.folder.names("data")}
    other = RecordStore(spark, store.options["path"], leaf_bytes=6000)
    other.upsert(rows(spark, [("99", "z", "2024", "b", "2025", 7.0)]))
    stale = store.folder.manifest(1)
    monkeypatch.setattr(Folder, "manifest", lambda self, version=None: stale)  # this writer has not seen the second version
    with pytest.raises(Exception, match="someone else"):
        store.upsert(rows(spark, [("98", "y", "2024", "b", "2025", 8.0)]))
    monkeypatch.undo()
    assert kept(store.read()) == sorted([*before, ("99", "z", "2024", 7.0)])
    assert len({f.base_name for f in store.folder.names("data")} - folders) == 1  # the second writer's only


def test_two_writers_at_once(spark, store):
    store.upsert(rows(spark, many(40)))
    errors = []

    def put(key):
        try:
            RecordStore(spark, store.options["path"], leaf_bytes=6000).upsert(rows(spark, [(key, "z", "2024", "b", "2025", 7.0)]))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=put, args=(k,)) for k in ("97", "98")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = {r[0] for r in kept(store.read())}
    assert len(found & {"97", "98"}) == 2 - len(errors) and len(errors) <= 1


def test_a_crash_between_write_and_commit_leaves_the_version_and_an_orphan(spark, store, monkeypatch):
    store.upsert(rows(spark, many(40)))
    before = kept(store.read())
    writer = record_store.RecordWriter(store.options | {"base": "1", "layout": "[1]", "replaced": "[]"})
    place = store.placed(rows(spark, many(5, run="x")), [1]).toArrow()
    message = writer.write(iter(place.to_batches()))  # and then the driver is gone
    assert message.files and kept(store.read()) == before
    assert store.remove_orphans() == []  # it may still be at work
    assert store.remove_orphans(older_than=0) == [writer.folder.split("/")[1]] and kept(store.read()) == before
    writer.write(iter(place.to_batches()))
    writer.abort([message, None])
    assert {f.base_name for f in store.folder.names("data")} == {f["path"].split("/")[1] for f in store.folder.manifest().files}


def test_publishing_is_one_step(tmp_path):
    folder = Folder({"path": f"file://{tmp_path}/s"})
    folder.publish(Manifest(1, [1], []))
    with pytest.raises(RuntimeError, match="someone else"):
        folder.publish(Manifest(1, [2], []))
    assert folder.manifest().parts == [1]


def test_connector_settings():
    none = Connector.from_settings({})
    assert none == Connector() and none.root("/x/y") == "/x/y" and none.hadoop_conf() == {} and none.options() == {"region": "us-east-1", "single_writer": "false"}
    found = Connector.from_settings({"LEDGERLOOM_STORE_BUCKET": "b", "LEDGERLOOM_STORE_ENDPOINT": "http://h:9", "LEDGERLOOM_STORE_ACCESS_KEY": "k", "LEDGERLOOM_STORE_SECRET_KEY": "s", "LEDGERLOOM_STORE_SINGLE_WRITER": "True"})
    assert found.root("/records/") == "s3a://b/records" and found.single_writer
    assert found.hadoop_conf()["fs.s3a.endpoint"] == "http://h:9" and found.options()["access_key"] == "k" and found.options()["single_writer"] == "true"
    fs, path = record_store.opened(found.options() | {"path": found.root("records")})
    assert fs.type_name == "s3" and path == "b/records"


def test_missing_store_is_empty(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/none")
    assert store.read().count() == 0 and store.version() == 0 and store.read().schema.fieldNames() == TABLE.fieldNames() and KEY[0] in store.read().columns
