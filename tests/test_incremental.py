import random

import pytest
from ledgerloom.operators import cross_rules, incremental
from ledgerloom.operators.incremental import RuleBook, combined, upsert_and_judge
from ledgerloom.schemas import INCOME6, TABLE
from ledgerloom.sources.record_store import RecordStore


def batch(spark, rng, turn, size, eins=4):
    """Records with every kind of trouble: nulls, odd years, shared files, names."""
    rows = {}
    for _ in range(size):
        key = (f"e{rng.randrange(eins)}", f"t{rng.randrange(5)}", rng.choice(["2022", "2023", "2024", "02024", "x"]))
        amounts = {f: rng.choice([None, 0.0, 10.25, -3.5, float(rng.randrange(1000))]) for f in INCOME6 + ["distributions", "capital_account_beginning", "capital_account_ending", "self_employment_earnings", "guaranteed_payments"]}
        rows[key] = dict(zip(("partnership_ein", "partner_tin", "tax_year"), key)) | amounts | {
            "run_id": f"r{turn}-{len(rows)}", "ingested_at": f"2025-01-{turn + 1:02d}", "pdf_sha256": rng.choice([None, "h1", "h2", f"h{rng.randrange(40)}"]),
            "partnership_name": rng.choice(["Fund A", "Fund A LP", "Other", "", None]), "partner_type": rng.choice(["General Partner", "Limited Partner", "LLC Member-Manager", None]),
            "partner_share_percentage": rng.choice([None, 0.0, 20.0, 55.5, 100.0]),
        }
    return spark.createDataFrame([tuple(r.get(f.name) for f in TABLE.fields) for r in rows.values()], TABLE)


def shown(df):
    return sorted((tuple(r) for r in df.select(*cross_rules.RESULT).collect()), key=str)


def test_any_batches_equal_a_full_run(spark, tmp_path):
    rng = random.Random(5)
    records = RecordStore(spark, f"file://{tmp_path}/records", leaf_bytes=9000)
    book = RuleBook(spark, f"file://{tmp_path}/rules", records, leaf_bytes=9000)
    assert book.results().count() == 0
    for turn, size in enumerate([40, 7]):
        upsert_and_judge(records, book, batch(spark, rng, turn, size))
        now = records.read()
        assert shown(book.results()) == shown(cross_rules.all_rules(now))
        fields = sorted(book.totals().columns)
        assert sorted(map(str, book.totals().select(fields).collect())) == sorted(map(str, cross_rules.totals(now).select(fields).collect()))


def test_a_small_batch_reads_little_and_a_lost_run_is_made_good(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    records = RecordStore(spark, f"file://{tmp_path}/records", leaf_bytes=9000)
    book = RuleBook(spark, f"file://{tmp_path}/rules", records, leaf_bytes=9000)
    upsert_and_judge(records, book, batch(spark, rng, 0, 600, eins=60))
    whole = records.read().count()
    assert book.last_read == whole > 400
    rebuilt = []
    monkeypatch.setattr(RuleBook, "rebuild", lambda self, f=RuleBook.rebuild: (rebuilt.append(1), f(self)))
    upsert_and_judge(records, book, batch(spark, rng, 1, 1, eins=60))
    assert not rebuilt and 0 < book.last_read < whole / 3

    # the driver is lost before the marker: versions no longer belong together
    change = records.upsert(batch(spark, rng, 2, 2, eins=60))
    monkeypatch.setattr(book, "_mark", lambda version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        book.apply(change)
    monkeypatch.delattr(book, "_mark")
    book.apply(change)
    assert rebuilt == [1] and shown(book.results()) == shown(cross_rules.all_rules(records.read()))
    book.apply(change)  # the same change again does nothing
    assert rebuilt == [1]


def test_totals_of_removed_records_leave_no_row(spark):
    rng = random.Random(1)
    rows = batch(spark, rng, 0, 12)
    some = rows.where("partnership_ein = 'e1'")
    left = combined((cross_rules.totals(rows), 1), (cross_rules.totals(some), -1))
    columns = sorted(left.columns)
    expected = cross_rules.totals(rows.where("partnership_ein <> 'e1'")).select(columns)
    assert sorted(map(str, left.select(columns).collect())) == sorted(map(str, expected.collect()))
    assert incremental.combined((cross_rules.totals(some), 1), (cross_rules.totals(some), -1)).count() == 0
