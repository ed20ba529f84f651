"""Queries that read derived rows twice derive them once."""

from ledgerloom.operators import checks
from ledgerloom.plans import queries
from ledgerloom.sources import files


def scans_of(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_restored_texts_are_sanitized_once(spark):
    found = queries.q_restored(spark, "/root/testdata/sf0.001")
    assert scans_of(found, "l_orderkey") == 0
    assert scans_of(found, "regexp_extract_all") == 0
    assert found.count() == queries.k1_records(spark, "/root/testdata/sf0.001").count()


def test_failed_checks_are_counted_without_a_row_for_each(spark):
    found = queries.q_assembled(spark, "/root/testdata/sf0.001")
    assert scans_of(found, "Generate ") == 0
    letters = queries._letters(spark, "/root/testdata/sf0.001")
    columns = ["run_id", "deterministic_critical_count", "deterministic_warning_count", "deterministic_passed"]
    by = [
        files.assemble_records(letters.select("run_id"), letters.select("run_id", "tax_year"), letters.select("run_id", "partnership_ein", "partner_tin"), rows).select(*columns)
        for rows in (checks.check_rows(letters, ["run_id"]), checks.report(letters).select("run_id", "critical_count", "warning_count"))
    ]
    assert by[0].count() > 0 and by[0].exceptAll(by[1]).isEmpty() and by[1].exceptAll(by[0]).isEmpty()
