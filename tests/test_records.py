import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import currency, folder_title, is_number, mask_ein, mask_tin, parse_amount, partner_class, percent, preview, ratio, replace_all, run_folder, short_time, similarity, slug, strip
from ledgerloom.operators import checks, cross_rules
from ledgerloom.plans import queries, reports
from ledgerloom.schemas import AMOUNT_FIELDS, RECORD, TABLE

from .fixture_records import PROFILES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def profiles(spark):
    columns = "profile int, partnership_ein string, partner_tin string, tax_year string, kind string, entity_type string, pct double, " + ", ".join(f"{c} double" for c in "b1 b2 ga it od qd st lt s9 se fo di qb cb ce".split())
    rows = spark.createDataFrame(PROFILES, columns)
    names = dict(zip("b1 b2 ga it od qd st lt s9 se fo di qb cb ce".split(), [
        "ordinary_business_income", "rental_real_estate_income", "guaranteed_payments", "interest_income", "ordinary_dividends", "qualified_dividends",
        "short_term_capital_gains", "long_term_capital_gains", "section_179_deduction", "self_employment_earnings", "foreign_taxes_paid", "distributions",
        "qbi_deduction", "capital_account_beginning", "capital_account_ending"]))
    return rows.withColumnsRenamed(names).withColumns({
        "partner_type": F.when(F.col("kind") == "GP", "General Partner").otherwise("Limited Partner"), "partner_share_percentage": F.col("pct"),
        "partnership_name": F.concat(F.lit("Partnership "), "partnership_ein"),
    }).drop("kind", "pct").cache()


def test_profiles_checks(profiles):
    rows = checks.check_rows(profiles, ["profile"])
    assert rows.count() == 34 * 44
    failed = {}
    for r in rows.where("NOT passed").collect():
        failed.setdefault(r.rule_id, set()).add(r.profile)
    assert failed == {"ARITH-008": {2, 5, 7, 13, 14, 16}, "CAP-001": {3, 12, 16, 22, 24, 28}}
    status = {r.profile: r.status for r in checks.with_status(checks.report(checks.with_checks(profiles))).collect()}
    assert {p for p, s in status.items() if s == "warnings"} == {3, 12, 16, 22, 24, 28} and "failed" not in status.values()


def test_profiles_rules(profiles):
    stamped = profiles.withColumns({"run_id": F.col("profile").cast("string"), "ingested_at": F.lit("2025"), "pdf_sha256": F.lit(None).cast("string")})
    rows = cross_rules.all_rules(stamped.drop("entity_type"), "run-1").collect()
    assert len(rows) == 117 and sum(r.passed for r in rows) == 96
    fails = {}
    for r in rows:
        if not r.passed:
            fails[r.rule_id] = fails.get(r.rule_id, 0) + 1
    assert fails == {"A1": 1, "A2": 12, "A3": 5, "B1": 1, "B4": 1, "D4": 1}
    assert {r.run_id_trigger for r in rows} == {"run-1"}
    exempt = cross_rules.self_employment(cross_rules.grouped(profiles)).where("NOT passed")
    assert exempt.count() == 0


BASE = {"tax_year": "2024", "partnership_name": "P", "partner_type": "Limited Partner", "partner_share_percentage": 10.0}


@pytest.mark.parametrize(
    "change, failing",
    [
        ({}, set()),
        ({"tax_year": None}, {"FC-001"}), ({"tax_year": "20x4"}, {"FC-001"}), ({"tax_year": ""}, {"FC-001"}),
        ({"partnership_name": " "}, {"FC-003"}), ({"partnership_name": None}, {"FC-003"}),
        ({"partner_type": "owner"}, {"FC-004"}), ({"partner_type": None}, {"FC-004"}),
        ({"partner_share_percentage": 0.0}, {"ARITH-002"}), ({"partner_share_percentage": -1.0}, {"ARITH-002", "FC-010"}),
        ({"partner_share_percentage": 100.5}, {"ARITH-002", "FC-010"}), ({"partner_share_percentage": None}, set()),
        ({"ordinary_dividends": 5.0, "qualified_dividends": 6.0}, {"ARITH-001"}),
        ({"qualified_dividends": 6.0}, {"ARITH-009"}),
        ({"section_179_deduction": 1220001.0}, {"FC-031"}),
        ({"section_179_deduction": 600.0, "ordinary_business_income": 100.0}, {"ARITH-011"}),
        ({"foreign_taxes_paid": 5.0}, {"ARITH-010"}), ({"foreign_taxes_paid": 5.0, "interest_income": 1.0}, set()),
        ({"self_employment_earnings": 2000.0, "guaranteed_payments": 1000.0}, {"ARITH-007", "FC-032"}),
        ({"partner_type": "General Partner", "self_employment_earnings": 90000.0, "ordinary_business_income": 10000.0}, {"ARITH-006"}),
        ({"distributions": -1.0}, {"ARITH-003-distributions", "FC-021-distributions", "FC-040-distributions"}),
        ({"interest_income": 10000001.0}, {"FC-040-interest_income"}),
        ({"capital_account_beginning": 0.0, "capital_account_ending": 50000.0}, {"CAP-001"}),
        ({"qbi_deduction": 90000.0, "ordinary_business_income": 1000.0}, {"ARITH-008"}),
    ],
)
def test_single_checks(spark, change, failing):
    row = {f: None for f in RECORD.fieldNames()} | BASE | change
    df = spark.createDataFrame([tuple(row[f] for f in RECORD.fieldNames())], RECORD)
    assert {r.rule_id for r in checks.check_rows(df, []).where("NOT passed").collect()} == failing


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert value(similarity(lit("Alpha Fund"), lit("ALPHA fund"))) == 1.0 and value(similarity(lit(""), lit("x"))) == 0.0
    assert value(similarity(lit("abc"), lit("abd"))) == pytest.approx(1 / 3)
    assert value(strip(lit("  a b　"))) == "a b"
    assert value(mask_ein(lit("46-3819204"))) == "46-***204" and value(mask_tin(lit("621-47-8830"))) == "621-***"
    assert value(slug(lit(" Red Mesa & Co. "))) == "red_mesa_co"
    assert value(preview(lit("a" * 501))) == "a" * 500 + "..." and value(preview(lit("a"))) == "a"
    assert float(value(parse_amount(lit("(42,315)")))) == -42315 and float(value(parse_amount(lit("A  18,000")))) == 18000
    assert value(parse_amount(lit(""))) is None
    assert value(partner_class(lit("General Partner"))) == "GP" and value(currency(lit(-1234.5))) == "($1,234.50)"
    pairs = F.array(F.struct(lit("<X_1>").alias("placeholder"), lit("one").alias("original")), F.struct(lit("<X_10>").alias("placeholder"), lit("ten").alias("original")))
    assert value(replace_all(lit("<X_10> <X_1>"), pairs)) == "ten one"


def test_shown_values(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [value(is_number(lit(t))) for t in ("12", "-1.5", "1.2.3", "1-2-3", "", ".", "a1", None)] == [True, True, False, False, False, False, False, False]
    assert value(percent(lit(12.34))) == "12.3%" and value(percent(lit(None))) == "\u2014"
    assert value(ratio(lit(0.456))) == "0.46x" and value(ratio(lit(None))) == "\u2014"
    assert value(short_time(lit("2025-03-04T05:06:07+00:00"))) == "2025-03-04 05:06"
    assert value(folder_title(lit("red_mesa_20250304_050607"))) == "red mesa"
    assert value(run_folder(lit("red_mesa"), lit("2025-03-04 05:06:07").cast("timestamp"))) == "red_mesa_20250304_050607"


def test_repeated_records(spark):
    row = {f.name: None for f in TABLE.fields} | {"partnership_ein": "1", "tax_year": "2024", "pdf_sha256": "h"}
    def made(tin, run, **more):
        return tuple((row | {"partner_tin": tin, "run_id": run, "ingested_at": run} | more)[f.name] for f in TABLE.fields)
    df = spark.createDataFrame([made("a", "1", distributions=1.0), made("a", "2", distributions=1.0), made("a", "3", distributions=2.0)], TABLE)
    rows = cross_rules.repeated_records(df).collect()
    assert sorted((r.rule_id, r.passed, r.detail) for r in rows) == [("C1", False, None), ("C2", False, "distributions")]
    assert cross_rules.repeated_files(df).count() == 2


def test_bad_years_do_not_pair(spark):
    row = {f: None for f in AMOUNT_FIELDS}
    rows = [("e", "t", y, "n", "General Partner", *row.values()) for y in ("2023", "2024", "", "x", None)]
    schema = "partnership_ein string, partner_tin string, tax_year string, partnership_name string, partner_type string, " + ", ".join(f"{f} double" for f in row)
    assert [r.tax_year for r in cross_rules.year_pairs(spark.createDataFrame(rows, schema)).collect()] == ["2024"]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.ORACLES)))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "customer orders lineitem documents supplier nation conversations benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got) == sorted(expected)
    assert as_text(got) == as_text(expected)


def as_text(df):
    columns = df[sorted(df)].astype(object)
    rows = [tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in columns.itertuples(index=False)]
    return sorted(rows)


def test_analysis_and_overview(profiles):
    row = reports.overview(reports.with_analysis(profiles)).first()
    # box 1, box 2, guaranteed, interest, ordinary dividends, short and long gains
    assert row.reports == 34 and row.income_cents == sum(round(100 * (p[i] or 0)) for p in PROFILES for i in (7, 8, 9, 10, 11, 13, 14))
    assert reports.populated_fields(profiles).agg(F.max("populated")).first()[0] <= 19
    assert reports.partnerships(profiles).count() == 13
