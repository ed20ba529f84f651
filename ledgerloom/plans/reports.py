"""Roll-ups and read models: analysis, overview, dashboard projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.terms import Terms
from ..schemas import INCOME7, RECORD
from ..session import ship_package, stored

DEDUCTIONS = ["section_179_deduction", "foreign_taxes_paid", "qbi_deduction"]
#: Most ground-truth strings of one broadcast.
MOST_LABELS = 100_000


def with_analysis(records: DataFrame) -> DataFrame:
    """Income and deduction totals and their difference, nulls as zero."""
    total = lambda fields: sum((F.coalesce(F.col(f), F.lit(0.0)) for f in fields), F.lit(0.0))
    df = records.withColumns({"total_income": total(INCOME7), "total_deductions": total(DEDUCTIONS)})
    net = F.col("total_income") - F.col("total_deductions")
    return df.withColumns({"net_taxable_income": net, "effective_ratio": F.try_divide(net, F.col("total_income"))})


def populated_fields(records: DataFrame) -> DataFrame:
    count = sum((F.col(f).isNotNull().cast("int") for f in RECORD.fieldNames()), F.lit(0))
    return records.withColumn("populated", count)


def overview(reports: DataFrame) -> DataFrame:
    """Totals in whole cents, so that their order does not matter."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100, 0).cast("long"))
    return reports.agg(F.count("*").alias("reports"), cents("total_income").alias("income_cents"), cents("net_taxable_income").alias("net_cents"))


def partnerships(records: DataFrame) -> DataFrame:
    """Each partnership and year with its number of records and the name that its
    first record gives (by time and run where there are such, then by partner)."""
    order = F.struct(*(F.col(c) for c in ("ingested_at", "run_id", "partner_tin") if c in records.columns), "partnership_name")
    return records.groupBy("partnership_ein", "tax_year").agg(F.count("*").alias("k1_count"), F.min_by("partnership_name", order).alias("name"))


def scoped_results(results: DataFrame, ein: str) -> DataFrame:
    """Rule results of one partnership."""
    return results.where(F.col("partnership_ein") == ein)


def scoped_summary(results: DataFrame, groups: DataFrame, ein: str, pairs_checked: int) -> DataFrame:
    """The counts of one partnership's results; year pairs count as checked only
    if the partnership has records of more than one year."""
    own = results.where(F.col("partnership_ein") == ein)
    years = groups.where(F.col("partnership_ein") == ein).agg(F.count("*").alias("partnerships"))
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)).alias(f"{s}_failures")
    counts = own.agg(
        F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"),
        bad("critical"), bad("warning"), bad("advisory"),
    )
    pairs = F.when(F.col("partnerships") > 1, F.lit(pairs_checked)).otherwise(0).cast("long").alias("year_pairs_checked")
    return counts.crossJoin(years).select(*counts.columns, "partnerships", pairs)  # one row each


def present_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """(field, value) of every field of a record that has a value."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in RECORD.fieldNames()))
    return records.select(*keys, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select(*keys, "p.*")


def recognition_scores(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """Per engine and profile: ground-truth strings found, asked for, accuracy,
    seconds and characters.  ``readings`` has engine, profile, text, seconds; of
    repeated readings all count."""
    size = truth.count()
    if size > MOST_LABELS:
        raise ValueError(f"{size} ground-truth strings; at most {MOST_LABELS} are broadcast")
    labels = F.broadcast(truth.agg(F.collect_list("expected").alias("expected")))
    hits = F.size(F.filter("expected", lambda x: F.contains(F.coalesce("text", F.lit("")), x)))
    marked = readings.crossJoin(labels).withColumns({"hits": hits, "total": F.size("expected")})
    found = marked.groupBy("engine", "profile").agg(
        F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.sum("seconds").alias("seconds"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters")
    )
    return found.withColumn("accuracy", F.try_divide(F.col("hits"), F.col("total")))


def batch_outcome(runs: DataFrame) -> DataFrame:
    """Runs, successes, failures and seconds a document; ``runs`` has succeeded
    and seconds."""
    return runs.agg(
        F.count("*").alias("runs"), F.count_if("succeeded").alias("successes"), F.count_if(~F.coalesce("succeeded", F.lit(False))).alias("failures"),
        F.try_divide(F.sum("seconds"), F.count("*")).alias("seconds_a_document"),
    )


def failed_checks(rows: DataFrame, severity: str | None = None) -> DataFrame:
    failed = rows.where(~F.col("passed"))
    return failed if severity in (None, "all") else failed.where(F.col("severity") == severity)


def capital_bars(records: DataFrame) -> DataFrame:
    """Shares of beginning and change in ending capital, null for a zero total."""
    total = F.abs("capital_account_beginning") + F.abs(F.col("capital_account_ending") - F.col("capital_account_beginning"))
    return records.withColumn("beginning_share", F.abs("capital_account_beginning") / F.nullif(total, F.lit(0.0)))


def comparison(spans: DataFrame) -> DataFrame:
    """Entity counts by type and detection mode, with a TOTAL row; the few counts
    are stored, as the total would search for the spans again."""
    counts = stored(spans.groupBy("entity_type").pivot("mode", ["patterns", "zero_shot", "combined"]).count().fillna(0), "entity-counts")
    total = counts.agg(F.lit("TOTAL").alias("entity_type"), *(F.sum(c).alias(c) for c in ("patterns", "zero_shot", "combined")))
    return counts.unionByName(total)


def recall(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of ground-truth strings found in each text; ``truth`` is the short
    list of labels, whatever the number of texts.  All labels are looked for in
    one pass over a text; more than MOST_LABELS rows are an error.  A null text
    finds nothing and has no accuracy, a null label is never found."""
    if truth.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} ground-truth strings")
    ship_package(texts.sparkSession)
    known = truth.where("expected IS NOT NULL").groupBy("expected").agg(F.count("*").alias("n"))
    weights = {r["expected"]: r["n"] for r in known.collect()}  # at most MOST_LABELS
    total, usable = truth.count(), sum(weights.values())
    terms = Terms(list(weights))
    rows = texts.withColumn("hits", F.coalesce(terms.weight(F.col("text"), list(weights.values())), F.lit(0)))
    keys = [c for c in texts.columns if c != "text"]
    read = F.sum(F.when(F.col("text").isNotNull(), F.lit(usable)).otherwise(0))
    sums = rows.groupBy(*keys).agg(F.sum("hits").alias("hits"), (F.count("*") * F.lit(total)).alias("total"), read.alias("read"))
    return sums.select(*keys, "hits", "total", F.try_divide(F.col("hits"), F.col("read")).alias("accuracy"))


def stitch_pages(pages: DataFrame) -> DataFrame:
    """run_id, full_text and characters from (run_id, page, text)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    text = F.array_join(parts, "\n\n--- PAGE BREAK ---\n\n")
    return pages.groupBy("run_id").agg(text.alias("full_text"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("page_count"))
