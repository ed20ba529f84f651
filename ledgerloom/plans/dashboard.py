"""Read models: what a list, a detail page and the rule overview show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import replace_all

#: Marks of the processing steps, in order; a step is done once its time is known.
STEPS = ["ingested_at", "ocr_at", "detected_at", "sanitized_at", "extracted_at", "analysed_at", "checked_at", "judged_at", "reported_at"]


def resolve_mappings(reports: DataFrame, by_run: DataFrame, fallback: DataFrame) -> DataFrame:
    """Reports with the placeholder mapping of their run, else of their folder;
    each mapping is (key, mapping array of placeholder and original)."""
    own = by_run.select("run_id", F.col("mapping").alias("own"))
    other = fallback.select("report_dir", F.col("mapping").alias("other"))
    joined = reports.join(own, "run_id", "left").join(other, "report_dir", "left")
    empty = F.array().cast("array<struct<placeholder:string,original:string>>")
    return joined.withColumn("mapping", F.coalesce("own", "other", empty)).drop("own", "other")


def resolved(reports: DataFrame, columns: list[str]) -> DataFrame:
    """Placeholders in text columns replaced; the text 'null' is no value."""
    return reports.withColumns({c: F.nullif(replace_all(F.col(c), F.col("mapping")), F.lit("null")) for c in columns})


def report_list(reports: DataFrame) -> DataFrame:
    """One row a report, newest folder last, with defaults for what is missing."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)
    return reports.select(
        "report_dir", text("partnership_name", "Unknown"), text("tax_year", "-"), text("partner_type", "-"), F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(F.nullif(F.col("total_income"), F.lit(0.0)), "ordinary_business_income", F.lit(0.0)).alias("income"),
        (F.coalesce("short_term_capital_gains", F.lit(0.0)) + F.coalesce("long_term_capital_gains", F.lit(0.0))).alias("capital_gains"),
    ).orderBy("report_dir")


def report_detail(reports: DataFrame, checks: DataFrame, results: DataFrame, report_dir: str) -> DataFrame:
    """One report with its checks and its partnership's rule results as arrays."""
    one = reports.where(F.col("report_dir") == report_dir)
    own = checks.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("position", "rule_id", "severity", "passed"))).alias("checks"))
    rules = results.groupBy("partnership_ein").agg(F.sort_array(F.collect_list(F.struct("rule_id", "tax_year", "passed"))).alias("rules"))
    return one.join(own, "run_id", "left").join(rules, "partnership_ein", "left")


def rule_document(results: DataFrame, partnerships: DataFrame) -> DataFrame:
    """One row: summary, partnerships and failed results; zeros and empty arrays
    where there are none."""
    failed = results.where("NOT passed")
    parts = [
        results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")),
        partnerships.agg(F.sort_array(F.collect_list(F.struct("partnership_ein", "tax_year", "k1_count"))).alias("partnerships")),
        failed.agg(F.sort_array(F.collect_list(F.struct("rule_id", "partnership_ein", "tax_year", "severity"))).alias("failures")),
    ]  # each is one row
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def step_completion(reports: DataFrame) -> DataFrame:
    done = sum((F.col(c).isNotNull().cast("int") for c in STEPS if c in reports.columns), F.lit(0))
    return reports.withColumn("steps_done", done)


def form_fields(profiles: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``form``: form field -> value of the profile column, blanks left out."""
    pairs = [x for name, column in fields.items() for x in (F.lit(name), F.col(column).cast("string"))]
    return profiles.withColumn("form", F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v, F.lit("")) != ""))


def score_bands(spans: DataFrame, least: float = 0.4) -> DataFrame:
    """Spans of at least this score, best first, in percent."""
    return spans.where(F.col("score") >= least).withColumn("percent", F.round(F.col("score") * 100).cast("int")).orderBy(F.desc("score"))
