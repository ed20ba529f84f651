"""Result documents: one nested row a run, the overview of all runs and the
manifest of a batch.  They stay DataFrames until a sink writes them, one line a
run, so no document of all runs is built in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECORD

RESULTS_NAME = "pipeline_results.json"
RULES_NAME = "cross_partner_results"
VERSION = "1.0.0"
# The times of a run's steps in its result document.
STEP_TIMES = [
    "ingestion_timestamp", "ocr_timestamp", "pii_scan_timestamp", "sanitization_timestamp", "extraction_timestamp", "analysis_timestamp",
    "deterministic_validation_timestamp", "ai_validation_timestamp",
]
_MODE = "struct<total:bigint,counts:map<string,bigint>,entities:array<struct<entity_type:string,start:int,end:int,score:double,text_snippet:string>>>"
_COUNTS = "map<string,bigint>"


def entity_totals(spans: DataFrame, key: str = "run_id") -> DataFrame:
    """key, total_entities and entity_counts (type -> number) of span rows."""
    by_type = spans.groupBy(key, "entity_type").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("entity_type", "n")))  # one entry a type
    return by_type.groupBy(key).agg(F.sum("n").alias("total_entities"), F.map_from_entries(pairs).alias("entity_counts"))


def entity_comparison(spans: DataFrame, key: str = "run_id") -> DataFrame:
    """key and ``modes``: for every way of detection its total, counts by type and
    entities in the order of the text.  ``spans`` has key, mode and a span's fields;
    a run's entities are those of one document."""
    entity = F.struct("entity_type", "start", "end", "score", "text_snippet")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "end", entity.alias("e")))), lambda x: x["e"])
    by_type = spans.groupBy(key, "mode", "entity_type").agg(F.count("*").alias("n"))
    counts = by_type.groupBy(key, "mode").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("counts"))
    listed = spans.groupBy(key, "mode").agg(F.count("*").alias("total"), ordered.alias("entities"))
    one = listed.join(counts, [key, "mode"]).select(key, "mode", F.struct("total", "counts", "entities").cast(_MODE).alias("found"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("mode", "found"))).alias("modes"))


def by_count(counts: Column) -> Column:
    """The entries of a map, the largest number first, ties by name."""
    ordered = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("entity_type"), e["value"].alias("n"))))
    return F.transform(ordered, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["n"].alias("n")))


def bar_scale(*totals: str) -> Column:
    """The largest of several totals, at least one, by which bars are scaled."""
    return F.greatest(F.lit(1), *(F.coalesce(F.col(t), F.lit(0)) for t in totals))


def run_documents(
    records: DataFrame, statuses: DataFrame, entities: DataFrame | None = None, judged: DataFrame | None = None, rules: DataFrame | None = None, generated_at: str | None = None,
    comparison: DataFrame | None = None, times: DataFrame | None = None, version: str = VERSION,
) -> DataFrame:
    """run_id and the nested result of every run that has a record with its
    analysis and a status.  Entity totals, judgements, the comparison of detections
    (``entity_comparison``) and the times of steps (STEP_TIMES, null where a step
    has not run) are optional, run by run;
    ``rules`` is the one-row summary of the rules over the whole table, which
    stands in every document as JSON and is null where there is none.  The rule
    results stay in a table of their own: in every document they would grow with
    the square of the runs.  Each other input has one row a run."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if generated_at is None else F.lit(generated_at)
    rows = records.join(statuses, "run_id")
    none = F.create_map().cast(_COUNTS)
    if entities is None:
        rows = rows.withColumns({"total_entities": F.lit(0).cast("long"), "entity_counts": none})
    else:
        rows = rows.join(entities.select("run_id", "total_entities", "entity_counts"), "run_id", "left")
    if judged is None:
        rows = rows.withColumns({"coherence_score": F.lit(None).cast("double"), "ocr_confidence": F.lit(None).cast("double")})
    else:
        rows = rows.join(judged.select("run_id", "coherence_score", "ocr_confidence"), "run_id", "left")
    if rules is None:
        rows = rows.withColumn("rules", F.lit(None).cast("string"))
    else:  # an aggregate without keys: one row, null where there is none
        rows = rows.crossJoin(F.broadcast(rules.agg(F.first(F.to_json(F.struct("*"))).alias("rules"))))
    if comparison is None:
        rows = rows.withColumn("modes", F.lit(None).cast(f"map<string,{_MODE}>"))
    else:
        rows = rows.join(comparison.select("run_id", "modes"), "run_id", "left")
    if times is not None:
        rows = rows.join(times.select("run_id", *(F.col(t).alias(f"_{t}") for t in STEP_TIMES if t in times.columns)), "run_id", "left")
    step = lambda t: (F.col(f"_{t}") if f"_{t}" in rows.columns else F.lit(None)).cast("string").alias(t)
    total = F.coalesce("total_entities", F.lit(0))
    folder = F.concat_ws("/", F.lit("output"), "run_id")
    return rows.select(
        "run_id",
        F.struct(at.alias("generated_at"), F.lit("completed").alias("status"), F.lit(version).alias("pipeline_version")).alias("pipeline_run"),
        F.struct(*RECORD.fieldNames()).alias("k1_data"),
        F.struct("total_income", "total_deductions", "net_taxable_income").alias("financial_analysis"),
        F.struct(total.alias("total_entities_detected"), F.coalesce("entity_counts", none).alias("entity_counts"), total.alias("entities_redacted")).alias("pii_stats"),
        F.struct(
            F.col("status").alias("overall_status"), F.struct("critical_count", "warning_count", "advisory_count").alias("deterministic"),
            F.when(F.col("coherence_score").isNotNull(), F.struct("coherence_score", "ocr_confidence")).alias("ai"),
        ).alias("validation"),
        F.coalesce("modes", F.create_map().cast(f"map<string,{_MODE}>")).alias("pii_comparison"),
        F.struct(*map(step, STEP_TIMES), at.alias("report_generated_at")).alias("processing_metadata"),
        F.struct(F.concat(folder, F.lit("/k1_report.json")).alias("full_report"), F.concat(folder, F.lit("/k1_summary.csv")).alias("csv_summary")).alias("output_files"),
        F.col("rules").alias("cross_partner_validation"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder a run under ``path``, as JSON lines."""
    documents.write.partitionBy("run_id").json(path)


def rule_parts(results: DataFrame, records: DataFrame, generated_at: str | None = None) -> dict[str, DataFrame]:
    """The document of all rule results as rows, however many there are:
    ``summary`` (one row: time, counts by outcome and severity, year pairs that
    were checked), ``partnerships_validated`` (a row a partnership and year, with
    the name of its first record) and ``results`` (all of them)."""
    from ..operators.cross_rules import summary, year_pairs
    from .reports import partnerships

    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if generated_at is None else F.lit(generated_at)
    counts = summary(results).toDF("total_checks", "passed", "failed", "critical", "warnings", "advisory")
    pairs = year_pairs(records).agg(F.count("*").alias("year_pairs_checked"))
    groups = partnerships(records).toDF("partnership_ein", "tax_year", "partner_count", "partnership_name")
    return {"summary": counts.crossJoin(pairs).select(at.alias("generated_at"), "*"), "partnerships_validated": groups, "results": results}  # a row each


def write_rules(parts: dict[str, DataFrame], path: str) -> None:
    """Every part of ``rule_parts`` as JSON lines in a folder of its own."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{RULES_NAME}/{name}")


def rule_document_of(parts: dict[str, DataFrame], ein: str) -> DataFrame:
    """One partnership's document: summary of its results, its years and results as
    arrays, which are as large as one partnership."""
    own = {name: rows.where(F.col("partnership_ein") == ein) for name, rows in parts.items() if name != "summary"}
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    fields = [c for c in own["results"].columns if c != "partnership_ein"]
    found = own["results"].agg(
        F.struct(
            F.count("*").alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
            bad("critical").alias("critical"), bad("warning").alias("warnings"), bad("advisory").alias("advisory"),
        ).alias("summary"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("results"),
    )
    years = own["partnerships_validated"].agg(F.sort_array(F.collect_list(F.struct("tax_year", "partner_count", "partnership_name"))).alias("partnerships_validated"))
    return found.crossJoin(years)  # one row each


def read_overview(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a stored result document: its folder and the parts of ``schema``
    that a list shows; parts that a document lacks are null."""
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    folder = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^run_id=", "")
    return found.select(folder.alias("directory"), "*").orderBy("directory")


def overview_header(reports: DataFrame) -> DataFrame:
    """One row: the number of reports and when the latest was made."""
    return reports.agg(F.count("*").alias("total_reports"), F.max("processing_metadata.report_generated_at").alias("latest"))


def manifest(profiles: DataFrame, names: list[str]) -> DataFrame:
    """One row a profile, numbered by file name, with the number of form fields
    that are filled; the count of all is the manifest's head.  ``profiles`` is
    the fixed list of fixtures, not data that grows."""
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in names), F.lit(0))
    entry = F.struct("file_name", filled.alias("fields_filled"))
    entries = profiles.agg(F.count("*").alias("total_profiles"), F.sort_array(F.collect_list(entry)).alias("files"))
    return entries.withColumn("files", F.transform("files", lambda e, i: F.struct((i + 1).alias("profile_number"), e["file_name"].alias("file_name"), e["fields_filled"].alias("fields_filled"))))


def json_schema() -> Column:
    """The record's schema as text, as a literal."""
    return F.lit(RECORD.json())
