"""Registered queries of the record engine, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.minify import minify
from ..functions.text import band, currency, folder_title, is_number, mask_ein, mask_tin, parse_amount, partner_class, preview, replace_all, run_folder, short_time, similarity, slug
from ..operators import checks, cross_rules, spans, terms
from ..operators.incremental import RuleBook, upsert_and_judge
from ..schemas import AMOUNT_FIELDS, INCOME6, INCOME7, KEY, RECORD, SUMMARY_FIELDS, TABLE
from ..session import shared_dir, ship_package, stored
from ..sources import files
from ..sources.record_store import RecordStore
from . import dashboard, reports, results
from .k1_view import K1_SQL, k1_records

def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("rule_id", "passed", "partnership_ein", "tax_year", "partner_tin", "detail", F.round("observed", 4).alias("observed"), F.round("threshold", 4).alias("threshold"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some came twice: unchanged, or with amended amounts."""
    k1 = _kept(spark, sf_dir)
    stamp = lambda df, v: df.withColumns({"run_id": F.concat_ws("/", *KEY, F.lit(str(v))), "ingested_at": F.lit(f"2025-01-0{v}T00:00:00"), "pdf_sha256": F.sha2(F.concat_ws("/", *KEY), 256)})
    last = F.substring("partner_tin", -1, 1)
    amended = k1.where(last == "7").withColumn("distributions", F.col("distributions") + 100).withColumn("interest_income", F.lit(None).cast("double"))
    return stamp(k1, 1).unionByName(stamp(k1.where(last == "3"), 2)).unionByName(stamp(amended, 3).withColumn("pdf_sha256", F.lit(None).cast("string")))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, computed once for plans that read them twice."""
    return stored(k1_records(spark, sf_dir), "records")


def q_checks(spark, sf_dir):
    return checks.check_rows(k1_records(spark, sf_dir), KEY).select(*KEY, "rule_id", "severity", "passed")


def q_report_status(spark, sf_dir):
    found = checks.with_status(checks.report(k1_records(spark, sf_dir)))
    return found.select(*KEY, "critical_count", "warning_count", "advisory_count", "status")


def q_percent_rules(spark, sf_dir):
    return _shown(cross_rules.percent_rules(cross_rules.totals(k1_records(spark, sf_dir))))


def q_allocation(spark, sf_dir):
    return _shown(cross_rules.proportional_allocation(cross_rules.grouped(_kept(spark, sf_dir)))).drop("observed")


def q_capital_proportion(spark, sf_dir):
    return _shown(cross_rules.capital_proportion(cross_rules.grouped(_kept(spark, sf_dir)))).drop("observed")


def q_names(spark, sf_dir):
    return _shown(cross_rules.name_consistency(cross_rules.grouped(_kept(spark, sf_dir))))


def q_distributions(spark, sf_dir):
    return _shown(cross_rules.distribution_reasonableness(cross_rules.totals(k1_records(spark, sf_dir))))


def q_self_employment(spark, sf_dir):
    return _shown(cross_rules.self_employment(cross_rules.grouped(_kept(spark, sf_dir))))


def q_pair_rules(spark, sf_dir):
    return _shown(cross_rules.pair_rules(cross_rules.year_pairs(_kept(spark, sf_dir))))


def q_repeated_records(spark, sf_dir):
    return _shown(cross_rules.repeated_records(history(spark, sf_dir)))


def q_repeated_files(spark, sf_dir):
    return _shown(cross_rules.repeated_files(history(spark, sf_dir))).drop("detail")


def q_rule_summary(spark, sf_dir):
    return cross_rules.summary(cross_rules.all_rules(k1_records(spark, sf_dir)))


def q_upsert(spark, sf_dir):
    rows = history(spark, sf_dir)
    stored, new = rows.where("ingested_at < '2025-01-02'"), rows.where("ingested_at > '2025-01-02'")
    return files.upsert(stored, new).select(*KEY, "run_id", "distributions", "interest_income")


def _in_batches(spark, sf_dir, judged):
    """A record store, and its rules if they are to be ``judged``, after two batches:
    records of which some are missing or wrong, then those that put them right."""
    k1 = _kept(spark, sf_dir)
    last = F.substring("partner_tin", -1, 1)
    stamp = lambda df, v: df.withColumns({"run_id": F.concat_ws("/", *KEY, F.lit(str(v))), "ingested_at": F.lit(f"2025-01-0{v}T00:00:00")}).select(
        *(F.col(f.name) if f.name in [*k1.columns, "run_id", "ingested_at"] else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields)
    )
    wrong = k1.where(last != "3").withColumns({
        "partner_share_percentage": F.when(last == "7", 99.0).otherwise(F.col("partner_share_percentage")), "distributions": F.when(last == "7", None).otherwise(F.col("distributions")),
    })
    root = f"{shared_dir(spark)}/ledgerloom/rules-{uuid.uuid4().hex}"
    records = RecordStore(spark, f"{root}/records")
    book = RuleBook(spark, f"{root}/rules", records) if judged else None
    for batch in (stamp(wrong, 1), stamp(k1.where(last.isin("3", "7")), 2)):
        if judged:
            upsert_and_judge(records, book, batch)
        else:
            records.upsert(batch)
    return records, book


def q_record_store(spark, sf_dir):
    records, _ = _in_batches(spark, sf_dir, judged=False)
    return records.read().where("tax_year IN ('1995', '1996')").select(*KEY, F.element_at(F.split("run_id", "/"), -1).alias("batch"), "distributions", "partner_share_percentage")


def q_incremental_rules(spark, sf_dir):
    _, book = _in_batches(spark, sf_dir, judged=True)
    found = cross_rules.published(book.results().where("category <> 'C'"))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"))


def q_term_matches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.substring("text", 1, 40).alias("term"))
    found = terms.term_spans(docs, passages)
    return found.groupBy("doc_id").agg(F.countDistinct("term").alias("terms"), F.min("start").alias("first_at"))


def q_partnerships(spark, sf_dir):
    return reports.partnerships(k1_records(spark, sf_dir))


def q_overview(spark, sf_dir):
    return reports.overview(reports.with_analysis(k1_records(spark, sf_dir)))


def q_summary_rows(spark, sf_dir):
    rows = reports.with_analysis(k1_records(spark, sf_dir))
    money = [f for f in SUMMARY_FIELDS if f not in ("tax_year", "partnership_name", "partner_type")]
    # cents as text, alike in every engine
    rows = rows.withColumns({f: F.round(F.col(f) * 100, 0).cast("long") for f in money})
    return files.summary_rows(rows, KEY[:2]).select(*KEY[:2], "position", "field", "value")


def q_populated(spark, sf_dir):
    return reports.populated_fields(k1_records(spark, sf_dir)).select(*KEY, "populated")


def q_partner_class(spark, sf_dir):
    return k1_records(spark, sf_dir).groupBy(partner_class(F.col("partner_type")).alias("class"), "tax_year").agg(F.count("*").alias("n"), F.min("capital_account_ending").alias("least"), F.max("capital_account_ending").alias("most"))


def q_capital_bars(spark, sf_dir):
    return reports.capital_bars(k1_records(spark, sf_dir)).select(*KEY, F.round("beginning_share", 6).alias("beginning_share"))


def q_scoped(spark, sf_dir):
    results = cross_rules.percent_rules(cross_rules.totals(k1_records(spark, sf_dir)))
    return reports.scoped_results(results, "07-0000065").groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"))


def q_scoped_summary(spark, sf_dir):
    records = _kept(spark, sf_dir)
    results = cross_rules.all_rules(records)
    return reports.scoped_summary(results, reports.partnerships(records), "07-0000065", 5)


def q_published_ids(spark, sf_dir):
    results = cross_rules.published(cross_rules.all_rules(k1_records(spark, sf_dir)))
    return results.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"))


def q_scope(spark, sf_dir):
    return cross_rules.scope(k1_records(spark, sf_dir), "07-0000065", "1995").select(*KEY, "distributions")


def q_present_fields(spark, sf_dir):
    return reports.present_fields(k1_records(spark, sf_dir), KEY).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("partnership_ein").alias("partnerships"))


def q_recognition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    readings = docs.select(F.col("source").alias("engine"), F.col("lang").alias("profile"), "text", (F.col("doc_id") % 7).cast("double").alias("seconds"))
    truth = spark.createDataFrame([("the ",), ("@example",), ("no such words",)], "expected string")
    return reports.recognition_scores(readings, truth).withColumn("accuracy", F.round("accuracy", 6))


def q_batch_outcome(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reports.batch_outcome(docs.select((F.length("text") > 300).alias("succeeded"), (F.col("doc_id") % 7).cast("double").alias("seconds"))).withColumn("seconds_a_document", F.round("seconds_a_document", 6))


def q_report_list(spark, sf_dir):
    records = reports.with_analysis(k1_records(spark, sf_dir)).withColumns({"report_dir": F.concat_ws("/", *KEY), "status": F.lit(None).cast("string")})
    cents = {c: F.round(F.col(c) * 100, 0).cast("long") for c in ("income", "capital_gains")}
    return dashboard.report_list(records).withColumns(cents)


def q_masked(spark, sf_dir):
    return k1_records(spark, sf_dir).select(
        *KEY, mask_ein(F.col("partnership_ein")).alias("ein_shown"), mask_tin(F.col("partner_tin")).alias("tin_shown"), preview(F.col("partnership_name"), 8).alias("name_shown"),
        files.document_key(F.col("partnership_name"), F.col("tax_year"), suffix=".json").alias("storage_key"),
    )


def q_pages(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return reports.stitch_pages(talk.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("page"), "text")).select("run_id", "full_text", "chars")


def _letters(spark, sf_dir):
    """A text for each record, with the numbers a letter would hold; every third
    partner is named by a second partnership number."""
    tin = F.when(F.substring("partner_tin", -1, 1).isin("0", "3", "6", "9"), F.concat(F.substring("partner_tin", 1, 2), F.lit("-"), F.substring(F.replace("partner_tin", F.lit("-"), F.lit("")), 3, 7))).otherwise(F.col("partner_tin"))
    text = F.concat(F.lit("Partnership "), "partnership_ein", F.lit(" of partner "), tin, F.lit("; again "), "partnership_ein", F.lit(", "), "tax_year")
    return k1_records(spark, sf_dir).withColumn("text", text).withColumn("run_id", F.concat_ws("/", *KEY))


def q_identifiers(spark, sf_dir):
    rows = spans.sanitize(_letters(spark, sf_dir))
    return rows.select("run_id", "sanitized_text", spans.resolve_identifiers(F.col("mapping")).alias("who")).select("run_id", "sanitized_text", "who.*")


def q_restored(spark, sf_dir):
    """Sanitized texts read back through the mapping of their run."""
    letters = spans.sanitize(_letters(spark, sf_dir)).withColumn("report_dir", F.col("tax_year"))
    # the texts and their mappings are two readers of one table
    rows = stored(letters.select("run_id", "report_dir", "partnership_ein", "sanitized_text", "mapping"), "sanitized")
    own = rows.where("partnership_ein < '15'").select("run_id", "mapping")
    reports_ = dashboard.resolve_mappings(rows.select("run_id", "report_dir", "sanitized_text"), own, own.limit(0).withColumnRenamed("run_id", "report_dir"))
    return dashboard.resolved(reports_, ["sanitized_text"]).select("run_id", F.col("sanitized_text").alias("shown"))


def q_result_documents(spark, sf_dir):
    letters = stored(reports.with_analysis(_letters(spark, sf_dir)), "letters")
    statuses = checks.with_status(checks.report(letters)).select("run_id", "status", "critical_count", "warning_count", "advisory_count")
    found = spans.span_rows(letters, "run_id").select("run_id", "s.entity_type")
    rules = cross_rules.percent_rules(cross_rules.totals(letters)).agg(F.count("*").alias("total"))
    documents = results.run_documents(letters, statuses, results.entity_totals(found), rules=rules, generated_at="2025-01-01T00:00:00Z")
    return documents.select(
        "run_id", "pipeline_run.generated_at", "k1_data.distributions", F.round(F.col("financial_analysis.net_taxable_income") * 100, 0).cast("long").alias("net_cents"),
        F.col("pii_stats.total_entities_detected").alias("entities"), results.by_count(F.col("pii_stats.entity_counts"))[0]["entity_type"].alias("most_frequent"),
        "validation.overall_status", "validation.deterministic.critical_count", F.col("validation.ai").isNull().alias("unjudged"), "output_files.full_report",
        F.get_json_object("cross_partner_validation", "$.total").cast("long").alias("rules_total"),
    )


def q_rule_document(spark, sf_dir):
    records = _kept(spark, sf_dir)
    one = dashboard.rule_document(cross_rules.percent_rules(cross_rules.totals(records)), reports.partnerships(records))
    return one.select("total", "passed", "failed", F.size("partnerships").alias("partnerships"), F.size("failures").alias("failures"), F.element_at("partnerships", 1)["k1_count"].alias("first_k1_count"))


def q_score_bands(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spans.span_rows(docs, "doc_id").select("doc_id", "s.*")
    shown = dashboard.score_bands(found, 0.7)
    return shown.groupBy("entity_type", "percent", band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def q_shown_values(spark, sf_dir):
    """Small values as a page shows and reads them."""
    at = F.make_timestamp(F.col("tax_year").cast("int"), F.lit(3), F.lit(4), F.lit(5), F.lit(6), F.lit(7))
    folder = run_folder(slug(F.col("partnership_name")), at)
    whole = F.round("ordinary_business_income", 0)
    rows = k1_records(spark, sf_dir)
    return rows.select(
        *KEY, folder.alias("folder"), folder_title(folder).alias("title"), short_time(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("minute"),
        is_number(F.col("partner_tin")).alias("tin_number"), is_number(F.col("tax_year")).alias("year_number"), parse_amount(currency(whole)).cast("double").alias("income"),
        results.bar_scale("partner_share_percentage", "qbi_deduction").alias("scale"),
    )


def q_form_fields(spark, sf_dir):
    rows = dashboard.form_fields(k1_records(spark, sf_dir), {"name": "partnership_name", "type": "partner_type", "qualified": "qualified_dividends", "qbi": "qbi_deduction"})
    return rows.groupBy(F.array_join(F.sort_array(F.map_keys("form")), ",").alias("fields")).agg(F.count("*").alias("n"))


def q_ingest_status(spark, sf_dir):
    blank = F.when(F.substring("partner_tin", -1, 1) == "1", F.lit(" ")).otherwise(F.col("partner_tin"))
    return files.with_ingest_status(k1_records(spark, sf_dir).withColumn("partner_tin", blank)).groupBy("status", "reason").agg(F.count("*").alias("n"))


def q_assembled(spark, sf_dir):
    letters = stored(_letters(spark, sf_dir), "letters")
    who = letters.select("run_id", "partnership_ein", "partner_tin")
    ingested = letters.select("run_id", F.concat("run_id", F.lit(".pdf")).alias("source_pdf_name"), F.sha2("text", 256).alias("pdf_sha256"))
    rows = checks.report(letters).select("run_id", "critical_count", "warning_count")
    judged = letters.where(F.col("tax_year") > "1995").select("run_id", F.lit(0.5).alias("ai_coherence_score"))
    fields = letters.drop("partnership_ein", "partner_tin", "text")
    return files.assemble_records(ingested, fields, who, rows, judged).select(*KEY, "source_pdf_name", "pdf_sha256", "distributions", "deterministic_critical_count", "deterministic_passed", "ai_coherence_score")


def q_failed_critical(spark, sf_dir):
    rows = checks.check_rows(k1_records(spark, sf_dir), KEY)
    return reports.failed_checks(rows, "critical").select(*KEY, "rule_id")


def q_entity_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spans.span_rows(docs, "doc_id")
    return found.groupBy(F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def q_sanitized(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans.sanitize(docs).select("doc_id", "sanitized_text", "entities_total", "entities_redacted")


def q_entity_modes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    modes = {"patterns": ["EIN", "EMAIL_ADDRESS", "PHONE_NUMBER"], "zero_shot": ["CREDIT_CARD", "IP_ADDRESS", "PHONE_NUMBER"], "combined": list(spans.RECOGNISERS)}
    # a text is searched once; each type's spans count for the modes that know it
    found = spans.span_rows(docs).select("s.entity_type")
    known = F.array_compact(F.array(*(F.when(F.col("entity_type").isin(t), F.lit(m)) for m, t in modes.items())))
    return reports.comparison(found.select(F.explode(known).alias("mode"), "entity_type"))


def q_minified(spark, sf_dir):
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return minify(docs, "text", aggressive=True).select("doc_id", "minified")


def q_recall(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    truth = spark.createDataFrame([("article", "the "), ("license", "Apache License"), ("mail", "@example"), ("none", "no such words")], "label string, expected string")
    return reports.recall(docs, truth)


def q_similarity(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return names.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.round(similarity(F.col("s_name"), F.concat(F.lit("SUPPLIER "), "n_name")), 6).alias("sim"), slug(F.col("s_name")).alias("slug"))


QUERIES = {
    "validation_checks": q_checks, "report_status": q_report_status, "rules_a1_a2": q_percent_rules, "rule_a3": q_allocation,
    "rule_a4": q_capital_proportion, "rule_a5": q_names, "rule_d1": q_distributions, "rule_d4": q_self_employment,
    "rules_b1_b3_b4": q_pair_rules, "rules_c1_c2": q_repeated_records, "rule_c3": q_repeated_files, "rule_summary": q_rule_summary,
    "record_upsert": q_upsert, "record_store": q_record_store, "incremental_rules": q_incremental_rules, "term_matches": q_term_matches, "partnerships": q_partnerships, "overview_totals": q_overview, "summary_export": q_summary_rows,
    "populated_fields": q_populated, "partner_classes": q_partner_class, "capital_bars": q_capital_bars, "scoped_results": q_scoped,
    "failed_critical": q_failed_critical, "entity_counts": q_entity_counts, "sanitized_text": q_sanitized, "entity_modes": q_entity_modes,
    "minified_text": q_minified, "ground_truth_recall": q_recall, "name_similarity": q_similarity,
    "scoped_summary": q_scoped_summary, "published_rule_ids": q_published_ids, "scoped_records": q_scope, "present_fields": q_present_fields,
    "recognition_scores": q_recognition, "batch_outcome": q_batch_outcome, "report_list": q_report_list, "masked_names": q_masked,
    "stitched_pages": q_pages, "resolved_identifiers": q_identifiers, "restored_text": q_restored, "result_documents": q_result_documents,
    "rule_document": q_rule_document, "score_bands": q_score_bands, "shown_values": q_shown_values, "form_fields": q_form_fields,
    "ingest_status": q_ingest_status, "assembled_records": q_assembled,
}

# --- SQL -------------------------------------------------------------------

# The checks, written out as what must hold; the operators state what must not.
_HOLDS = {
    "ARITH-001": ("critical", "qualified_dividends IS NULL OR ordinary_dividends IS NULL OR ordinary_dividends >= qualified_dividends"),
    "ARITH-002": ("critical", "partner_share_percentage IS NULL OR (0 < partner_share_percentage AND partner_share_percentage <= 100)"),
    **{f"ARITH-003-{f}": ("critical", f"{f} IS NULL OR {f} >= 0") for f in (
        "ordinary_dividends", "qualified_dividends", "guaranteed_payments", "section_179_deduction", "foreign_taxes_paid", "distributions")},
    "ARITH-005": ("advisory", "capital_account_beginning IS NULL OR capital_account_ending IS NULL OR abs(capital_account_ending - capital_account_beginning - (inc - dist)) <= 2 * greatest(1, abs(capital_account_ending), abs(capital_account_beginning))"),
    "ARITH-006": ("warning", "NOT gp OR self_employment_earnings IS NULL OR ordinary_business_income IS NULL OR abs(self_employment_earnings - (ordinary_business_income + guar)) <= greatest(1000, 0.15 * abs(ordinary_business_income + guar))"),
    "ARITH-007": ("warning", "NOT lp OR self_employment_earnings IS NULL OR guaranteed_payments IS NULL OR self_employment_earnings <= guaranteed_payments + 100"),
    "ARITH-008": ("advisory", "qbi_deduction IS NULL OR ordinary_business_income IS NULL OR abs(qbi_deduction - (ordinary_business_income - guar)) <= greatest(5000, 0.25 * abs(ordinary_business_income))"),
    "ARITH-009": ("critical", "coalesce(qualified_dividends, 0) <= 0 OR ordinary_dividends IS NOT NULL"),
    "ARITH-010": ("warning", "coalesce(foreign_taxes_paid, 0) <= 0 OR some_income"),
    "ARITH-011": ("advisory", "coalesce(section_179_deduction, 0) <= 0 OR coalesce(ordinary_business_income, 0) <= 0 OR section_179_deduction <= 5 * ordinary_business_income"),
    "FC-001": ("critical", "tax_year IS NOT NULL AND regexp_full_match(tax_year, '[0-9]{4}')"),
    "FC-003": ("critical", "partnership_name IS NOT NULL AND length(trim(partnership_name)) > 0"),
    "FC-004": ("critical", "partner_type IS NOT NULL AND lower(trim(partner_type)) IN ('general partner', 'limited partner', 'llc member-manager', 'llc member', 'general partner or llc member-manager', 'limited partner or other llc member')"),
    "FC-010": ("critical", "partner_share_percentage IS NULL OR partner_share_percentage BETWEEN 0 AND 100"),
    **{f"FC-021-{f}": ("critical", f"{f} IS NULL OR {f} >= 0") for f in (
        "guaranteed_payments", "interest_income", "ordinary_dividends", "qualified_dividends", "section_179_deduction", "foreign_taxes_paid", "distributions")},
    "FC-031": ("critical", "section_179_deduction IS NULL OR section_179_deduction <= greatest(0, CASE tax_year WHEN '2020' THEN 1040000 WHEN '2021' THEN 1050000 WHEN '2022' THEN 1080000 WHEN '2023' THEN 1160000 WHEN '2024' THEN 1220000 ELSE 1250000 END)"),
    "FC-032": ("warning", "NOT lp OR self_employment_earnings IS NULL OR guaranteed_payments IS NULL OR abs(self_employment_earnings) <= 1.1 * abs(guaranteed_payments)"),
    **{f"FC-040-{f}": ("advisory", f"{f} IS NULL OR {f} BETWEEN {lo} AND {hi}") for f, lo, hi in (
        ("ordinary_business_income", -50000000, 100000000), ("rental_real_estate_income", -20000000, 20000000), ("guaranteed_payments", 0, 5000000),
        ("interest_income", 0, 10000000), ("ordinary_dividends", 0, 50000000), ("qualified_dividends", 0, 50000000),
        ("short_term_capital_gains", -50000000, 100000000), ("long_term_capital_gains", -50000000, 500000000), ("section_179_deduction", 0, 1500000),
        ("self_employment_earnings", -10000000, 10000000), ("foreign_taxes_paid", 0, 1000000), ("distributions", 0, 100000000),
        ("qbi_deduction", -50000000, 100000000), ("capital_account_beginning", -50000000, 500000000), ("capital_account_ending", -50000000, 500000000))},
    "CAP-001": ("warning", "capital_account_beginning IS NULL OR capital_account_ending IS NULL OR abs(capital_account_ending - (capital_account_beginning + inc - coalesce(section_179_deduction, 0) - coalesce(foreign_taxes_paid, 0) - dist)) <= greatest(10000, 0.25 * abs(capital_account_ending))"),
}
_CHECKED = """, kk AS (SELECT *, coalesce(guaranteed_payments, 0) AS guar, coalesce(distributions, 0) AS dist,
    coalesce(lower(partner_type) LIKE '%general%', false) AS gp, coalesce(lower(partner_type) LIKE '%limited%', false) AS lp,
    coalesce(ordinary_business_income, 0) + coalesce(rental_real_estate_income, 0) + coalesce(guaranteed_payments, 0) + coalesce(interest_income, 0)
      + coalesce(ordinary_dividends, 0) + coalesce(short_term_capital_gains, 0) + coalesce(long_term_capital_gains, 0) AS inc,
    coalesce(greatest(abs(ordinary_business_income), abs(rental_real_estate_income), abs(guaranteed_payments), abs(interest_income),
      abs(ordinary_dividends), abs(short_term_capital_gains), abs(long_term_capital_gains)), 0) > 0 AS some_income FROM k1)"""
_CHECK_ROWS = ", ".join(f"('{rule}', '{severity}', {holds})" for rule, (severity, holds) in _HOLDS.items())
_PASSED = lambda wanted: " + ".join(f"CAST(NOT ({holds}) AS INT)" for severity, holds in _HOLDS.values() if severity == wanted)
_STATUS = f"""SELECT partnership_ein, partner_tin, tax_year, {_PASSED("critical")} AS critical_count, {_PASSED("warning")} AS warning_count,
  {_PASSED("advisory")} AS advisory_count FROM kk"""
_GROUPED = f"""
, g AS (
  SELECT *, CAST(partner_share_percentage AS DECIMAL(9,5)) AS pct, count(*) OVER g AS members,
    sum(CAST(partner_share_percentage AS DECIMAL(9,5))) OVER g AS sum_pct,
    count(CASE WHEN partner_share_percentage > 0 THEN 1 END) OVER g AS n_valid,
    sum(CASE WHEN partner_share_percentage > 0 THEN CAST(partner_share_percentage AS DECIMAL(9,5)) END) OVER g AS sum_valid,
    sum(CASE WHEN partner_share_percentage > 0 THEN CAST(capital_account_ending AS DECIMAL(18,2)) END) OVER g AS sum_end,
    coalesce(sum(CAST(distributions AS DECIMAL(18,2))) OVER g, 0) AS sum_dist,
    {" + ".join(f"coalesce(sum(CAST({f} AS DECIMAL(18,2))) OVER g, 0)" for f in INCOME6)} AS sum_income
  FROM k1 WINDOW g AS (PARTITION BY partnership_ein, tax_year)
)"""
_COLS = "partnership_ein, tax_year"
_NULLS = "CAST(NULL AS VARCHAR) AS partner_tin, CAST(NULL AS VARCHAR) AS detail"


def _bad_or_pass(rule: str, bad: str, groups: str, threshold: str) -> str:
    """Violations, and a passing row for each group without one."""
    return f""", bad AS ({bad}), grp AS ({groups})
SELECT '{rule}' AS rule_id, false AS passed, {_COLS}, partner_tin, detail, CAST({threshold} AS DOUBLE) AS threshold FROM bad
UNION ALL SELECT '{rule}', true, {_COLS}, NULL, NULL, NULL FROM grp WHERE ({_COLS}) NOT IN (SELECT ({_COLS}) FROM bad)"""


_A1A2 = f"""{_GROUPED} SELECT rule_id, CASE WHEN rule_id = 'A1' THEN sum_pct <= 100 ELSE sum_pct >= 100 END AS passed, {_COLS}, {_NULLS},
  round(CAST(sum_pct AS DOUBLE), 4) AS observed, CAST(100 AS DOUBLE) AS threshold
FROM (SELECT DISTINCT {_COLS}, members, sum_pct FROM g), (VALUES ('A1'), ('A2')) r(rule_id) WHERE rule_id = 'A2' OR members >= 2"""
_LONG = " UNION ALL ".join(f"SELECT {_COLS}, partner_tin, pct, sum_valid, '{f}' AS detail, CAST({f} AS DECIMAL(18,2)) AS v FROM g WHERE pct > 0 AND members >= 2 AND n_valid >= 2 AND {f} IS NOT NULL" for f in INCOME6)
_A3 = _GROUPED + f", l AS (SELECT *, count(*) OVER w AS n, sum(v) OVER w AS total FROM ({_LONG}) WINDOW w AS (PARTITION BY {_COLS}, detail))" + _bad_or_pass(
    "A3",
    "SELECT * FROM l WHERE n >= 2 AND total <> 0 AND abs(CAST(v AS DOUBLE) / CAST(total AS DOUBLE) - CAST(pct AS DOUBLE) / CAST(sum_valid AS DOUBLE)) / (CAST(pct AS DOUBLE) / CAST(sum_valid AS DOUBLE)) > 0.10",
    f"SELECT DISTINCT {_COLS} FROM g WHERE members >= 2 AND n_valid >= 2", "0.1")
_A4 = _GROUPED + _bad_or_pass(
    "A4",
    "SELECT *, CAST(NULL AS VARCHAR) AS detail FROM g WHERE n_valid >= 2 AND members >= 2 AND pct > 0 AND sum_end <> 0 AND abs(CAST(CAST(capital_account_ending AS DECIMAL(18,2)) AS DOUBLE) / CAST(sum_end AS DOUBLE) - CAST(pct AS DOUBLE) / CAST(sum_valid AS DOUBLE)) > 0.15",
    f"SELECT DISTINCT {_COLS} FROM g WHERE members >= 2 AND n_valid >= 2 AND sum_end <> 0", "0.15")
_D1 = f"""{_GROUPED} SELECT DISTINCT 'D1' AS rule_id, NOT (sum_income > 0 AND sum_dist > 3 * sum_income) AS passed, {_COLS}, {_NULLS},
  round(CAST(sum_dist AS DOUBLE), 4) AS observed, round(CAST(3 * sum_income AS DOUBLE), 4) AS threshold FROM g WHERE members >= 2"""
_D4 = _GROUPED + """, bad AS (SELECT *, CASE WHEN lower(partner_type) LIKE '%general%' AND ordinary_business_income > 0 AND self_employment_earnings IS NULL THEN 'general'
    WHEN lower(partner_type) LIKE '%limited%' AND self_employment_earnings > 0 AND coalesce(guaranteed_payments, 0) = 0 THEN 'limited' END AS detail FROM g WHERE members >= 2)
SELECT 'D4' AS rule_id, false AS passed, partnership_ein, tax_year, partner_tin, detail, CAST(NULL AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS threshold FROM bad WHERE detail IS NOT NULL
UNION ALL SELECT 'D4', true, partnership_ein, tax_year, NULL, NULL, NULL, NULL FROM bad GROUP BY partnership_ein, tax_year HAVING count(detail) = 0"""
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: lower(substr({0}, i, 2))))"


def _sim(a: str, b: str) -> str:
    x, y = _GRAMS.format(a), _GRAMS.format(b)
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN lower({a}) = lower({b}) THEN 1.0 ELSE {both} / CAST(len({x}) + len({y}) - {both} AS DOUBLE) END"


_A5 = f"""{_GROUPED}, n AS (SELECT DISTINCT {_COLS}, partnership_name AS nm FROM g WHERE members >= 2),
p AS (SELECT a.partnership_ein, a.tax_year, min({_sim("a.nm", "b.nm")}) AS worst FROM n a JOIN n b ON a.partnership_ein = b.partnership_ein AND a.tax_year = b.tax_year AND a.nm < b.nm GROUP BY 1, 2)
SELECT 'A5' AS rule_id, coalesce(worst >= 0.85, true) AS passed, partnership_ein, tax_year, {_NULLS}, round(CAST(worst AS DOUBLE), 4) AS observed, CAST(0.85 AS DOUBLE) AS threshold
FROM (SELECT DISTINCT {_COLS} FROM g WHERE members >= 2) LEFT JOIN p USING ({_COLS})"""
_PAIRS = """, pr AS (SELECT b.*, a.capital_account_ending AS prior_end, a.partnership_name AS prior_name, a.partner_type AS prior_type
  FROM k1 a JOIN k1 b ON a.partnership_ein = b.partnership_ein AND a.partner_tin = b.partner_tin AND CAST(a.tax_year AS INT) + 1 = CAST(b.tax_year AS INT))"""
_B = f"""{_PAIRS}
SELECT 'B1' AS rule_id, abs(CAST(prior_end AS DECIMAL(18,2)) - CAST(capital_account_beginning AS DECIMAL(18,2))) < 0.01 AS passed, {_COLS}, partner_tin, CAST(NULL AS VARCHAR) AS detail,
  round(CAST(abs(CAST(prior_end AS DECIMAL(18,2)) - CAST(capital_account_beginning AS DECIMAL(18,2))) AS DOUBLE), 4) AS observed, CAST(0.01 AS DOUBLE) AS threshold FROM pr
UNION ALL SELECT 'B3', prior_name = partnership_name OR {_sim("prior_name", "partnership_name")} >= 0.85, {_COLS}, NULL, NULL, round({_sim("prior_name", "partnership_name")}, 4), 0.85 FROM pr
UNION ALL SELECT 'B4', prior_type = partner_type, {_COLS}, partner_tin, NULL, NULL, NULL FROM pr"""
_HISTORY = """, h AS (
  SELECT *, 1 AS v FROM k1 UNION ALL SELECT *, 2 FROM k1 WHERE right(partner_tin, 1) = '3'
  UNION ALL SELECT * REPLACE (distributions + 100 AS distributions, CAST(NULL AS DOUBLE) AS interest_income), 3 FROM k1 WHERE right(partner_tin, 1) = '7')"""
_RUN = "partnership_ein || '/' || partner_tin || '/' || tax_year || '/' || CAST(v AS VARCHAR)"
_SAME = " AND ".join(f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in AMOUNT_FIELDS)
_DIFFER = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in AMOUNT_FIELDS) + "], lambda x: x IS NOT NULL), ',')"
_COUNT = " + ".join(f"CAST(a.{f} IS DISTINCT FROM b.{f} AS INT)" for f in AMOUNT_FIELDS)
_C = f"""{_HISTORY}, later AS (SELECT b.partnership_ein, b.tax_year, b.partner_tin, {_DIFFER} AS differ, {_COUNT} AS n
  FROM h a JOIN h b ON a.partnership_ein = b.partnership_ein AND a.partner_tin = b.partner_tin AND a.tax_year = b.tax_year AND a.v = 1 AND b.v > 1),
grp AS (SELECT {_COLS} FROM h GROUP BY ALL HAVING count(*) >= 2)
SELECT 'C1' AS rule_id, false AS passed, {_COLS}, partner_tin, CAST(NULL AS VARCHAR) AS detail, CAST(n AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS threshold FROM later WHERE n = 0
UNION ALL SELECT 'C1', true, {_COLS}, NULL, NULL, NULL, NULL FROM grp WHERE ({_COLS}) NOT IN (SELECT ({_COLS}) FROM later WHERE n = 0)
UNION ALL SELECT 'C2', false, {_COLS}, partner_tin, differ, CAST(n AS DOUBLE), NULL FROM later WHERE n > 0
UNION ALL SELECT 'C2', true, {_COLS}, NULL, NULL, NULL, NULL FROM grp WHERE ({_COLS}) NOT IN (SELECT ({_COLS}) FROM later WHERE n > 0)"""
_TOTALS = " + ".join(f"coalesce({f}, 0)" for f in INCOME7)
_ANALYSIS = f", an AS (SELECT *, 0.0 + {_TOTALS} AS total_income, 0.0 + " + " + ".join(f"coalesce({f}, 0)" for f in reports.DEDUCTIONS) + " AS total_deductions FROM k1), an2 AS (SELECT *, total_income - total_deductions AS net_taxable_income FROM an)"
_VALUE = lambda f: f if f in SUMMARY_FIELDS[:3] else f"CAST(CAST(round({f} * 100, 0) AS BIGINT) AS VARCHAR)"
_EXPORT = ", ".join(f"({i}, '{f}', coalesce({_VALUE(f)}, ''))" for i, f in enumerate(SUMMARY_FIELDS))
_FIND = " UNION ALL ".join(f"SELECT '{t}' AS entity_type, sum(n) AS n, count(*) AS docs FROM (SELECT len(regexp_extract_all(text, '{rx}')) AS n FROM documents) WHERE n > 0 HAVING count(*) > 0" for t, (rx, _) in spans.RECOGNISERS.items())

_SEVERITY = "CASE WHEN rule_id IN ('A1', 'B1', 'C1') THEN 'critical' WHEN rule_id = 'A2' THEN 'advisory' ELSE 'warning' END"
_ALL_RULES = " UNION ALL ".join(f"SELECT rule_id, passed, partnership_ein FROM ({K1_SQL} {part})" for part in (_A1A2, _A3, _A4, _A5, _D1, _D4, _B))
_COUNTS = """count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks,
  count(*) FILTER (NOT passed AND severity = 'critical') AS critical_failures, count(*) FILTER (NOT passed AND severity = 'warning') AS warning_failures,
  count(*) FILTER (NOT passed AND severity = 'advisory') AS advisory_failures"""
_MODES = {"patterns": ("EIN", "EMAIL_ADDRESS", "PHONE_NUMBER"), "zero_shot": ("CREDIT_CARD", "IP_ADDRESS", "PHONE_NUMBER"), "combined": tuple(spans.RECOGNISERS)}
_MODE_SUMS = ", ".join(f"CAST(sum(CASE WHEN entity_type IN {types} THEN n ELSE 0 END) AS BIGINT) AS {mode}" for mode, types in _MODES.items())
_NAMES = " ".join(f"WHEN '{short}' THEN '{long}'" for short, long in cross_rules.PUBLISHED.items())

_LETTERS = K1_SQL + """, lt AS (SELECT *, partnership_ein || '/' || partner_tin || '/' || tax_year AS run_id,
    CASE WHEN right(partner_tin, 1) IN ('0', '3', '6', '9') THEN left(partner_tin, 2) || '-' || substr(replace(partner_tin, '-', ''), 3, 7) ELSE partner_tin END AS shown_tin FROM k1)"""
_LETTER = "'Partnership ' || partnership_ein || ' of partner ' || shown_tin || '; again ' || partnership_ein || ', ' || tax_year"
_HIDDEN = "'Partnership <EIN_1> of partner ' || CASE WHEN shown_tin = partner_tin THEN '<US_SSN_1>' WHEN shown_tin = partnership_ein THEN '<EIN_1>' ELSE '<EIN_2>' END || '; again <EIN_1>, ' || tax_year"
_RULE_ROWS = f"({K1_SQL} {_A1A2})"

ORACLES = {
    "resolved_identifiers": f"{_LETTERS} SELECT run_id, {_HIDDEN} AS sanitized_text, partnership_ein, nullif(shown_tin, partnership_ein) AS partner_tin FROM lt",
    "restored_text": f"{_LETTERS} SELECT run_id, CASE WHEN partnership_ein < '15' THEN {_LETTER} ELSE {_HIDDEN} END AS shown FROM lt",
    "result_documents": f"""SELECT run_id, '2025-01-01T00:00:00Z' AS generated_at, distributions, CAST(round(net_taxable_income * 100, 0) AS BIGINT) AS net_cents, CAST(3 AS BIGINT) AS entities,
      'EIN' AS most_frequent, CASE WHEN critical_count > 0 THEN 'failed' WHEN warning_count > 0 THEN 'warnings' ELSE 'passed' END AS overall_status, critical_count, true AS unjudged,
      'output/' || run_id || '/k1_report.json' AS full_report, (SELECT count(*) FROM {_RULE_ROWS}) AS rules_total
      FROM ({K1_SQL}{_ANALYSIS} SELECT partnership_ein || '/' || partner_tin || '/' || tax_year AS run_id, distributions, net_taxable_income FROM an2)
      JOIN ({K1_SQL}{_CHECKED}, st AS ({_STATUS}) SELECT partnership_ein || '/' || partner_tin || '/' || tax_year AS run_id, critical_count, warning_count FROM st) USING (run_id)""",
    "rule_document": f"""SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, any_value(p) AS partnerships, CAST(count(*) FILTER (NOT passed) AS INT) AS failures,
      any_value(first_k1_count) AS first_k1_count FROM {_RULE_ROWS}, (SELECT CAST(count(*) AS INT) AS p, arg_min(n, {{'e': partnership_ein, 'y': tax_year}}) AS first_k1_count FROM ({K1_SQL} SELECT partnership_ein, tax_year, count(*) AS n FROM k1 GROUP BY ALL))""",
    "score_bands": "SELECT entity_type, CAST(round(score * 100) AS INT) AS percent, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS entity_type, CAST({score} AS DOUBLE) AS score, len(regexp_extract_all(text, '{rx}')) AS n FROM documents" for t, (rx, score) in spans.RECOGNISERS.items()) + ") WHERE score >= 0.7 AND n > 0 GROUP BY ALL",
    "shown_values": K1_SQL + """ SELECT partnership_ein, partner_tin, tax_year, regexp_replace(lower(partnership_name), '[^a-z0-9]+', '_', 'g') || '_' || tax_year || '0304_050607' AS folder,
      regexp_replace(lower(partnership_name), '[^a-z0-9]+', ' ', 'g') AS title, tax_year || '-03-04 05:06' AS minute, false AS tin_number, true AS year_number,
      round(ordinary_business_income, 0) AS income, greatest(1.0, coalesce(partner_share_percentage, 0), coalesce(qbi_deduction, 0)) AS scale FROM k1""",
    "form_fields": K1_SQL + " SELECT array_to_string(list_filter(['name', CASE WHEN qbi_deduction IS NOT NULL THEN 'qbi' END, CASE WHEN qualified_dividends IS NOT NULL THEN 'qualified' END, 'type'], lambda x: x IS NOT NULL), ',') AS fields, count(*) AS n FROM k1 GROUP BY ALL",
    "ingest_status": K1_SQL + " SELECT CASE WHEN right(partner_tin, 1) = '1' THEN 'skipped' ELSE 'stored' END AS status, CASE WHEN right(partner_tin, 1) = '1' THEN 'missing partner_tin' END AS reason, count(*) AS n FROM k1 GROUP BY ALL",
    "assembled_records": f"""SELECT partnership_ein, partner_tin, tax_year, run_id || '.pdf' AS source_pdf_name, sha256({_LETTER}) AS pdf_sha256, distributions, critical_count AS deterministic_critical_count,
      critical_count = 0 AS deterministic_passed, CASE WHEN tax_year > '1995' THEN CAST(0.5 AS DOUBLE) END AS ai_coherence_score
      FROM ({_LETTERS} SELECT * FROM lt) JOIN ({K1_SQL}{_CHECKED}, st AS ({_STATUS}) SELECT partnership_ein, partner_tin, tax_year, critical_count FROM st) USING (partnership_ein, partner_tin, tax_year)""",
    "rule_summary": f"SELECT {_COUNTS} FROM (SELECT *, {_SEVERITY} AS severity FROM ({_ALL_RULES}))",
    "scoped_summary": f"""SELECT {_COUNTS}, coalesce(any_value(p), 0) AS partnerships, CAST(CASE WHEN any_value(p) > 1 THEN 5 ELSE 0 END AS BIGINT) AS year_pairs_checked
      FROM (SELECT *, {_SEVERITY} AS severity FROM ({_ALL_RULES})), ({K1_SQL} SELECT count(DISTINCT tax_year) AS p FROM k1 WHERE partnership_ein = '07-0000065') WHERE partnership_ein = '07-0000065'""",
    "published_rule_ids": f"SELECT CASE rule_id {_NAMES} END AS rule_id, {_SEVERITY} AS severity, count(*) AS n, count(*) FILTER (passed) AS passed_n FROM ({_ALL_RULES}) q GROUP BY q.rule_id",
    "scoped_records": K1_SQL + " SELECT partnership_ein, partner_tin, tax_year, distributions FROM k1 WHERE partnership_ein = '07-0000065' AND tax_year = '1995'",
    "present_fields": K1_SQL + " SELECT field, count(*) AS n, count(DISTINCT partnership_ein) AS partnerships FROM k1, LATERAL (VALUES " + ", ".join(f"('{f}', {f} IS NOT NULL)" for f in RECORD.fieldNames()) + ") x(field, known) WHERE known GROUP BY field",
    "recognition_scores": "SELECT source AS engine, lang AS profile, CAST(sum(h) AS BIGINT) AS hits, 3 * count(*) AS total, CAST(sum(doc_id % 7) AS DOUBLE) AS seconds, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters, round(sum(h) / CAST(3 * count(*) AS DOUBLE), 6) AS accuracy FROM (SELECT *, CAST(contains(coalesce(text, ''), 'the ') AS INT) + CAST(contains(coalesce(text, ''), '@example') AS INT) + CAST(contains(coalesce(text, ''), 'no such words') AS INT) AS h FROM documents) GROUP BY ALL",
    "batch_outcome": "SELECT count(*) AS runs, count(*) FILTER (length(text) > 300) AS successes, count(*) FILTER (NOT coalesce(length(text) > 300, false)) AS failures, round(sum(doc_id % 7) / CAST(count(*) AS DOUBLE), 6) AS seconds_a_document FROM documents",
    "report_list": K1_SQL + _ANALYSIS + " SELECT partnership_ein || '/' || partner_tin || '/' || tax_year AS report_dir, coalesce(nullif(partnership_name, ''), 'Unknown') AS partnership_name, coalesce(nullif(tax_year, ''), '-') AS tax_year, coalesce(nullif(partner_type, ''), '-') AS partner_type, 'unknown' AS status, CAST(round(100 * coalesce(nullif(total_income, 0), ordinary_business_income, 0), 0) AS BIGINT) AS income, CAST(round(100 * (coalesce(short_term_capital_gains, 0) + coalesce(long_term_capital_gains, 0)), 0) AS BIGINT) AS capital_gains FROM an2",
    "masked_names": K1_SQL + " SELECT partnership_ein, partner_tin, tax_year, left(partnership_ein, 3) || '***' || right(partnership_ein, 3) AS ein_shown, left(partner_tin, 4) || '***' AS tin_shown, CASE WHEN length(partnership_name) > 8 THEN left(partnership_name, 8) || '...' ELSE partnership_name END AS name_shown, trim(regexp_replace(lower(partnership_name), '[^a-z0-9]+', '_', 'g'), '_') || '/' || tax_year || '.json' AS storage_key FROM k1",
    "stitched_pages": "SELECT conv_id AS run_id, string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY turn, text) AS full_text, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    "entity_modes": f"SELECT * FROM (WITH f AS ({_FIND}) SELECT entity_type, {_MODE_SUMS} FROM f GROUP BY entity_type UNION ALL SELECT 'TOTAL', {_MODE_SUMS} FROM f)",
    "validation_checks": f"{K1_SQL}{_CHECKED} SELECT partnership_ein, partner_tin, tax_year, rule_id, severity, passed FROM kk, LATERAL (VALUES {_CHECK_ROWS}) c(rule_id, severity, passed)",
    "report_status": f"{K1_SQL}{_CHECKED}, st AS ({_STATUS}) SELECT *, CASE WHEN critical_count > 0 THEN 'failed' WHEN warning_count > 0 THEN 'warnings' ELSE 'passed' END AS status FROM st",
    "rules_a1_a2": K1_SQL + _A1A2, "rule_a3": K1_SQL + _A3, "rule_a4": K1_SQL + _A4, "rule_a5": K1_SQL + _A5, "rule_d1": K1_SQL + _D1,
    "rule_d4": K1_SQL + _D4, "rules_b1_b3_b4": K1_SQL + _B, "rules_c1_c2": K1_SQL + _C,
    "rule_c3": K1_SQL + _HISTORY + " SELECT 'C3' AS rule_id, false AS passed, partnership_ein, tax_year, partner_tin, CAST(2 AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS threshold FROM h WHERE v = 2",
    "term_matches": """SELECT doc_id, count(*) AS terms, CAST(min(strpos(text, term) - 1) AS INT) AS first_at FROM documents, (SELECT DISTINCT substr(text, 1, 40) AS term FROM benchmark) t
      WHERE term <> '' AND contains(text, term) GROUP BY doc_id""",
    "record_store": K1_SQL + " SELECT partnership_ein, partner_tin, tax_year, CASE WHEN right(partner_tin, 1) IN ('3', '7') THEN '2' ELSE '1' END AS batch, distributions, partner_share_percentage FROM k1 WHERE tax_year IN ('1995', '1996')",
    "incremental_rules": f"SELECT CASE rule_id {_NAMES} END AS rule_id, {_SEVERITY} AS severity, count(*) AS n, count(*) FILTER (passed) AS passed_n FROM ({_ALL_RULES}) q GROUP BY q.rule_id",
    "record_upsert": K1_SQL + _HISTORY + f" SELECT partnership_ein, partner_tin, tax_year, {_RUN} AS run_id, distributions, interest_income FROM h QUALIFY row_number() OVER (PARTITION BY partnership_ein, partner_tin, tax_year ORDER BY v DESC) = 1",
    "partnerships": K1_SQL + " SELECT partnership_ein, tax_year, count(*) AS k1_count, arg_min(partnership_name, partner_tin) AS name FROM k1 GROUP BY ALL",
    "overview_totals": K1_SQL + _ANALYSIS + " SELECT count(*) AS reports, CAST(sum(CAST(round(total_income * 100, 0) AS BIGINT)) AS BIGINT) AS income_cents, CAST(sum(CAST(round(net_taxable_income * 100, 0) AS BIGINT)) AS BIGINT) AS net_cents FROM an2",
    "summary_export": K1_SQL + _ANALYSIS + f" SELECT partnership_ein, partner_tin, CAST(position AS INT) AS position, field, value FROM an2, LATERAL (VALUES {_EXPORT}) x(position, field, value)",
    "populated_fields": K1_SQL + " SELECT partnership_ein, partner_tin, tax_year, " + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in ["tax_year", "partnership_name", "partner_type", "partner_share_percentage", *AMOUNT_FIELDS]) + " AS populated FROM k1",
    "partner_classes": K1_SQL + " SELECT CASE WHEN partner_type LIKE 'General%' THEN 'GP' ELSE 'LP' END AS class, tax_year, count(*) AS n, min(capital_account_ending) AS least, max(capital_account_ending) AS most FROM k1 GROUP BY ALL",
    "capital_bars": K1_SQL + " SELECT partnership_ein, partner_tin, tax_year, round(abs(capital_account_beginning) / nullif(abs(capital_account_beginning) + abs(capital_account_ending - capital_account_beginning), 0), 6) AS beginning_share FROM k1",
    "scoped_results": K1_SQL + _GROUPED + ", r AS (" + _A1A2.removeprefix(_GROUPED) + ") SELECT rule_id, count(*) AS n, count(*) FILTER (passed) AS passed_n FROM r WHERE partnership_ein = '07-0000065' GROUP BY ALL",
    "failed_critical": f"{K1_SQL}{_CHECKED} SELECT partnership_ein, partner_tin, tax_year, rule_id FROM kk, LATERAL (VALUES {_CHECK_ROWS}) c(rule_id, severity, passed) WHERE NOT passed AND severity = 'critical'",
    "entity_counts": f"SELECT entity_type, CAST(n AS BIGINT) AS n, docs FROM ({_FIND})",
    "ground_truth_recall": "SELECT doc_id, count(*) FILTER (contains(text, x)) AS hits, count(*) AS total, avg(CAST(contains(text, x) AS DOUBLE)) AS accuracy FROM documents, (VALUES ('the '), ('Apache License'), ('@example'), ('no such words')) t(x) GROUP BY doc_id",
    "name_similarity": f"SELECT s_suppkey, round({_sim('s_name', 'm')}, 6) AS sim, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM (SELECT s_suppkey, s_name, 'SUPPLIER ' || n_name AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
}
