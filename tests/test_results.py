import re

from pyspark.sql import functions as F

from ledgerloom.functions.minify import apply, passes
from ledgerloom.operators import cross_rules, spans
from ledgerloom.plans import results
from ledgerloom.schemas import RECORD
from ledgerloom.sources import files

SF = "/root/testdata/sf0.001"


def runs(spark):
    fields = {f.name: None for f in RECORD.fields} | {"partnership_name": "Red Mesa", "distributions": 5.0}
    rows = [(r, 7.0, 2.0, 5.0, *fields.values()) for r in ("a_1", "b_2", "c_3")]
    schema = "run_id string, total_income double, total_deductions double, net_taxable_income double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields)
    statuses = spark.createDataFrame([("a_1", "passed", 0, 0, 0), ("b_2", "failed", 1, 0, 2)], "run_id string, status string, critical_count int, warning_count int, advisory_count int")
    return spark.createDataFrame(rows, schema), statuses


def test_documents_with_and_without_optional_parts(spark, tmp_path):
    records, statuses = runs(spark)
    found = spark.createDataFrame([("a_1", "EIN"), ("a_1", "EIN"), ("a_1", "US_SSN")], "run_id string, entity_type string")
    judged = spark.createDataFrame([("b_2", 0.9, 0.8)], "run_id string, coherence_score double, ocr_confidence double")
    rules = spark.createDataFrame([(4, 3)], "total int, passed int")
    documents = results.run_documents(records, statuses, results.entity_totals(found), judged, rules, "2025-01-01T00:00:00Z")
    got = {r.run_id: r for r in documents.collect()}
    assert sorted(got) == ["a_1", "b_2"]  # c_3 has no status
    assert got["a_1"].pii_stats.entity_counts == {"EIN": 2, "US_SSN": 1} and got["b_2"].pii_stats.total_entities_detected == 0
    assert got["a_1"].validation.ai is None and got["b_2"].validation.ai.coherence_score == 0.9
    assert got["b_2"].validation.overall_status == "failed" and got["b_2"].cross_partner_validation == '{"total":4,"passed":3}'
    bare = results.run_documents(records, statuses, rules=rules.limit(0)).collect()
    assert [(r.cross_partner_validation, r.pii_stats.entity_counts) for r in bare] == [(None, {})] * 2
    results.write_documents(documents, f"{tmp_path}/output")
    schema = "k1_data struct<partnership_name:string,distributions:double>, processing_metadata struct<report_generated_at:string>, missing string"
    listed = results.read_overview(spark, f"{tmp_path}/output", schema)
    assert [(r.directory, r.k1_data.partnership_name, r.missing) for r in listed.collect()] == [("a_1", "Red Mesa", None), ("b_2", "Red Mesa", None)]
    assert tuple(results.overview_header(listed).first()) == (2, "2025-01-01T00:00:00Z")
    assert results.overview_header(listed.limit(0)).first().total_reports == 0


def test_counts_bars_and_manifest(spark):
    one = spark.createDataFrame([({"B": 2, "A": 2, "C": 5}, None, 0, 9)], "counts map<string,bigint>, p long, q long, r long")
    row = one.select(results.by_count(one["counts"]).alias("c"), results.bar_scale("p", "q").alias("least"), results.bar_scale("p", "r").alias("most")).first()
    assert [tuple(x) for x in row.c] == [("C", 5), ("A", 2), ("B", 2)] and (row.least, row.most) == (1, 9)
    profiles = spark.createDataFrame([("profile_2.pdf", "x", None), ("profile_1.pdf", "", 3.0)], "file_name string, name string, box double")
    head = results.manifest(profiles, ["name", "box"]).first()
    assert head.total_profiles == 2 and [tuple(f) for f in head.files] == [(1, "profile_1.pdf", 1), (2, "profile_2.pdf", 1)]


def test_objects_and_selection(spark, tmp_path):
    for name, text in {"input/b.pdf": "bb", "input/a.pdf": "a", "input/archive/0.pdf": "z", "input/batch/1.pdf": "z", "input/x.json": '{\n"n": 1}'}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    every = files.list_files(spark, str(tmp_path / "input"), "*.pdf")
    name = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert name(files.select_input(every)) == ["a.pdf"] and name(files.select_input(every, "b")) == ["b.pdf"] and name(files.select_input(every.limit(0))) == []
    assert name(files.collect_files(spark, [str(tmp_path / "input"), str(tmp_path / "input/batch")], "*.pdf")) == ["a.pdf", "b.pdf", "1.pdf"]
    path = str(tmp_path / "input")
    assert files.read_object(spark, f"{path}/b.pdf", "bytes").first().content == b"bb" and files.read_object(spark, f"{path}/b.pdf").first().text == "bb"
    assert files.read_object(spark, f"{path}/x.json", "json").first().n == 1


def plain_sanitize(text):
    """The steps on one text, in plain Python."""
    found = [(t, m.start(), m.end(), score, m[0]) for t, (rx, score) in spans.RECOGNISERS.items() for m in re.finditer(rx, text, re.ASCII)]
    found = [s for s in found if s[4].strip().lower() not in spans.ALLOWED_TERMS]
    numbers = {}
    named = [(*s, numbers.setdefault(s[0], {}).setdefault(s[4], len(numbers[s[0]]) + 1)) for s in found]
    chosen = []
    for s in sorted(named, key=lambda s: (-s[3], s[1])):
        if not any(c[1] < s[2] and s[1] < c[2] for c in chosen):
            chosen.append(s)
    for s in sorted(chosen, key=lambda s: -s[1]):
        text = f"{text[: s[1]]}<{s[0]}_{s[5]}>{text[s[2] :]}"
    return text, len(found), len(chosen)


def test_sanitized_table_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    rows = spans.sanitize(docs).select("text", "sanitized_text", "entities_total", "entities_redacted").collect()
    assert sum(r.entities_redacted for r in rows) > 20
    assert [tuple(r)[1:] for r in rows] == [plain_sanitize(r.text) for r in rows]


def test_minified_table_equals_passes_one_by_one(spark):
    from ledgerloom.plans.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for row in QUERIES["minified_text"](spark, SF).collect():
        text = texts[row.doc_id]
        for name in passes(aggressive=True):
            text = text and apply(name, text)
        assert row.minified == (None if text is None else re.sub("\n\n\n+", "\n\n", text).strip() + "\n")


def test_whole_result_document(spark, tmp_path):
    records, statuses = runs(spark)
    span = "run_id string, mode string, entity_type string, start int, end int, score double, text_snippet string"
    found = spark.createDataFrame([("a_1", "patterns", "EIN", 9, 19, 0.85, "12-3456789"), ("a_1", "patterns", "PERSON", 0, 3, 0.5, "Ann"), ("a_1", "combined", "EIN", 9, 19, 0.9, "12-3456789")], span)
    times = spark.createDataFrame([("a_1", "2025-01-01T00:00:00", "2025-01-01T00:01:00")], "run_id string, ingestion_timestamp string, analysis_timestamp string")
    documents = results.run_documents(records, statuses, generated_at="2025-01-02", comparison=results.entity_comparison(found), times=times)
    got = {r.run_id: r for r in documents.collect()}
    one = got["a_1"].pii_comparison["patterns"]
    assert (one.total, one.counts, [e.text_snippet for e in one.entities]) == (2, {"EIN": 1, "PERSON": 1}, ["Ann", "12-3456789"])
    assert set(got["a_1"].pii_comparison) == {"patterns", "combined"} and got["b_2"].pii_comparison == {}
    assert got["a_1"].processing_metadata.asDict() == dict.fromkeys(results.STEP_TIMES) | {"ingestion_timestamp": "2025-01-01T00:00:00", "analysis_timestamp": "2025-01-01T00:01:00", "report_generated_at": "2025-01-02"}
    assert set(got["b_2"].processing_metadata.asDict().values()) == {None, "2025-01-02"} and got["a_1"].pipeline_run.pipeline_version == "1.0.0"
    results.write_documents(documents, f"{tmp_path}/output")
    back = results.read_overview(spark, f"{tmp_path}/output", "pii_comparison map<string,struct<total:bigint>>, processing_metadata struct<ocr_timestamp:string,analysis_timestamp:string>")
    assert back.first().pii_comparison["patterns"].total == 2


def test_rule_document_as_rows(spark, tmp_path):
    rows = [("e1", f"t{i % 3}", str(2022 + i // 3), ["Zeta", "Alpha", None][i % 3], 60.0) for i in range(6)] + [("e2", "t", "2022", "Solo", 100.0)]
    records = spark.createDataFrame(rows, "partnership_ein string, partner_tin string, tax_year string, partnership_name string, partner_share_percentage double")
    records = records.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields if f.name not in records.columns))
    judged = cross_rules.all_rules(records).drop("run_id_trigger")
    parts = results.rule_parts(judged, records, "2025-01-01")
    head = parts["summary"].first()
    assert head.total_checks == judged.count() == head.passed + head.failed and head.critical + head.warnings + head.advisory == head.failed > 0
    assert head.year_pairs_checked == 3 and head.generated_at == "2025-01-01"
    groups = {(r.partnership_ein, r.tax_year): (r.partner_count, r.partnership_name) for r in parts["partnerships_validated"].collect()}
    assert groups == {("e1", "2022"): (3, "Zeta"), ("e1", "2023"): (3, "Zeta"), ("e2", "2022"): (1, "Solo")}  # the first record's name
    results.write_rules(parts, f"{tmp_path}/output")
    folder = f"{tmp_path}/output/{results.RULES_NAME}"
    assert spark.read.json(f"{folder}/results").count() == head.total_checks and spark.read.json(f"{folder}/summary").first().failed == head.failed
    one = results.rule_document_of(parts, "e2").first()
    assert one.summary.total_checks == len(one.results) > 0 and [tuple(p) for p in one.partnerships_validated] == [("2022", 1, "Solo")]
    assert {r.partnership_ein for r in spark.read.json(f"{folder}/partnerships_validated").collect()} == {"e1", "e2"}
    none = results.rule_document_of(parts, "none").first()
    assert none.summary.total_checks == 0 and none.results == []
