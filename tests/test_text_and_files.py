import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import minify as mn
from ledgerloom.functions.providers import audit_rows, extract_record
from ledgerloom.operators import spans
from ledgerloom.plans import reports
from ledgerloom.schemas import TABLE
from ledgerloom.sources import files
from ledgerloom.streaming import dropzone

TEXT = "EIN 46-3819204 and 46-3819204, SSN 621-47-8830, mail é@x.org a.b@c.com 😀 1.2.3.4 end 81-2047563"


def test_spans_have_code_point_offsets(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "id long, text string")
    rows = {r.id: r for r in spans.sanitize(df).collect()}
    for s in rows[1].spans:
        assert TEXT[s.start : s.end] == s.text_snippet
    assert rows[1].sanitized_text == "EIN <EIN_1> and <EIN_1>, SSN <US_SSN_1>, mail é@x.org <EMAIL_ADDRESS_1> 😀 <IP_ADDRESS_1> end <EIN_2>"
    assert rows[2].sanitized_text == "" and rows[2].entities_total == 0
    restored = rows[1].sanitized_text
    for p in rows[1].mapping:
        restored = restored.replace(p.placeholder, p.original)
    assert restored == TEXT
    ids = spans.sanitize(df).select(spans.resolve_identifiers(F.col("mapping")).alias("r")).first().r
    assert (ids.partnership_ein, ids.partner_tin) == ("46-3819204", "621-47-8830")


def test_overlap_by_score_then_start_keeps_number_gaps(spark):
    df = spark.createDataFrame([("abcdefghij", [("A", 0, 4, 0.5, "abcd"), ("A", 2, 6, 0.9, "cdef"), ("B", 6, 8, 0.9, "gh"), ("B", 7, 9, 0.9, "hi")])], f"text string, spans array<{spans.SPAN_TYPE}>")
    out = df.withColumn("n", spans.number_spans(F.col("spans"))).withColumn("c", spans.without_overlap(F.col("n")))
    assert out.select(spans.redact(F.col("text"), F.col("c")).alias("t")).first().t == "ab<A_2><B_1>ij"


def test_false_positives(spark):
    df = spark.createDataFrame([([("X", 0, 1, 1.0, " Partner "), ("US_SSN", 0, 1, 1.0, "12-3"), ("X", 0, 1, 1.0, "Ann")],)], f"spans array<{spans.SPAN_TYPE}>")
    assert [s.text_snippet for s in df.select(spans.drop_false_positives(F.col("spans")).alias("s")).first().s] == ["Ann"]


def minified(spark, text, **options):
    return mn.minify(spark.createDataFrame([(text,)], "t string"), "t", **options).first().minified


def test_passes(spark):
    only = lambda text, name: minified(spark, text, enable_only=[name])
    assert minified(spark, "# A  \n\n\n\nIn order to see, essentially, it.\n\n---\n\nend") == "# A\n\nto see, it.\nend\n"
    assert only("| a  |  b |\n|----|:---|", "compact_tables") == "|a|b|\n|----|:---|\n"
    assert only("|-----|:----:|", "simplify_separator_rows") == "|---|:---:|\n"
    table = "| x | Valid? | Reason |\n|---|---|---|\n| 1 | Yes | ok |\n| 2 | No | big |\n"
    assert only(table, "compress_example_tables") == "Valid: 1 (ok)\nInvalid: 2 (big)\n"
    code = "```\n# note\nx = 1  # one\nif (\n    a is not None\n    and b\n):\n    y\n```\n# kept"
    assert only(code, "strip_code_comments") == "```\nx = 1\nif (\n    a is not None\n    and b\n):\n    y\n```\n# kept\n"
    assert "  y" in only(code, "reduce_code_indentation") and "    y" not in only(code, "reduce_code_indentation")
    assert "a!=None" in only(code, "compact_none_checks")
    assert "if (a is not None and b):\n" in only(code, "collapse_multiline_ifs")
    assert only("See Instructions for Form 1065.", "abbreviate_irs_references") == "See Form 1065 Instructions.\n"
    block = "- **Critical** -- a\n- **Warning** -- b\n- **Advisory** -- c\n"
    assert only(f"{block}x\n{block}y", "deduplicate_severity_definitions") == f"{block}x\ny\n"
    assert only("[a](b) c", "strip_link_urls") == "a c\n"
    assert only("- **Name** -- long words", "remove_list_item_descriptions") == "- Name\n"
    assert only("Fields Involved:\n- `a` (Box 1)\n- `b`\n", "compact_rule_structure") == "Fields: a (Box 1), b\n"
    assert only("#### A\n### B", "flatten_heading_depth") == "## A\n## B\n"
    assert only("# 1. Overview\nfirst\n\nsecond\n\n## Next\n", "remove_overview_prose") == "# 1. Overview\n\nfirst\n\n## Next\n"
    assert len(mn.passes(aggressive=True)) == 24 and mn.passes(disable=["strip_link_urls"]) == [p for p in mn.DEFAULT if p != "strip_link_urls"]
    assert minified(spark, None) is None


def record(spark, rows):
    base = {f.name: None for f in TABLE.fields}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in TABLE.fields) for r in rows], TABLE)


def row(ein, year, run, amount):
    return {"partnership_ein": ein, "partner_tin": "t", "tax_year": year, "run_id": run, "ingested_at": run, "distributions": amount}


def test_record_table_upserts_by_key(spark, tmp_path):
    table = files.RecordTable(spark, f"file://{tmp_path}/records")
    assert table.read().count() == 0
    table.upsert(record(spark, [row("1", "2023", "a", 1.0), row("1", "2023", "b", 2.0), row("2", "2024", "a", 3.0)]))
    table.upsert(record(spark, [row("2", "2024", "c", 9.0)]))
    table.upsert(record(spark, [row("2", "2024", "c", 9.0)]))
    got = table.read()
    assert sorted((r.partnership_ein, r.tax_year, r.distributions) for r in got.collect()) == [("1", "2023", 2.0), ("2", "2024", 9.0)]
    assert dict(got.dtypes)["tax_year"] == "string"


def test_failed_write_keeps_the_version_before(spark, tmp_path, monkeypatch):
    table = files.RecordTable(spark, f"file://{tmp_path}/records")
    table.upsert(record(spark, [row("1", "2023", "a", 1.0), row("2", "2024", "a", 3.0)]))
    before = sorted(map(tuple, table.read().collect()), key=str)

    def broken(*_):
        raise OSError("lost between the two writes")

    monkeypatch.setattr(files.RecordTable, "_publish", broken)
    with pytest.raises(OSError):
        table.upsert(record(spark, [row("2", "2024", "c", 9.0)]))
    assert sorted(map(tuple, table.read().collect()), key=str) == before
    monkeypatch.undo()
    other = files.RecordTable(spark, f"file://{tmp_path}/records")
    monkeypatch.setattr(other, "_versions", lambda: [])  # it has not seen the first version
    with pytest.raises(RuntimeError, match="someone else"):
        other.upsert(record(spark, [row("9", "2023", "z", 9.0)]))
    assert sorted(map(tuple, table.read().collect()), key=str) == before


def test_only_years_of_a_batch_are_written(spark, tmp_path):
    table = files.RecordTable(spark, f"file://{tmp_path}/records")
    table.upsert(record(spark, [row("1", "2023", "a", 1.0), row("2", "2024", "a", 3.0)]))
    first = table._manifest(1)
    for i in range(3):
        table.upsert(record(spark, [row("2", "2024", f"c{i}", 9.0 + i)]))
    last = table._manifest(4)
    assert last["2023"] == first["2023"] and last["2024"] != first["2024"] and table._versions() == [3, 4]
    assert not (tmp_path / "records" / first["2024"]).exists() and (tmp_path / "records" / first["2023"]).exists()
    assert sorted((r.partnership_ein, r.distributions) for r in table.read().collect()) == [("1", 1.0), ("2", 11.0)]


def test_records_are_assembled_from_a_runs_parts(spark):
    ingested = spark.createDataFrame([("r1", "a.pdf", "h1", "2025-01-01"), ("r2", "b.pdf", "h2", "2025-01-02"), ("r1", "a.pdf", "h1", "2025-01-01")], "run_id string, source_pdf_name string, pdf_sha256 string, ingested_at string")
    extracted = spark.createDataFrame([("r1", "2024", 5.0), ("r2", None, None)], "run_id string, tax_year string, distributions double")
    ids = spark.createDataFrame([("r1", "12-3456789", "111-22-3333")], "run_id string, partnership_ein string, partner_tin string")
    checks = spark.createDataFrame([("r1", "critical", False), ("r1", "warning", False), ("r1", "warning", True)], "run_id string, severity string, passed boolean")
    scores = spark.createDataFrame([("r1", 0.5, 0.75)], "run_id string, ai_coherence_score double, ai_ocr_confidence double")
    rows = {r.run_id: r for r in files.with_ingest_status(files.assemble_records(ingested, extracted, ids, checks, scores)).collect()}
    r = rows["r1"]
    assert (r.partnership_ein, r.distributions, r.deterministic_critical_count, r.deterministic_warning_count, r.deterministic_passed) == ("12-3456789", 5.0, 1, 1, False)
    assert (r.ai_coherence_score, r.ai_ocr_confidence, r.status, r.reason) == (0.5, 0.75, "stored", None)
    assert rows["r2"].status == "skipped" and rows["r2"].reason == "missing partnership_ein, partner_tin, tax_year" and len(rows) == 2
    bare = files.assemble_records(ingested, extracted, ids)
    assert bare.schema.fieldNames() == TABLE.fieldNames() and bare.count() == 2
    keys = spark.range(1).select(files.document_key(F.lit("My Fund, LLC"), "", "2024", suffix=".json").alias("k"), files.decoded(F.lit("aGk=")).alias("b"), files.decoded(F.lit("?")).alias("n")).first()
    assert keys.k == "my_fund_llc/2024.json" and bytes(keys.b) == b"hi" and keys.n is None


def test_drop_zone_is_idempotent(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "good.pdf").write_text("tax_year: 2024\npartnership name: P\ndistributions: (1,200)\n")
    (drop / "bad.pdf").write_text("nothing here")
    (drop / "note.txt").write_text("no")
    table = files.RecordTable(spark, f"file://{tmp_path}/records")

    def to_records(batch):
        parsed = files.ingest(batch, now="2025-01-01").withColumn("r", extract_record(F.decode("content", "UTF-8")))
        columns = [F.col(f"r.{c}").alias(c) for c in ("tax_year", "partnership_name", "partner_type", "partner_share_percentage")]
        out = parsed.select("run_id", "source_pdf_name", "pdf_sha256", F.col("ingested_at").cast("string").alias("ingested_at"), *columns, F.col("r.distributions").alias("distributions"))
        out = out.withColumns({"partnership_ein": F.lit("e"), "partner_tin": F.lit("t"), "error": F.when(F.col("tax_year").isNull(), "no tax year")})
        missing = [f for f in TABLE.fields if f.name not in out.columns]
        return out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*TABLE.fieldNames(), "error")

    for _ in range(2):
        dropzone.start(spark, str(drop), table, to_records, f"{tmp_path}/check", f"{tmp_path}/failed", once=True).awaitTermination()
    assert [(r.source_pdf_name, r.distributions) for r in table.read().collect()] == [("good.pdf", -1200.0)]
    assert spark.read.json(f"{tmp_path}/failed").count() == 1


def test_small_sources(spark, tmp_path):
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "a.md").write_text("one")
    assert files.read_markdown(spark, str(tmp_path), separator="|").first().text == "one|two"
    assert files.list_files(spark, str(tmp_path), "*.md").count() == 2
    assert files.exists(spark, str(tmp_path)) and not files.exists(spark, f"{tmp_path}/none")
    pages = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a")], "run_id string, page int, text string")
    assert reports.stitch_pages(pages).first().full_text == "a\n\n--- PAGE BREAK ---\n\nb"
    talk = spark.createDataFrame([([("user", "hi"), ("model", None)],)], "m array<struct<role:string,text:string>>")
    assert [tuple(x) for x in talk.select(audit_rows(F.col("m")).alias("a")).first().a] == [(0, "user", "hi"), (1, "model", "")]
