from ledgerloom.plans import dashboard as d


def test_read_models(spark):
    reports = spark.createDataFrame(
        [("r1", "dir_1", "e1", "<NAME_1> Fund", None, "null", "passed", 0.0, 5.0, 1.0, None), ("r2", "dir_2", "e2", "", "2024", "LP", None, 7.0, 5.0, None, None)],
        "run_id string, report_dir string, partnership_ein string, partnership_name string, tax_year string, partner_type string, status string, total_income double, "
        "ordinary_business_income double, short_term_capital_gains double, long_term_capital_gains double",
    )
    kind = "mapping array<struct<placeholder:string,original:string>>"
    runs = spark.createDataFrame([("r1", [("<NAME_1>", "Ann")])], f"run_id string, {kind}")
    folders = spark.createDataFrame([("dir_1", [("<NAME_1>", "Bob")])], f"report_dir string, {kind}")
    full = d.resolved(d.resolve_mappings(reports, runs, folders), ["partnership_name", "partner_type"])
    rows = d.report_list(full).collect()
    assert [(r.partnership_name, r.tax_year, r.partner_type, r.status, r.income, r.capital_gains) for r in rows] == [
        ("Ann Fund", "-", "-", "passed", 5.0, 1.0), ("Unknown", "2024", "LP", "unknown", 7.0, 0.0)]
    checks = spark.createDataFrame([("r1", 1, "B", "critical", False), ("r1", 0, "A", "warning", True)], "run_id string, position int, rule_id string, severity string, passed boolean")
    results = spark.createDataFrame([("e1", "A1", "2024", "critical", False)], "partnership_ein string, rule_id string, tax_year string, severity string, passed boolean")
    one = d.report_detail(full, checks, results, "dir_1").first()
    assert [c.rule_id for c in one.checks] == ["A", "B"] and one.rules[0].rule_id == "A1"
    groups = spark.createDataFrame([("e1", "2024", 2)], "partnership_ein string, tax_year string, k1_count int")
    document = d.rule_document(results, groups).first()
    assert (document.total, document.failed, len(document.partnerships), document.failures[0].rule_id) == (1, 1, 1, "A1")
    empty = d.rule_document(results.limit(0), groups.limit(0)).first()
    assert (empty.total, empty.partnerships, empty.failures) == (0, [], [])
    steps = spark.createDataFrame([("t", None)], "ingested_at string, ocr_at string")
    assert d.step_completion(steps).first().steps_done == 1
    form = d.form_fields(spark.createDataFrame([("a", "", None)], "x string, y string, z string"), {"F1": "x", "F2": "y", "F3": "z"})
    assert form.first().form == {"F1": "a"}
