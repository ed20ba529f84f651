"""Cross-record rules over any set of records.

Group rules need all totals of a partnership and year: one aggregation with
partial sums, a row for each (partnership_ein, tax_year), which is joined back
only where a rule looks at single records.  Pair rules need consecutive years of
a partner: one equi-join on (ein, tin, year) of the first record of each key.
Every rule gives rows of RESULT with the numbers it compared (observed,
threshold); the absence of a row is a result too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, strip
from ..schemas import AMOUNT_FIELDS, INCOME6, KEY
from ..session import stored

RESULT = ["rule_id", "category", "severity", "passed", "partnership_ein", "tax_year", "partner_tin", "detail", "observed", "threshold"]
GROUP = ["partnership_ein", "tax_year"]
# The published identifiers of the rules.
PUBLISHED = {
    "A1": "CROSS_A1_PROFIT_PCT_SUM", "A2": "CROSS_A2_PCT_SUM_INCOMPLETE", "A3": "CROSS_A3_INCOME_PROPORTIONALITY",
    "A4": "CROSS_A4_CAPITAL_ACCOUNT_CONSISTENCY", "A5": "CROSS_A5_PARTNERSHIP_IDENTITY", "B1": "CROSS_B1_CAPITAL_CONTINUITY",
    "B3": "CROSS_B3_PARTNERSHIP_IDENTITY_MULTIYEAR", "B4": "CROSS_B4_PARTNER_TYPE_CONTINUITY", "C1": "CROSS_C1_EXACT_DUPLICATE",
    "C2": "CROSS_C2_AMENDED_K1", "D1": "CROSS_D1_DISTRIBUTION_REASONABLENESS", "D4": "CROSS_D4_SE_CONSISTENCY",
}
_dec = lambda c: F.col(c).cast("decimal(18,2)")


def _rows(df: DataFrame, rule: str, severity: str, passed: Column, tin: Column | None = None, detail: Column | None = None,
          observed: Column | None = None, threshold: float | Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    none = F.lit(None)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.select(
        F.lit(rule).alias("rule_id"), F.lit(rule[0]).alias("category"), F.lit(severity).alias("severity"), passed.alias("passed"),
        "partnership_ein", "tax_year", (none if tin is None else tin).cast("string").alias("partner_tin"),
        (none if detail is None else detail).cast("string").alias("detail"),
        F.round((none if observed is None else observed).cast("double"), 6).alias("observed"), limit.cast("double").alias("threshold"), *more,
    )


def _violations_or_pass(tested: DataFrame, violation: Column, groups: DataFrame, rule: str, severity: str, **shown) -> DataFrame:
    """A row per violation; one passing row for each of ``groups`` without any."""
    bad = tested.where(F.coalesce(violation, F.lit(False)))
    good = groups.join(bad.select(*GROUP).distinct(), GROUP, "left_anti")
    return _rows(bad, rule, severity, F.lit(False), **shown).unionByName(_rows(good, rule, severity, F.lit(True)))


def _marked(records: DataFrame) -> DataFrame:
    pct = F.col("partner_share_percentage").cast("decimal(9,5)")
    valid = F.coalesce(pct > 0, F.lit(False))
    return records.withColumns({"pct": pct, "valid": valid, "held": valid & F.col("capital_account_ending").isNotNull()})


def totals(records: DataFrame) -> DataFrame:
    """Size and decimal totals of every group, one row each."""
    when = lambda c, v: F.sum(F.when(F.col(c), v))
    fields = [x for f in INCOME6 for x in (
        F.count_if(F.col("valid") & F.col(f).isNotNull()).alias(f"n_{f}"), when("valid", _dec(f)).alias(f"total_{f}"),
    )]
    return _marked(records).groupBy(*GROUP).agg(
        F.count("*").alias("members"), F.count("pct").alias("n_pct"), F.sum("pct").alias("sum_pct"),
        F.count_if("valid").alias("n_valid"), when("valid", F.col("pct")).alias("sum_valid"),
        F.count_if("held").alias("n_held"), when("held", F.col("pct")).alias("sum_held"),
        when("held", _dec("capital_account_ending")).alias("sum_end"), F.sum(_dec("distributions")).alias("sum_dist"), F.count("distributions").alias("n_dist"),
        sum((F.coalesce(F.sum(_dec(f)), F.lit(0)) for f in INCOME6), F.lit(0)).alias("sum_income"), *fields,
    )


def grouped(records: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Records with the totals of their group; groups are null-safe."""
    groups = totals(records) if groups is None else groups
    right = groups.withColumnsRenamed({k: f"_{k}" for k in GROUP})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP))
    return _marked(records).join(right, same).drop(*(f"_{k}" for k in GROUP))


def percent_rules(g: DataFrame) -> DataFrame:
    """A1 (sum over 100) for groups of two or more; A2 (sum under 100) for all."""
    groups = g.where("n_pct > 0").select(*GROUP, "members", "sum_pct").distinct()
    total = F.col("sum_pct")
    over = _rows(groups.where("members >= 2"), "A1", "critical", total <= 100, observed=total, threshold=100.0)
    return over.unionByName(_rows(groups, "A2", "advisory", total >= 100, observed=total, threshold=100.0))


def proportional_allocation(g: DataFrame) -> DataFrame:
    """A3: a partner's share of an income field against the share of percent;
    the percent total is over all valid partners, the field's over those with it."""
    valid = g.where("valid AND members >= 2 AND n_valid >= 2")
    long = valid.select(*GROUP, "partner_tin", "pct", "sum_valid", F.explode(F.array(*(
        F.struct(F.lit(f).alias("field"), _dec(f).alias("v"), F.col(f"n_{f}").alias("n"), F.col(f"total_{f}").alias("total")) for f in INCOME6
    ))).alias("x")).select(*GROUP, "partner_tin", "pct", "sum_valid", "x.*").where("v IS NOT NULL")
    expected = F.col("pct").cast("double") / F.col("sum_valid").cast("double")
    actual = F.col("v").cast("double") / F.col("total").cast("double")
    tested = long.where("n >= 2 AND total <> 0").withColumn("off", F.abs(actual - expected) / expected)
    return _violations_or_pass(tested, F.col("off") > 0.10, valid.select(*GROUP).distinct(), "A3", "warning",
                               tin=F.col("partner_tin"), detail=F.col("field"), observed=F.col("off"), threshold=0.10)


def capital_proportion(g: DataFrame) -> DataFrame:
    """A4: share of ending capital against share of percent, absolute."""
    held = g.where("held AND members >= 2 AND n_held >= 2 AND sum_end <> 0 AND sum_held <> 0")
    share = F.col("capital_account_ending").cast("decimal(18,2)").cast("double") / F.col("sum_end").cast("double")
    tested = held.withColumn("off", F.abs(share - F.col("pct").cast("double") / F.col("sum_held").cast("double")))
    return _violations_or_pass(tested, F.col("off") > 0.15, held.select(*GROUP).distinct(), "A4", "warning",
                               tin=F.col("partner_tin"), observed=F.col("off"), threshold=0.15)


def name_consistency(g: DataFrame) -> DataFrame:
    """A5: any two distinct names of a group less similar than 0.85."""
    groups = g.where("members >= 2").select(*GROUP).distinct()
    names = g.where("members >= 2").select(*GROUP, strip(F.col("partnership_name")).alias("name")).where("name <> ''").distinct()
    pairs = names.alias("a").join(names.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in GROUP] + [F.col("a.name") < F.col("b.name")])
    worst = pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in GROUP)).agg(F.min(similarity(F.col("a.name"), F.col("b.name"))).alias("worst"))
    found = groups.join(worst, GROUP, "left")
    return _rows(found, "A5", "warning", F.coalesce(F.col("worst") >= 0.85, F.lit(True)), observed=F.col("worst"), threshold=0.85)


def distribution_reasonableness(g: DataFrame) -> DataFrame:
    """D1: a group's distributions against three times its positive income."""
    groups = g.where("members >= 2").select(*GROUP, "sum_income", F.coalesce("sum_dist", F.lit(0)).alias("sum_dist")).distinct()
    bad = (F.col("sum_income") > 0) & (F.col("sum_dist") > 3 * F.col("sum_income"))
    return _rows(groups, "D1", "warning", ~bad, observed=F.col("sum_dist"), threshold=3 * F.col("sum_income"))


def self_employment(g: DataFrame) -> DataFrame:
    """D4: general partners with income but no SE earnings, limited partners
    with SE earnings but no guaranteed payments.  Where ``entity_type`` is given,
    entities are exempt from the first."""
    several = g.where("members >= 2")
    kind = F.lower(F.coalesce("partner_type", F.lit("")))
    entity = ~F.lower(F.coalesce("entity_type", F.lit("individual"))).isin("individual", "") if "entity_type" in g.columns else F.lit(False)
    gp = (kind.contains("general") | kind.contains("member-manager")) & ~entity & (F.col("ordinary_business_income") > 0) & F.col("self_employment_earnings").isNull()
    lp = (kind.contains("limited") | kind.contains("other llc")) & (F.col("self_employment_earnings") > 0) & (F.coalesce("guaranteed_payments", F.lit(0.0)) == 0)
    side = F.when(F.coalesce(gp, F.lit(False)), "general").when(F.coalesce(lp, F.lit(False)), "limited")
    return _violations_or_pass(several.withColumn("side", side), F.col("side").isNotNull(), several.select(*GROUP).distinct(), "D4", "warning",
                               tin=F.col("partner_tin"), detail=F.col("side"))


def repeated_records(records: DataFrame) -> DataFrame:
    """C1 (exact copy of the first record of a TIN) and C2 (amended)."""
    tin = Window.partitionBy(*GROUP, "partner_tin").orderBy("ingested_at", "run_id")
    fields = F.struct(*AMOUNT_FIELDS)
    several = records.groupBy(*GROUP).count().where("count >= 2").select(*(F.col(k).alias(f"_{k}") for k in GROUP))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP))
    ranked = records.join(several, same, "left_semi").withColumns({"first": F.first(fields).over(tin), "nth": F.row_number().over(tin)})
    differ = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"first.{f}")), F.lit(f)) for f in AMOUNT_FIELDS)))
    later = ranked.where("nth > 1").withColumn("differ", differ)
    groups = ranked.select(*GROUP).distinct()
    count = F.size("differ")
    exact = _violations_or_pass(later, count == 0, groups, "C1", "critical", tin=F.col("partner_tin"), observed=count)
    return exact.unionByName(
        _violations_or_pass(later, count > 0, groups, "C2", "warning", tin=F.col("partner_tin"), detail=F.array_join("differ", ","), observed=count)
    )


def repeated_files(records: DataFrame) -> DataFrame:
    """C3: records of a file whose hash was stored before."""
    seen = Window.partitionBy("pdf_sha256").orderBy("ingested_at", "run_id")
    again = records.where("pdf_sha256 IS NOT NULL").withColumn("nth", F.row_number().over(seen)).where("nth > 1")
    return _rows(again, "C3", "warning", F.lit(False), tin=F.col("partner_tin"), detail=F.col("pdf_sha256"), observed=F.col("nth"))


def year_pairs(records: DataFrame) -> DataFrame:
    """(prior, current) structs of consecutive years; years that are no number do
    not pair, and of repeated records of a key the first one counts."""
    year, key = F.col("tax_year").try_cast("int"), ["partnership_ein", "partner_tin", "y"]
    order = F.struct(*(F.col(c) for c in ("ingested_at", "run_id") if c in records.columns), *KEY, *AMOUNT_FIELDS)
    first = records.withColumn("y", year).where("y IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct(*records.columns), order).alias("r"))
    side = lambda name: first.select(*key, F.col("r").alias(name))
    prior, current = side("prior").withColumn("y", F.col("y") + 1), side("current")
    return prior.join(current, ["partnership_ein", "partner_tin", "y"]).select("partnership_ein", "partner_tin", F.col("current.tax_year").alias("tax_year"), "prior", "current")


def pair_rules(pairs: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """B1 capital continuity, B3 name changes, B4 changes between GP and LP; with
    ``more`` columns of the pairs."""
    end, begin = F.col("prior.capital_account_ending").cast("decimal(18,2)"), F.col("current.capital_account_beginning").cast("decimal(18,2)")
    gap = F.abs(end - begin)
    tin = F.col("partner_tin")
    b1 = _rows(pairs, "B1", "critical", F.coalesce(gap < 0.01, F.lit(True)), tin=tin, observed=gap, threshold=0.01, more=more)
    old, new = strip(F.col("prior.partnership_name")), strip(F.col("current.partnership_name"))
    named = pairs.withColumns({"old": old, "new": new}).where("old <> '' AND new <> ''").withColumn("sim", similarity(F.col("old"), F.col("new")))
    b3 = _rows(named, "B3", "warning", (F.col("old") == F.col("new")) | (F.col("sim") >= 0.85), observed=F.col("sim"), threshold=0.85, more=more)
    kind = lambda side: F.lower(F.coalesce(F.col(f"{side}.partner_type"), F.lit("")))
    gp = lambda k: k.contains("general") | k.contains("member-manager")
    lp = lambda k: k.contains("limited") | k.contains("other llc")
    p, c = kind("prior"), kind("current")
    typed = pairs.where((strip(p) != "") & (strip(c) != ""))
    b4 = _rows(typed, "B4", "warning", ~((gp(p) & lp(c)) | (lp(p) & gp(c))), tin=tin, more=more)
    return b1.unionByName(b3).unionByName(b4)


def group_rules(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The rules that look at one partnership and year, from its records and totals."""
    g = grouped(records, groups)
    parts = [percent_rules(groups), proportional_allocation(g), capital_proportion(g), name_consistency(g), distribution_reasonableness(groups), self_employment(g)]
    if {"ingested_at", "run_id"} <= set(records.columns):
        parts.append(repeated_records(records))
    return reduce(DataFrame.unionByName, parts)


def all_rules(records: DataFrame, run_id_trigger: str = "") -> DataFrame:
    """Every rule over ``records``, as one table.  The records are computed once
    and kept, with the totals of their groups, in the shared folder."""
    records = stored(records, "records")
    parts = [group_rules(records, stored(totals(records), "group-totals"))]
    if {"pdf_sha256", "ingested_at", "run_id"} <= set(records.columns):
        parts.append(repeated_files(records))
    parts.append(pair_rules(year_pairs(records)))
    return reduce(DataFrame.unionByName, parts).withColumn("run_id_trigger", F.lit(run_id_trigger))


def published(results: DataFrame) -> DataFrame:
    """``results`` with the rules' published identifiers; others keep theirs."""
    names = F.create_map(*(F.lit(x) for pair in PUBLISHED.items() for x in pair))
    return results.withColumn("rule_id", F.coalesce(names[F.col("rule_id")], "rule_id"))


def scope(records: DataFrame, ein: str | None = None, year: str | None = None) -> DataFrame:
    """The records of one partnership and year if both are given, else all."""
    if not (ein and year):
        return records
    return records.where((F.col("partnership_ein") == ein) & (F.col("tax_year") == year))


def summary(results: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    by = lambda s: F.count_if(failed & (F.col("severity") == s)).alias(f"{s}_failures")
    return results.agg(
        F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"), F.count_if(failed).alias("failed_checks"),
        by("critical"), by("warning"), by("advisory"),
    )
