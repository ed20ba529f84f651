"""Per-record validation: 44 checks in one projection, their report and status.

A check names its violation as a SQL predicate; a null operand makes it null,
and only a true violation fails.  All results of a record are one array, so any
number of checks costs one pass and no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INCOME7, MAGNITUDES, NON_NEGATIVE, NON_NEGATIVE_FIELDS, PARTNER_TYPES, SECTION_179_DEFAULT, SECTION_179_LIMITS


class Check(NamedTuple):
    rule_id: str
    rule_name: str
    severity: str
    violation: str
    fields: tuple[str, ...]


def _z(name: str) -> str:
    return f"coalesce({name}, 0)"


_INCOME = " + ".join(map(_z, INCOME7))
_GP, _LP = "lower(partner_type) LIKE '%general%'", "lower(partner_type) LIKE '%limited%'"
_BOX1, _SE, _GUAR = "ordinary_business_income", "self_employment_earnings", "guaranteed_payments"
_BEG, _END, _DIST = "capital_account_beginning", "capital_account_ending", "distributions"
_EXPECTED_SE = f"({_BOX1} + {_z(_GUAR)})"
_EXPECTED_QBI = f"({_BOX1} - {_z(_GUAR)})"
_LIMIT = "CASE tax_year " + " ".join(f"WHEN '{y}' THEN {v}" for y, v in SECTION_179_LIMITS.items()) + f" ELSE {SECTION_179_DEFAULT} END"
_TYPES = ", ".join(f"'{t}'" for t in PARTNER_TYPES)
_NO_INCOME = " AND ".join(f"{_z(f)} = 0" for f in INCOME7)

# Identifiers, names, severities and fields of the checks.
CHECKS = [
    Check("ARITH-001", "Qualified dividends <= ordinary dividends", "critical", "qualified_dividends > ordinary_dividends", ("qualified_dividends", "ordinary_dividends")),
    Check("ARITH-002", "Partner share percentage in valid range", "critical", "partner_share_percentage <= 0 OR partner_share_percentage > 100", ("partner_share_percentage",)),
    *(Check(f"ARITH-003-{f}", f"{f} non-negative", "critical", f"{f} < 0", (f,)) for f in NON_NEGATIVE),
    Check("ARITH-005", "Capital account directional plausibility", "advisory",
          f"abs(({_END} - {_BEG}) - ({_INCOME} - {_z(_DIST)})) > 2 * greatest(abs({_BEG}), abs({_END}), 1)", (_BEG, _END)),
    Check("ARITH-006", "General partner SE earnings plausibility", "warning",
          f"{_GP} AND abs({_SE} - {_EXPECTED_SE}) > greatest(0.15 * abs({_EXPECTED_SE}), 1000)", (_SE, _BOX1, _GUAR)),
    Check("ARITH-007", "Limited partner SE earnings constraint", "warning", f"{_LP} AND {_SE} > {_GUAR} + 100", (_SE, _GUAR)),
    Check("ARITH-008", "QBI deduction plausibility", "advisory",
          f"abs(qbi_deduction - {_EXPECTED_QBI}) > greatest(0.25 * abs({_BOX1}), 5000)", ("qbi_deduction", _BOX1, _GUAR)),
    Check("ARITH-009", "Ordinary dividends present when qualified reported", "critical", "qualified_dividends > 0 AND ordinary_dividends IS NULL", ("qualified_dividends", "ordinary_dividends")),
    Check("ARITH-010", "Foreign taxes require income context", "warning", f"foreign_taxes_paid > 0 AND {_NO_INCOME}", ("foreign_taxes_paid",)),
    Check("ARITH-011", "Section 179 reasonableness", "advisory",
          f"section_179_deduction > 0 AND {_BOX1} > 0 AND section_179_deduction > 5 * {_BOX1}", ("section_179_deduction", _BOX1)),
    Check("FC-001", "tax_year present and valid", "critical", "NOT coalesce(length(tax_year) = 4 AND length(translate(tax_year, '0123456789', '')) = 0, false)", ("tax_year",)),
    Check("FC-003", "partnership_name present", "critical", "coalesce(trim(partnership_name), '') = ''", ("partnership_name",)),
    Check("FC-004", "partner_type present and valid", "critical", f"coalesce(lower(trim(partner_type)), '') NOT IN ({_TYPES})", ("partner_type",)),
    Check("FC-010", "Partner share percentage range", "critical", "partner_share_percentage < 0 OR partner_share_percentage > 100", ("partner_share_percentage",)),
    *(Check(f"FC-021-{f}", f"{f} non-negative", "critical", f"{f} < 0", (f,)) for f in NON_NEGATIVE_FIELDS),
    Check("FC-031", "Section 179 statutory limit", "critical", f"section_179_deduction > 0 AND section_179_deduction > {_LIMIT}", ("section_179_deduction", "tax_year")),
    Check("FC-032", "SE earnings vs partner type consistency", "warning", f"{_LP} AND abs({_SE}) > 1.1 * abs({_GUAR})", (_SE, _GUAR, "partner_type")),
    *(Check(f"FC-040-{f}", f"{f} magnitude check", "advisory", f"{f} < {lo} OR {f} > {hi}", (f,)) for f, (lo, hi) in MAGNITUDES.items()),
    Check("CAP-001", "Capital account reconciliation", "warning",
          f"abs({_END} - ({_BEG} + {_INCOME} - {_z('section_179_deduction')} - {_z('foreign_taxes_paid')} - {_z(_DIST)})) > greatest(0.25 * abs({_END}), 10000)", (_BEG, _END)),
]


_META = {
    "rule_id": [c.rule_id for c in CHECKS], "rule_name": [c.rule_name for c in CHECKS], "severity": [c.severity for c in CHECKS],
}


def _failed(check: Check) -> Column:
    return F.coalesce(F.expr(check.violation), F.lit(False))


def _result(failed: Column, at: Column) -> dict[str, Column]:
    """One result: what varies is a boolean, the rest comes from constant arrays."""
    known = {name: F.get(F.array(*map(F.lit, values)), at) for name, values in _META.items()}
    fields = F.get(F.array(*(F.lit(",".join(c.fields)) for c in CHECKS)), at)
    message = F.when(failed, F.concat(known["rule_name"], F.lit(": failed"))).otherwise(F.lit("ok"))
    return known | {"passed": ~failed, "message": message, "fields_involved": F.split(fields, ",")}


def with_checks(records: DataFrame) -> DataFrame:
    """``records`` with an array column ``checks`` of 44 results, in order."""
    failed = F.array(*map(_failed, CHECKS))
    return records.withColumn("checks", F.transform(failed, lambda f, i: F.struct(*(v.alias(n) for n, v in _result(f, i).items()))))


def check_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and check."""
    rows = records.select(*keys, F.posexplode(F.array(*map(_failed, CHECKS))).alias("position", "failed"))
    return rows.select(*keys, "position", *(v.alias(n) for n, v in _result(F.col("failed"), F.col("position")).items()))


def report(records: DataFrame) -> DataFrame:
    """Failure counts by severity and ``deterministic_passed``."""
    count = lambda s: sum((_failed(c).cast("int") for c in CHECKS if c.severity == s), F.lit(0))
    counted = records.withColumns({f"{s}_count": count(s) for s in ("critical", "warning", "advisory")})
    return counted.withColumn("deterministic_passed", F.col("critical_count") == 0)


def with_status(reported: DataFrame) -> DataFrame:
    """failed, warnings or passed; a missing coherence score counts as 1."""
    coherence = F.coalesce(F.col("ai_coherence_score"), F.lit(1.0)) if "ai_coherence_score" in reported.columns else F.lit(1.0)
    return reported.withColumn(
        "status",
        F.when(F.col("critical_count") > 0, "failed").when((F.col("warning_count") > 0) | (coherence < 0.5), "warnings").otherwise("passed"),
    )
