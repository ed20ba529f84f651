"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the records' text treats as white space at either end.
_SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
_EDGE = f"^{_SPACE}|{_SPACE}$"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, _EDGE, "")


def bigrams(text: Column) -> Column:
    """Distinct two-character pieces of the lower-cased text, or the text itself
    if it is shorter."""
    low = F.lower(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    return F.array_distinct(pieces)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of bigrams: 0 if either text is empty, 1 if they are
    equal but for case."""
    x, y = bigrams(a), bigrams(b)
    shared, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0))
        .when(F.lower(a) == F.lower(b), F.lit(1.0))
        .otherwise(shared / either)
    )


def mask_ein(ein: Column) -> Column:
    return F.concat(F.substring(ein, 1, 3), F.lit("***"), F.substring(ein, -3, 3))


def mask_tin(tin: Column) -> Column:
    return F.concat(F.substring(tin, 1, 4), F.lit("***"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def partner_class(kind: Column) -> Column:
    """GP, LP, both or the text itself."""
    low = F.lower(kind)
    gp, lp = low.contains("general"), low.contains("limited")
    return F.when(gp & lp, "GP/LP").when(gp, "GP").when(lp, "LP").otherwise(kind)


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def parse_amount(text: Column) -> Column:
    """Form amounts: parentheses are negative, a leading code letter is dropped."""
    bare = F.regexp_replace(text, r"^\s*[A-Z]+\s+", "")
    digits = F.regexp_replace(bare, r"[^0-9.]", "")
    value = digits.try_cast("decimal(18,2)")
    return F.when(bare.contains("(") | F.trim(bare).startswith("-"), -value).otherwise(value)


def currency(value: Column) -> Column:
    return F.when(value < 0, F.format_string("($%,.2f)", -value)).otherwise(F.format_string("$%,.2f", value))


def is_number(text: Column) -> Column:
    """Whether a text is digits with at most one point and one minus sign."""
    return F.coalesce(text.rlike(r"^(?!.*-.*-)(?!.*[.].*[.])[0-9.-]*[0-9][0-9.-]*$"), F.lit(False))


def percent(value: Column) -> Column:
    """One decimal and a percent sign; a dash for null."""
    return F.when(value.isNull(), "\u2014").otherwise(F.format_string("%.1f%%", value.cast("double")))


def ratio(value: Column) -> Column:
    """Two decimals and an x; a dash for null."""
    return F.when(value.isNull(), "\u2014").otherwise(F.format_string("%.2fx", value.cast("double")))


def short_time(iso: Column) -> Column:
    """Day and minute of an ISO time."""
    return F.replace(F.substring(iso, 1, 16), F.lit("T"), F.lit(" "))


def run_folder(stem: Column, at: Column) -> Column:
    return F.concat(stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def folder_title(folder: Column) -> Column:
    """A run folder's name without its time, underscores as blanks."""
    return F.regexp_replace(F.regexp_replace(folder, r"_\d{8}_\d{6}$", ""), "_", " ")


def replace_all(text: Column, pairs: Column) -> Column:
    """Replace every ``placeholder`` by its ``original``, in array order."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["placeholder"], p["original"]))
