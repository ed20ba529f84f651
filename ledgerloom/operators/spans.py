"""Entity spans in text: detection, filtering, overlap, numbering, redaction.

All steps work on arrays of one row, so a document of any number of spans needs
no shuffle.  Detection and filtering are expressions; numbering, choice and
redaction, which go through a text's spans in order, run over Arrow batches: one
sweep each, in n log n for n spans.  A provider is a function from a text Column to an
array of spans; the built-in one is a set of patterns.  Where a model would
look for names and places, another provider takes its place.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ship_package

# Entity types, patterns and scores of the built-in recognisers
# (Java and RE2 syntax alike) and the terms that are never personal data.
RECOGNISERS = {
    "EIN": (r"\b[0-9]{2}-[0-9]{7}\b", 0.85),
    "US_SSN": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0),
    "PHONE_NUMBER": (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", 0.75),
    "CREDIT_CARD": (r"\b[0-9]{16}\b", 0.6),
    "PASSPORT": (r"\b[A-Z][0-9]{8}\b", 0.5),
    "US_DRIVER_LICENSE": (r"\b[A-Z][0-9]{7}\b", 0.4),
    "IBAN_CODE": (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.8),
    "IP_ADDRESS": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.95),
}
#: What every match of a recogniser holds: texts without it are not searched.
#: All others hold a digit, which is looked for once for all recognisers.
NEEDED = {"EIN": "-", "US_SSN": "-", "EMAIL_ADDRESS": "@", "PHONE_NUMBER": "(", "IP_ADDRESS": "."}
ALLOWED_TERMS = [
    "partner", "partners", "partnership", "partnerships", "general partner", "limited partner", "domestic partner", "foreign partner",
    "schedule k-1", "k-1", "form 1065", "form 1120-s", "keogh", "ira", "llc", "llp", "lp", "individual", "corporation", "trust", "estate",
    "tax matters partner", "partnership representative", "er member", "address", "k1",
]
# ``\b`` means other letters in other engines; these borders are ASCII everywhere.
_AFTER = "(?![0-9A-Za-z_])"
#: The first character of a pattern, as a class, and how often it stands there.
_FIRST = re.compile(r"(\[[^]]+\])(?:\{(\d+)(?:,(\d+))?\})?")
SPAN_TYPE = "struct<entity_type:string,start:int,end:int,score:double,text_snippet:string>"


def bordered(pattern: str) -> str:
    """A recogniser's pattern for Spark, its word borders spelled out.  What stands
    before a match is looked at after its first character, which few places have."""
    if pattern.startswith(r"\b"):
        lead = _FIRST.match(pattern, 2)
        if lead is None:
            pattern = "(?<![0-9A-Za-z_])" + pattern[2:]
        else:
            one, least, most = lead[1], int(lead[2] or 1), int(lead[3] or lead[2] or 1)
            more = "" if most == 1 else f"{one}{{{least - 1},{most - 1}}}"
            pattern = f"{one}(?<![0-9A-Za-z_]{one}){more}{pattern[lead.end():]}"
    return pattern[:-2] + _AFTER if pattern.endswith(r"\b") else pattern


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def pattern_spans(text: Column, entity: str, pattern: str, score: float, needed: str | None = None) -> Column:
    """All matches with code-point offsets: what lies between matches tells
    where each begins; texts without a match are not split."""
    none = F.array().cast(f"array<{SPAN_TYPE}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def spans(p):
        def step(acc, x):
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["hit"])
            span = F.struct(F.lit(entity).alias("entity_type"), begin.alias("start"), end.alias("end"), F.lit(score).alias("score"), x["hit"].alias("text_snippet"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span.cast(SPAN_TYPE))).alias("out"))

        pairs = F.zip_with(p["hits"], F.slice(p["gaps"], 1, F.size(p["hits"])), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    def located(hits):
        parts = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(hits) == 0, none).otherwise(let(parts, spans))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return found if needed is None else F.when(text.contains(needed), found).when(text.isNotNull(), none)


def detect(text: Column, types: list[str] | None = None) -> Column:
    """Spans of the built-in recognisers, by type in the order of the table."""
    found = [pattern_spans(text, t, bordered(RECOGNISERS[t][0]), RECOGNISERS[t][1], NEEDED.get(t)) for t in (types or RECOGNISERS)]
    none = F.array().cast(f"array<{SPAN_TYPE}>")
    return F.when(text.rlike("[0-9@]"), reduce(F.concat, found)).when(text.isNotNull(), none)


def span_rows(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` and a span ``s`` for each that is detected.  The explode is an outer
    one: before another one Spark would search every text a second time, to leave out
    those without spans."""
    return docs.select(*columns, F.explode_outer(detect(F.col(text))).alias("s")).where("s IS NOT NULL")


def drop_false_positives(spans: Column) -> Column:
    """Without allowed terms, and without SSNs of another form."""

    def real(s):
        term = strip(s["text_snippet"])
        return ~F.lower(term).isin(ALLOWED_TERMS) & ((s["entity_type"] != "US_SSN") | term.rlike(r"^\d{3}-\d{2}-\d{4}$"))

    return F.filter(spans, real)


NUMBERED_TYPE = "array<struct<pos:int,entity_type:string,start:int,end:int,score:double,text_snippet:string,placeholder:string>>"


def _over_batches(kind: str):
    """A function of Arrow arrays as one of columns; Spark parses ``kind`` only in
    a session."""
    return lambda run: lambda *columns: F.arrow_udf(run, kind)(*columns)


def _lists(column: pa.Array) -> tuple[pa.StructArray, np.ndarray, pa.Array | None]:
    """The structs of a column of lists, where each list ends, and which are null."""
    flat = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), column.is_null() if column.null_count else None


def _relisted(flat: pa.Array, bounds: np.ndarray, null: pa.Array | None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds), flat, mask=null)


def number_spans(spans: Column) -> Column:
    """Placeholders: the n-th different text of a type, by first detection; the
    numbers count spans that overlap handling drops later as well."""
    return _number(spans)


@_over_batches(NUMBERED_TYPE)
def _number(spans: pa.Array) -> pa.Array:
    flat, bounds, null = _lists(spans)
    kinds, texts = flat.field("entity_type").to_pylist(), flat.field("text_snippet").to_pylist()
    pos, names = np.zeros(len(flat), np.int32), []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        pos[lo:hi] = np.arange(hi - lo)
        seen: dict[str, dict[str, int]] = {}
        for kind, text in zip(kinds[lo:hi], texts[lo:hi]):
            own = seen.setdefault(kind, {})
            names.append(f"<{kind}_{own.setdefault(text, len(own) + 1)}>")
    fields = ["entity_type", "start", "end", "score", "text_snippet"]
    columns = [pa.array(pos), *(flat.field(f) for f in fields), pa.array(names, pa.string())]
    return _relisted(pa.StructArray.from_arrays(columns, ["pos", *fields, "placeholder"]), bounds, null)


def without_overlap(numbered: Column) -> Column:
    """Greedy choice by score, then start, then detection order."""
    return _choose(numbered)


def chosen_places(starts: list[int], ends: list[int], scores: list[float], places: list[int]) -> list[int]:
    """Indexes of the spans that a greedy choice takes, best first.  What is taken
    never overlaps, so only the two neighbours of a span can stand in its way."""
    taken_starts: list[int] = []
    taken_ends: list[int] = []
    out = []
    for i in sorted(range(len(starts)), key=lambda i: (-scores[i], starts[i], places[i])):
        at = bisect_right(taken_starts, starts[i])
        if at and taken_ends[at - 1] > starts[i] or at < len(taken_starts) and taken_starts[at] < ends[i]:
            continue
        taken_starts.insert(at, starts[i])
        taken_ends.insert(at, ends[i])
        out.append(i)
    return out


@_over_batches(NUMBERED_TYPE)
def _choose(numbered: pa.Array) -> pa.Array:
    flat, bounds, null = _lists(numbered)
    starts, ends, scores, places = (flat.field(f).to_pylist() for f in ("start", "end", "score", "pos"))
    taken, sizes = [], [0]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = chosen_places(starts[lo:hi], ends[lo:hi], scores[lo:hi], places[lo:hi]) if hi > lo else []
        taken += [lo + i for i in own]
        sizes.append(len(taken))
    return _relisted(flat.take(pa.array(taken, pa.int64())), np.array(sizes, np.int32), null)


def redact(text: Column, chosen: Column) -> Column:
    """Text with each chosen span replaced by its placeholder."""
    return F.when(F.size(chosen) == 0, text).otherwise(_redact(F.when(F.size(chosen) > 0, text), chosen))


@_over_batches("string")
def _redact(texts: pa.Array, chosen: pa.Array) -> pa.Array:
    flat, bounds, _ = _lists(chosen)
    starts, ends, names = (flat.field(f).to_pylist() for f in ("start", "end", "placeholder"))
    out = []
    for text, lo, hi in zip(texts.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for i in sorted(range(lo, hi), key=starts.__getitem__):
            parts += [text[at : starts[i]], names[i]]
            at = ends[i]
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


def sanitize(docs: DataFrame, text: str = "text", provider=detect) -> DataFrame:
    """``docs`` with spans, sanitized_text, mapping (in order of detection) and
    the number of replacements."""
    ship_package(docs.sparkSession)
    step = docs.withColumn("spans", drop_false_positives(provider(F.col(text))))
    step = step.withColumn("numbered", number_spans(F.col("spans")))
    step = step.withColumn("chosen", without_overlap(F.col("numbered")))
    pair = lambda s: F.struct(s["placeholder"].alias("placeholder"), s["text_snippet"].alias("original"))
    return step.withColumns({
        "sanitized_text": redact(F.col(text), F.col("chosen")),
        "mapping": F.array_distinct(F.transform("numbered", pair)),
        "entities_total": F.size("spans"), "entities_redacted": F.size("chosen"),
    }).drop("numbered", "chosen")


def resolve_identifiers(mapping: Column) -> Column:
    """(partnership_ein, partner_tin): first EIN; first SSN, else second EIN."""
    number = lambda p: F.coalesce(F.regexp_extract(p["placeholder"], r"_(\d+)>", 1).try_cast("int"), F.lit(0))
    keyed = F.array_sort(F.transform(mapping, lambda p, i: F.struct(number(p).alias("n"), i.alias("i"), strip(p["original"]).alias("t"))))
    of = lambda rx: F.filter(keyed, lambda p: p["t"].rlike(rx))
    eins, ssns = of(r"^\d{2}-\d{7}$"), of(r"^\d{3}-\d{2}-\d{4}$")
    return F.struct(F.get(eins, 0)["t"].alias("partnership_ein"), F.coalesce(F.get(ssns, 0)["t"], F.get(eins, 1)["t"]).alias("partner_tin"))
