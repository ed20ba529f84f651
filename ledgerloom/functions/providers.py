"""Stand-ins for model-backed stages: deterministic, same contracts.

No parity with any model is claimed.  A provider is any function of the same
shape; a model-backed one would be a pandas_udf that loads its model once per
worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMOUNT_FIELDS, TEXT_FIELDS
from .text import parse_amount


def extract_record(text: Column) -> Column:
    """A record from ``field: value`` lines; what is absent is null."""
    line = lambda f: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{f.replace('_', '[ _]')}[ \t]*:[ \t]*(.*)$", 1)), F.lit(""))
    amounts = [parse_amount(line(f)).cast("double").alias(f) for f in ("partner_share_percentage", *AMOUNT_FIELDS)]
    return F.struct(*(line(f).alias(f) for f in TEXT_FIELDS), *amounts)


def ocr_passthrough(content: Column) -> Column:
    """Text inputs as one page; bytes that are no text give none."""
    return F.array(F.struct(F.lit(1).alias("page"), F.decode(content, "UTF-8").alias("text")))


def no_judgement() -> Column:
    """The empty report of the model-based validation, which a status ignores."""
    return F.struct(F.lit(None).cast("double").alias("coherence_score"), F.lit(None).cast("double").alias("ocr_confidence"))


def audit_rows(messages: Column) -> Column:
    """Flat rows of a conversation: position, role and text of each message."""
    return F.transform(messages, lambda m, i: F.struct(i.alias("position"), m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))
