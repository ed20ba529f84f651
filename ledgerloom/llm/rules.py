"""Operator 2 - quality rules as a short-circuit cascade (built-in functions only).

Every rule's rejection rate and cost are measured on a sample; the cascade asks
the rules in the order of rejections per second and stops at the first that
rejects.  A document is kept only if all rules accept it, so the order (which
follows measured times) changes what a run costs and never what it keeps.

Repeated three-word windows are found inside each row from 64-bit hashes of
windows of word hashes, so nothing is shuffled; two different windows of one
document sharing a hash has odds below 1e-10 for the longest documents here.

Null and empty texts have no words and fail the base rule; repeated rows are
judged alike; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, release, store, table

SYMBOLS = "#*$%&|<>"
GAP_CHARS = " \t\n\x0b\f\r"
SAMPLE_ROWS = 2_000


def _count_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs`` as they came), text and the base measures."""
    text = F.col("text")
    first = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "row",
        "text",
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = first.select(
        "row", "text",
        F.size("words").cast("long").alias("n_words"),
        _count_without(text, GAP_CHARS).cast("long").alias("word_chars"),
        (F.length(text) - _count_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    last = F.greatest(F.col("n_words").cast("int") - 2, F.lit(1))
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(1), last),
                lambda i: F.xxhash64(F.get("hashes", i - 1), F.get("hashes", i), F.get("hashes", i + 1)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("hashes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_ = windows.withColumn(
        "order",
        F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    at = lambda i: F.get("order", i)["h"]
    places = sorted_.drop("windows").withColumn(
        "places",
        F.when(
            F.col("order").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter("order", lambda x, i: x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1))),
                    lambda x: x["i"],
                )
            ),
        ),
    ).drop("order")
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x.cast("long"),
    )
    return places.withColumn("n_repeat_words", F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("places")


def cascade_rules() -> dict[str, Column]:
    """Name -> acceptance; each is computed from the row only when asked."""
    text, words = F.col("text"), F.col("n_words")
    with_letter = lambda: F.size(F.filter(F.split(text, WORD_GAP), lambda w: w.rlike(r"\p{L}")))
    ellipsis = lambda: F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))
    return {
        "symbols": 100 * F.col("n_symbols") <= 10 * words,
        "word_length": (F.col("word_chars") >= 3 * words) & (F.col("word_chars") <= 12 * words),
        "duplicate_lines": 100 * F.col("n_dup_lines") <= 50 * F.col("n_lines"),
        "capitals": 100 * (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))) <= 30 * F.col("word_chars"),
        "letters": 100 * with_letter() >= 70 * words,
        "ellipses": 100 * ellipsis() <= 30 * F.col("n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def order_rules(measured: DataFrame, rules: dict[str, Column], costs: dict[str, float] | None = None) -> list[str]:
    """Rule names by rejections per second on ``measured`` (a sample); given
    ``costs`` replace the clock."""
    shares = measured.agg(
        *(F.avg((~F.coalesce(r, F.lit(True))).cast("double")).alias(n) for n, r in rules.items())
    ).first()

    def seconds(rule: Column) -> float:
        began = time.perf_counter()
        measured.agg(F.count_if(rule)).first()
        return time.perf_counter() - began

    if costs is None:
        idle = seconds(F.col("n_words") >= 0)
        costs = {n: max(min(seconds(r) for _ in range(2)) - idle, 1e-3) for n, r in rules.items()}
    return sorted(rules, key=lambda n: (-(shares[n] or 0.0) / costs[n], n))


def judged(docs: DataFrame, rules: dict[str, Column] | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """``measure`` with base_failed, rejected_by (the first rule that rejects) and kept."""
    rules = rules or cascade_rules()
    rows = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, 1.5 * SAMPLE_ROWS / max(rows, 1)), seed=7).limit(SAMPLE_ROWS)
    trial = store(measure(sample), "rule-sample")
    names = order_rules(trial, rules, costs)
    release(trial)
    verdict = F.when(base_failed(), F.lit("base"))
    for name in names:
        verdict = verdict.when(~F.coalesce(rules[name], F.lit(True)), F.lit(name))
    return measure(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, rejected_by and kept of every document."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]
    return judged(docs.select("doc_id", "text"), rules, costs).select("row.doc_id", *columns)


def keep_accepted(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with all their columns."""
    # a filter on computed arrays would be pushed below them and compute them once a word;
    # it cannot pass a column that is not deterministic
    found = judged(docs, rules).withColumn("task", F.spark_partition_id())
    return found.where(F.col("kept") & (F.col("task") >= 0)).select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, b.text, words,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(lines) AS BIGINT) AS n_lines, lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols <= 10 * n_words
    AND word_chars >= 3 * n_words AND word_chars <= 12 * n_words
    AND 100 * n_dup_lines <= 50 * n_lines
    AND 100 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) <= 30 * word_chars
    AND 100 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) >= 70 * n_words
    AND 100 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= 30 * n_lines
      AS accepted
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND accepted AS kept
FROM judged
"""
