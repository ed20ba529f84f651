"""Operator 1 - quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document marked good over one marked bad) are drawn from
labelled rows; the logistic loss on feature differences gives the weights of a
linear document score.  The score's quantile at the share of bad labels is the
threshold, and a logistic map puts it at 0.7, so ``predicted`` is "at or above
the threshold".

Features are text statistics and their distances from the typical value; labels,
lang, source and doc_id are no inputs.  The fit uses at most ``max_labelled``
labelled rows, those with the smallest hash of their id; scores cover all rows.

Null and empty texts have all-zero statistics and get a score; without labels of
both kinds every score is 0.7; labelled rows without a text, a label or a
document are left out of the fit; repeated rows score alike; an empty table
gives no rows; clashing or extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, give_back, remainder, table
from .tokens import slices

MAX_LABELLED, PAIRS, THRESHOLD = 20_000, 200_000, 0.7
#: Characters counted as symbols, digits and sentence marks.
_KINDS = {"symbol": "#*$%&|<>{}[]=_~^\\/@+", "digit": "0123456789", "mark": ".,;:", "shout": "!?"}
_DROP = {k: {ord(c): None for c in v} for k, v in _KINDS.items()}


def statistics(text: str | None) -> list[float]:
    """Shape of a text: sizes, shares of character kinds, repetition."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 15
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    lower = sum(raw.count(c) for c in b"aeiou")
    kinds = [(chars - len(text.translate(_DROP[k]))) / n for k in _KINDS]
    changed = sum(a != b for a, b in zip(text, text.lower())) if len(text.lower()) == chars else 0
    top = max(counts.values())
    same = sum(map(str.__eq__, words, words[1:]))
    trigrams = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(c for c in trigrams.values() if c > 1)
    return [
        np.log1p(n), sum(map(len, words)) / n, *kinds, changed / chars, 1 - len(set(lines)) / len(lines),
        len(counts) / n, len(counts) / n**0.8, top / n, same / n, repeated / n, np.log1p(max(map(len, counts))),
        lower / len(raw),
    ]


class Ranker:
    """Standardises statistics, scores them, and knows its threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.fitted = len(good) > 0 and len(bad) > 0
        if not self.fitted:
            return
        self.middle = np.median(x, 0)
        self.spread = np.maximum(np.median(np.abs(x - self.middle), 0), 0.02)
        z = self.features(x)
        rng = np.random.default_rng(seed)
        delta = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        self.weights = self._fit(delta)
        raw = z @ self.weights
        self.threshold = float(np.quantile(raw, len(bad) / len(y)))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.spread
        return np.concatenate([np.clip(z, -4, 4), np.log1p(np.abs(z)), np.log1p(np.maximum(z - 3, 0)), np.log1p(np.maximum(-z - 3, 0))], 1)

    @staticmethod
    def _fit(delta: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
        """Newton steps on the mean of log(1 + exp(-w.delta)) + ridge |w|^2 / 2."""
        w = np.zeros(delta.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(delta @ w, -30, 30)))
            gradient = -(delta * p[:, None]).mean(0) + ridge * w
            hessian = (delta * (p * (1 - p))[:, None]).T @ delta / len(delta) + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), THRESHOLD)
        margin = self.features(x) @ self.weights - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _statistics_of(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), 15)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """A ranker from labelled rows outside the held-out fold."""
    bound_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(max_labelled)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            x = _statistics_of(batch.column("text").to_pylist())
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 15), pa.int32()), flat)],
                names=["quality", "x"],
            )

    # at most max_labelled small rows
    rows = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(run, f"quality {labels.schema['quality'].dataType.simpleString()}, x array<double>").collect()
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    return Ranker(np.array([r["x"] for r in rows]).reshape(-1, 15), np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score and predicted of every document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                found = shared.value(_statistics_of(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )
        give_back()

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` at or above the threshold, with all their columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [shared.value(_statistics_of(texts[lo:hi])) for lo, hi in slices(texts)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= THRESHOLD))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, ranker).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )
