"""Operator 13 - centroid clustering (Lloyd's rounds) with Elkan bounds.

Components become integers, so distances and centroids are exact.  Every vector
carries, from round to round, its cluster, an upper bound of the distance to its
own centroid and a lower bound for every other one.  A centroid is passed over
where the triangle inequality proves it farther: the upper bound is below its
lower bound, or below half the distance between the two centroids.  Bounds are
doubles rounded away from the true value (``SLACK``) and the comparisons are
strict, so a tie is never pruned and the smaller number wins exactly.

A round is one pass over a stored table, without a shuffle of vectors: a task
writes its vectors with their new bounds, and one row a cluster with the sum and
the number of vectors that came minus those that went.  The driver sees only
these totals: at most ``k`` clusters of ``dims`` numbers.  A task that is lost
is run again from the table of the round before.

Vectors that are null, of another length, or hold null or non-finite components
are left out; rows without an id are clustered, and start centroids only where
too few rows have one; repeated ids and vectors are rows of their own (equal
hashes: by the bytes of the vector); with fewer than ``k`` vectors there are as
many clusters as vectors; an empty table gives no rows; other columns are not
read.  A component of 2^27 or more stops the run: distances would not be sure to
fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, release, slices_of, store, table

#: Relative room for the rounding of a square root and of one sum of doubles.
SLACK = 2.0**-48
LARGEST = 2**27
STATE = "vec_id long, v binary, cluster int, upper double, lower binary, distance long, came array<bigint>"


def _integers(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * component) as 32-bit integers, usable rows only."""

    def run(batches):
        for batch in slices_of(batches, 4000):
            ids, column = batch.column(0), batch.column(1)
            sizes = column.value_lengths().fill_null(-1).to_numpy()
            at = np.flatnonzero(sizes == dims)
            flat = column.take(pa.array(at)).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null components become NaN
            good = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[good])
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component of {np.abs(x).max():.0f}: distances of components of {LARGEST} or more may not fit a long")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[good])), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary")


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of centres, one to one."""
    off = x - centres
    return np.einsum("ij,ij->i", off, off)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, upper, lower) of vectors x whose bounds hold for ``centres``,
    and the number of distances that were computed."""
    k = len(centres)
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    halves = below(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)) / 2
    apart = np.where(np.eye(k, dtype=bool), np.inf, halves).min(axis=1) if k > 1 else np.array([np.inf])
    open_ = np.flatnonzero(upper >= apart[own])
    best = np.full(len(x), -1, np.int64)  # exact distance to the own centroid, where known
    computed = 0
    for c in range(k):
        wanted = lambda rows, c=c: rows[(own[rows] != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= halves[own[rows], c])]
        rows = wanted(open_)
        loose = rows[best[rows] < 0]
        if len(loose):  # the exact distance may close the case
            best[loose] = squared(x[loose], centres[own[loose]])
            upper[loose], lower[loose, own[loose]] = above(best[loose]), below(best[loose])
            computed += len(loose)
            rows = wanted(rows)
        if not len(rows):
            continue
        d = squared(x[rows], centres[c])
        computed += len(rows)
        lower[rows, c] = below(d)
        wins = (d < best[rows]) | ((d == best[rows]) & (c < own[rows]))
        rows, d = rows[wins], d[wins]
        own[rows], best[rows], upper[rows] = c, d, above(d)
    return own, upper, lower, computed


def _round(vectors: DataFrame, before: np.ndarray | None, centres: np.ndarray, final: bool) -> DataFrame:
    """One pass: bounds follow the centroids from ``before`` to ``centres``,
    vectors are assigned, and each task adds its totals."""
    k, dims = centres.shape

    def run(batches):
        came = np.zeros((k, dims + 2), np.int64)  # sums, vectors, computed distances
        if before is not None:
            moved = above(((centres - before) ** 2).sum(axis=1))
        for batch in slices_of(batches, 4000):
            if not batch.num_rows:
                continue
            raw = batch.column("v")
            x = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            if before is None:
                own = np.zeros(len(x), np.int32)
                upper, lower = np.full(len(x), np.inf), np.zeros((len(x), k))
            else:
                own = batch.column("cluster").to_numpy()
                upper = (batch.column("upper").to_numpy() + moved[own]) * (1 + SLACK)
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<f8").reshape(-1, k)
                lower = np.maximum(0.0, (lower - moved) * (1 - SLACK))
            new, upper, lower, tried = assign(x, own, upper, lower, centres)
            came[0, dims + 1] += tried
            changed = np.arange(len(x)) if before is None else np.flatnonzero(new != own)
            for c in range(k):
                to, gone = changed[new[changed] == c], changed[own[changed] == c] if before is not None else changed[:0]
                came[c, :dims] += x[to].sum(axis=0) - x[gone].sum(axis=0)
                came[c, dims] += len(to) - len(gone)
            distance = pa.array(squared(x, centres[new])) if final else pa.nulls(len(x), pa.int64())
            rows = pa.array([r.tobytes() for r in lower], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw, pa.array(new), pa.array(upper), rows, distance, pa.nulls(len(x), pa.list_(pa.int64()))], schema=_SCHEMA)
        told = [pa.nulls(k, f.type) for f in _SCHEMA]
        told[2], told[6] = pa.array(np.arange(k), pa.int32()), pa.array(list(came), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(told, schema=_SCHEMA)

    return vectors.mapInArrow(run, STATE)


_SCHEMA = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("distance", pa.int64()), ("came", pa.list_(pa.int64()))])


def _totals(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """The sum of all tasks' totals, as exact integers of any size."""
    parts = state.where("came IS NOT NULL").select("cluster", F.posexplode("came").alias("at", "x"))
    sums = np.zeros((k, dims + 2), object)
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums[r["cluster"], r["at"]] = int(r["x"])
    return sums


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and
    ``distances_computed``, the number of distances that all rounds computed."""
    bound_batches(rows.sparkSession)
    kept = store(_integers(rows, dims, scale), "integer-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.withColumn("h", hashed).orderBy(F.col("h").asc_nulls_last(), F.hex("v")).limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, distances_computed long"
    if not first:
        release(kept)
        return rows.sparkSession.createDataFrame([], schema)
    centres = np.array([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    k, before, state = len(centres), None, kept
    totals = np.zeros((k, dims + 2), object)
    for turn in range(rounds + 1):
        vectors = state if before is None else state.where("v IS NOT NULL").select("vec_id", "v", "cluster", "upper", "lower")
        new = store(_round(vectors, before, centres, turn == rounds), "bounds")
        release(state)
        state = new
        totals = totals + _totals(state, k, dims)
        if turn < rounds:
            before = centres
            centres = np.array([own[:dims] // own[dims] if own[dims] else old for own, old in zip(totals, before)], np.int64)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    found = state.where("v IS NOT NULL")
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows
    named = rows.sparkSession.createDataFrame([(c, inertia.get(c, 0), digests[c]) for c in range(k)], "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256",
        F.lit(int(totals[0, dims + 1])).cast("long").alias("distances_computed"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("distances_computed")


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds without bounds, every distance computed."""
    steps = [
        f"""vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dims})""",
        "parts AS MATERIALIZED (SELECT r, i, v[i] AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM vectors))",
        f"""first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c FROM vectors
  QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, i, v[i] AS x FROM (SELECT c, v, unnest(range(1, len(v) + 1)) AS i FROM first))",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT p.r, q.c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM parts p JOIN c{n} q ON p.i = q.i GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s.t - (s.t % s.n + s.n) % s.n) // s.n, o.x) AS x FROM c{n} o LEFT JOIN
  (SELECT a.c, p.i, sum(p.x) AS t, count(*) AS n FROM parts p JOIN a{n} a ON p.r = a.r GROUP BY ALL) s ON s.c = o.c AND s.i = o.i)""")
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(steps) + f""",
named AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} a JOIN vectors USING (r) JOIN named n ON n.c = a.c"""
    )


#: DuckDB SQL of the query.
ORACLE = _oracle()
