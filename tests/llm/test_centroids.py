import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from ledgerloom.llm.centroids import above, assign, below, cluster, squared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def plain(rows, k, rounds, dims, scale=1024, seed=3):
    """Lloyd's rounds in Python integers, every distance computed."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(scale * float(np.float32(c))) for c in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = {c: sum(d for _, o, d in found if o == c) for c in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, by[c], sum(by.values()), names[c]) for i, c, d in found), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, x, 1, "q", 2) for i, x in rows], SCHEMA).repartition(3)
    got = cluster(df, **how).collect()
    return sorted((tuple(r)[:6] for r in got), key=str), got


def families(n, dims, seed, centres=5):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    return [(i, (middle[i % centres] + 0.2 * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_rounds_without_bounds_and_skips_distances(spark, seed):
    rows = families(160, 12, seed)
    got, full = run(spark, rows, k=6, rounds=5, dims=12)
    assert got == plain(rows, 6, 5, 12)
    assert full[0].distances_computed < 0.6 * 160 * 6 * 6


def test_ties_repeats_nulls_and_clashing_columns(spark):
    grid = [(i, [float(a), float(b)]) for i, (a, b) in enumerate((a, b) for a in range(-4, 5) for b in range(-4, 5))]  # many equal distances
    rows = grid + [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (900, None), (901, [1.0]), (902, [1.0, float("nan")]), (903, [1.0, None]), (904, [float("inf"), 0.0]), (905, []), (None, [0.5, 0.5])]
    for scale in (1, 2):
        got, _ = run(spark, rows, k=8, rounds=6, dims=2, scale=scale)
        assert got == plain(rows, 8, 6, 2, scale)


def test_empty_few_and_large(spark):
    assert run(spark, [(1, None)], k=3, rounds=2, dims=2)[0] == []
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert run(spark, few, k=8, rounds=3, dims=2)[0] == plain(few, 8, 3, 2)
    large = [(i, [3e4 * (-1) ** i, 1e5, float(i)]) for i in range(20)]
    assert run(spark, large, k=4, rounds=4, dims=3)[0] == plain(large, 4, 4, 3)
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [(1, [1e9, 0.0])], k=1, rounds=1, dims=2)


def test_bounds_hold_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.integers(-3, 4, (60, 2)).astype(np.int64)
        centres = rng.integers(-3, 4, (5, 2)).astype(np.int64)
        own, upper, lower = np.zeros(60, np.int32), np.full(60, np.inf), np.zeros((60, 5))
        for _ in range(4):
            own, upper, lower, _ = assign(x, own, upper, lower, centres)
            d = ((x[:, None] - centres) ** 2).sum(2)
            assert (own == d.argmin(1)).all()
            true = np.sqrt(d)
            assert (upper >= true[np.arange(60), own]).all()
            others = np.arange(5) != own[:, None]
            assert (lower <= true)[others].all()
            new = centres + rng.integers(-1, 2, centres.shape)
            moved = above(squared(new, centres))
            upper, lower, centres = upper + moved[own], np.maximum(0, lower - moved), new
    assert above(np.array([2**61 + 1])) > below(np.array([2**61 + 1]))


def test_query_equals_sql(spark, tmp_path):
    rows = families(90, 64, 8, 9) + [(500, None), (501, [0.5] * 63), (502, [0.5] * 63 + [None]), (503, [float("nan")] * 64), (3, [0.25] * 64)]
    spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = __spark_entry__.queries()["op13_centroids"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = con.execute(__spark_entry__.oracle_sql()["op13_centroids"])
    names = [c[0] for c in theirs.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(theirs.fetchall())
