import random
import re
import zlib
from collections import Counter

import numpy as np

from ledgerloom.llm import classifier, rules, sharding

from .conftest import edge_rows


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    hit = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def junk(rng):
    return " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 99)}{rng.choice(['###', '$$$', '&&&'])}" for _ in range(80))


def test_measures_equal_brute_force(spark, edge, nothing):
    texts = [t for _, t in edge_rows()] + ["a b c a b c a b c", "x y x y x y x", "l one\nl one\nl two\n\n \nl one", "q # | <b>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.judge(docs).collect():
        n = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert rules.judge(edge).count() == 15 and rules.judge(nothing).count() == 0
    kept = rules.keep_accepted(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {6, 7, 8, 9, 10}


def test_order_follows_rejections_per_cost(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, (junk(rng) + " CAPITALS" * 80 if i % 4 == 1 else junk(rng)) if i % 2 else " ".join(f"word{rng.randint(0, 500)}" for _ in range(90))) for i in range(60)], "doc_id long, text string")
    every = rules.cascade_rules()
    measured = rules.measure(docs)
    first = rules.order_rules(measured, every, dict.fromkeys(every, 1.0))
    assert first[0] == "symbols"
    costly = dict.fromkeys(every, 1.0) | {"symbols": 1e9}
    assert rules.order_rules(measured, every, costly)[0] == "capitals"
    a = {(r.doc_id, r.kept) for r in rules.judge(docs, costs=dict.fromkeys(every, 1.0)).collect()}
    b = {(r.doc_id, r.kept) for r in rules.judge(docs, costs=costly).collect()}
    assert a == b == {(i, i % 2 == 0) for i in range(60)}


def test_classifier_on_held_out_rows(spark, edge, nothing):
    rng = random.Random(2)
    rows = [(i, junk(rng) if i % 3 == 0 else " ".join(f"{rng.choice(['the', 'of'])} word{rng.randint(0, 999)}," for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 9) for i, _ in rows if i % 2] + [(1, None, 1), (9999, 1, 1)], "doc_id long, quality int, score int")
    ranker = classifier.fit(docs, labels)
    got = {r.doc_id: r for r in classifier.score(docs, ranker).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert classifier.score(edge, ranker).count() == 15 and classifier.score(nothing, ranker).count() == 0
    kept = classifier.keep_good(edge, ranker)
    assert kept.columns == edge.columns
    none = classifier.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in classifier.score(edge, none).collect()} == {0.7}


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    keys = np.array([0, 1, 7, 2**63, 2**64 - 1, *range(1000, 3000)], np.uint64)
    got = sharding.jump_hash(keys, 8)
    assert got.tolist() == [brute_jump(int(k), 8) for k in keys]
    grown = sharding.jump_hash(keys, 9)
    assert ((grown == got) | (grown == 8)).all()
    assert np.bincount(got).min() > 180


def test_sharding_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(sharding.ORACLE)
    names = [c[0] for c in found.description]
    got = sharding.op6_sharding(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(found.fetchall())


def test_shard_of_each_row_equals_brute_force(spark):
    ids = [0, 1, -1, -(2**63), 2**63 - 1, *range(10**12, 10**12 + 400)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.assign_shards(docs, 8).collect()}
    for i in ids:
        assert (got[i].shard, got[i].grown_shard) == (brute_jump(i % 2**64, 8), brute_jump(i % 2**64, 9))
        assert got[i].text_crc32 == zlib.crc32(f"text {i}".encode()) and got[i].law == "key"


def plain_ranking(rows, labels):
    """Weights by plain gradient descent, pair by pair in one matrix, and the
    quantile threshold, from the same statistics."""
    known = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    pairs = sorted((q, classifier.statistics(dict(rows)[i])) for i, q in known.items())
    x, y = np.array([s for _, s in pairs]), np.array([q for q, _ in pairs])
    ranker = classifier.Ranker(x, y)
    z = ranker.features(x)
    rng = np.random.default_rng(11)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    delta = z[rng.choice(good, classifier.PAIRS)] - z[rng.choice(bad, classifier.PAIRS)]
    w = ranker.weights
    gradient = -(delta / (1 + np.exp(delta @ w))[:, None]).mean(0) + 1e-3 * w
    assert np.abs(gradient).max() < 1e-5  # the minimum of a convex loss
    cut = np.quantile(z @ w, len(bad) / len(y))
    raw = {i: float(ranker.features(np.array([classifier.statistics(t)]))[0] @ w) for i, t in rows}
    return {i: 1 / (1 + np.exp(-np.clip(r - cut + np.log(0.7 / 0.3), -30, 30))) for i, r in raw.items()}


def test_classifier_query_equals_plain_ranking(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    expected = plain_ranking(rows, labels)
    got = classifier.op1_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert abs(r.score - expected[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_shards_have_gapless_slots(spark, edge, nothing):
    rows = sharding.assign_shards(edge, 4).collect()
    assert len(rows) == 15
    texts = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t in edge_rows())
    assert sorted((r.text_crc32, r["size"]) for r in rows) == texts
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(nothing).count() == 0
