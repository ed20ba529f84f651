import re
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import jaccard, neighbours
from ledgerloom.llm.components import connected_components

from .conftest import edge_rows


def sets_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, percent):
    sets = {k: sets_of(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_components_equal_brute_force(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    for percent, frequent in ((90, 6), (70, 3)):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, percent).collect()}
        assert got == brute(corpus, percent)
    kept = jaccard.keep_one_of_each(docs)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute(corpus, 90).values()}


def test_every_link_shares_a_signature():
    rng = np.random.default_rng(4)
    for n in (2, 3, 9, 10, 25, 60, 200, 900):
        for _ in range(40):
            base = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))[:n]
            lost = rng.integers(0, jaccard.slack(n, 90) // 2 + 1)
            other = np.unique(np.concatenate([rng.permutation(base)[lost:], rng.integers(0, 2**63, lost, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both < 90 * (len(base) + len(other) - both):
                continue
            hot = rng.random(len(base)) < rng.choice([0, 0.3, 1])
            often = set(base[hot].tolist())
            sig = []
            for s in (base, other):
                low = s[: jaccard._low_size(len(s), 90)]
                found = jaccard.signatures(low, np.array([x in often for x in low.tolist()], bool), len(s), 90)
                sig.append(jaccard.signatures(s, np.array([x in often for x in s.tolist()], bool), len(s), 90) if found is None else found)
            assert len(np.intersect1d(*sig)) or (base.tolist() == other.tolist())


def test_edge_cases(spark, edge, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(edge).collect()]
    assert len(got) == 15 and (None, 2, None) in got and (1, 0, 1) in got and (2, 0, 2) in got
    assert {c for d, _, c in got if d in (7, 8, 9, 10)} == {7} and len(edge_rows()) == 15
    assert jaccard.jaccard_components(nothing).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one_of_each(edge).collect()]
    assert sorted(k for k in kept if k) == [1, 2, 3, 4, 5, 6, 7, 11, 12, 50] and None in kept


def _just_below(copies, words=100, changed=6, families=1):
    """Copies of texts, each with words of its own at so many random places:
    two copies of one text differ in about twice as many."""
    rng, out = np.random.default_rng(9), []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(words)]
        for c in range(copies):
            own = list(base)
            for at in rng.choice(words, rng.integers(1, changed), replace=False):
                own[at] = f"x{rng.integers(1, 400)}"
            out.append(" ".join(own))
    return list(enumerate(out))


def brute_by_matrix(rows, percent, n=3):
    sets = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for _, t in rows]
    at = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    size, own = m.sum(1), np.arange(len(sets))
    both = m @ m.T
    link = 100 * both >= percent * (size[:, None] + size - both)
    while True:
        new = np.array([own[row].min() for row in link])
        if (new == own).all():
            return {k: (len(s), int(c)) for (k, _), s, c in zip(rows, sets, own)}
        own = new


@pytest.mark.parametrize("percent,families,copies", [(90, 1, 2000), (90, 40, 25), (94, 3, 150)])
def test_copies_just_below_the_threshold(spark, monkeypatch, percent, families, copies):
    corpus = _just_below(copies, families=families)
    asked = []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "HOT_ROWS", 300)
    monkeypatch.setattr(jaccard, "_links", lambda *a: (found := links(*a), asked.append(found[1]))[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(corpus, "doc_id long, text string"), percent).collect()}
    want = brute_by_matrix(corpus, percent)
    assert got == want and 10 < len({c for _, c in want.values()}) < len(corpus)
    assert sum(asked) < 20 * len(corpus)  # of nearly copies ** 2 / 2 pairs in each family


def test_counting_common_tokens_holds_a_slice_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 20_000, 5_000)) for _ in range(400)]
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    tracemalloc.start()
    both = jaccard._common_tokens(flat, sizes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000  # 88 million where all tokens were sorted at once
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in rng.integers(0, 400, (60, 2)))
    monkeypatch.setattr(jaccard, "SLICE_TOKENS", 70)
    few = jaccard._common_tokens(flat[: sizes[:3].sum()].astype(np.uint32), sizes[:3])
    assert (few == both[:3, :3])[~np.eye(3, dtype=bool)].all()  # the diagonal counts what any other set has


def test_groups_of_many_tokens_are_not_compared_in_one_task(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    count = jaccard._common_tokens
    monkeypatch.setattr(jaccard, "_common_tokens", lambda flat, sizes: (seen.add(len(flat) > 1000), count(flat, sizes))[1])
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 1000)
    corpus = _just_below(200, families=2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute_by_matrix(corpus, 90) and seen.value == 0


def test_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(5, a), (5, b), (6, a + " end"), (7, b + " end"), (8, "other words here"), (None, a)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(5, 58, 5), (5, 58, 5), (6, 59, 5), (7, 59, 5), (8, 1, 8)]


def test_component_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 16))
    x[400:480] = x[3] + 0.02 * rng.standard_normal((80, 16))
    x[480:490] = x[5]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9) & ~np.eye(500, dtype=bool)
    assert [got[i].n_links for i in range(500)] == links.sum(1).tolist()
    assert got[480].component_id == 5 and got[479].component_id == 3 and got[5].kept and not got[480].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def _families(rng, families, size):
    """Tight families (cosine about 0.99) in one true component: between them 0.92 to 0.96."""
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    out = []
    for _ in range(families):
        side = rng.standard_normal(64)
        side -= (side @ base) * base
        centre = base + 0.25 * side / np.linalg.norm(side)
        out.append(centre / np.linalg.norm(centre) + 0.0125 * rng.standard_normal((size, 64)))
    return np.concatenate(out)


def test_tight_families_are_joined(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([_families(rng, 2, 100), _families(rng, 10, 40), rng.standard_normal((300, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert links[:200].sum() > 200 * 150 and links[200:600].sum() > 400 * 250  # most cross pairs link
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    assert {got[i].component_id for i in range(200)} == {0} and {got[i].component_id for i in range(200, 600)} == {200}
    assert got[0].audited_recall == 1.0


def test_lengths_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COUNT_BLOCK", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(12) + 0.02 * rng.standard_normal((150, 12))
    tie = [[1.0, 0.0], [0.9, (1 - 0.81) ** 0.5], [0.0, -1.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, v) for i, v in enumerate(tie)]
    rows += [(300, [1.0, 2.0, 3.0]), (301, [2.0, 4.0, 6.0]), (302, [5.0, -1.0, 0.0]), (302, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, None)]
    got = {}
    for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert all(got[i] == [(149, 0)] for i in range(150))
    linked = got[200][0][0]  # rounding decides, but for every step alike
    assert linked in (0, 1) and got[200] == [(linked, 200)] and got[201] == [(linked, 200 if linked else 201)] and got[202] == [(0, 202)]
    assert got[300] == got[301] == [(2, 300)] and sorted(got[302]) == [(0, 302), (2, 300)] and got[None] == [(0, None)] * 2


def brute_force(rows, threshold=0.9):
    """(links, least reachable id) of every row, rows of one id kept apart."""
    x = np.array([v for _, v in rows], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    meets = x @ x.T >= threshold
    np.fill_diagonal(meets, False)
    least = [i for i, _ in rows]
    while True:
        new = [min([least[a], *(least[b] for b in np.flatnonzero(meets[a]))]) for a in range(len(rows))]
        if new == least:
            return sorted((i, int(meets[a].sum()), least[a]) for a, (i, _) in enumerate(rows))
        least = new


def run_rows(spark, rows):
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got), got


def test_rows_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01])]
    assert run_rows(spark, rows)[0] == brute_force(rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((6, 8))
    rows = [(int(i), (middle[n % 6] + 0.15 * rng.standard_normal(8)).tolist()) for n, i in enumerate(rng.integers(0, 25, 90))]
    rows += rows[:5]
    assert run_rows(spark, rows)[0] == brute_force(rows)


def test_a_search_that_finds_nothing_ends_in_exact_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AUDITS", 1)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "_closed", lambda nodes, kin, *a, **b: (nodes, kin))
    rows = [(i, [1.0, 0.03 * i]) for i in range(20)]
    found, got = run_rows(spark, rows)
    assert found == brute_force(rows) and got[0].audited_recall < 0.5  # of the search, before the exact blocks


def test_audits_take_all_ids_divisible_by_twenty(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(neighbours, "_audit", lambda nodes, *a, f=neighbours._audit, **b: (asked.append(nodes.where("asked").count()), f(nodes, *a, **b))[1])
    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 0.1 * i]) for i in range(100)]
    assert run_rows(spark, rows)[0] == brute_force(rows) and set(asked) == {5}
