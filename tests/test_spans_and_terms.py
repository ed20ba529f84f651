import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import spans, terms
from ledgerloom.operators.terms import Terms, gazetteer, term_spans
from ledgerloom.plans import reports

from .test_results import plain_sanitize


def test_twenty_thousand_spans_in_one_text(spark):
    rng = random.Random(4)
    parts = [rng.choice([f"{rng.randrange(10**9):09d}", f"{rng.randrange(100):02d}-{rng.randrange(10**7):07d}", f"a{rng.randrange(9000)}@x.org", f"{rng.randrange(10**16):016d}", "10.0.0.7", "word"]) for _ in range(26_000)]
    text = " ".join(parts)
    df = spark.createDataFrame([(text,), ("",), (None,), ("nothing",)], "text string").coalesce(1)
    found = {r.text: r for r in spans.sanitize(df).select("text", "sanitized_text", "entities_total", "entities_redacted").collect()}
    assert found[text].entities_total > 16_000
    few = text[:60_000]
    row = spans.sanitize(spark.createDataFrame([(few,)], "text string")).first()
    assert (row.sanitized_text, row.entities_total, row.entities_redacted) == plain_sanitize(few)
    assert found[None].sanitized_text is None and found[""].sanitized_text == "" and found["nothing"].entities_total == 0
    n = 20_000
    starts = [rng.randrange(10**6) for _ in range(n)]
    began = time.process_time()
    taken = spans.chosen_places(starts, [s + rng.randrange(1, 60) for s in starts], [rng.random() for _ in range(n)], list(range(n)))
    assert time.process_time() - began < 2 and len(taken) > n / 10


def test_choice_equals_looking_at_all_that_is_taken():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(0, 14)
        starts = [rng.randrange(20) for _ in range(n)]
        ends = [s + rng.randrange(1, 6) for s in starts]
        scores = [rng.choice([0.4, 0.5, 0.9]) for _ in range(n)]
        slow: list[int] = []
        for i in sorted(range(n), key=lambda i: (-scores[i], starts[i], i)):
            if not any(starts[j] < ends[i] and starts[i] < ends[j] for j in slow):
                slow.append(i)
        assert spans.chosen_places(starts, ends, scores, list(range(n))) == slow


def test_borders_are_ascii_in_every_engine(spark):
    df = spark.createDataFrame([("é1234567890123456é x1234567890123456 12-3456789ß _12-3456789",)], "text string")
    found = df.select(F.explode(spans.detect(F.col("text"))).alias("s")).select("s.entity_type", "s.text_snippet").collect()
    assert sorted(map(tuple, found)) == [("CREDIT_CARD", "1234567890123456"), ("EIN", "12-3456789")]


TERMS = ["he", "she", "hers", "his", "é", "aa", "a", " ", "日本", "", "she said"]
TEXTS = ["ushers and she said hers", "aaa", "", "é日本é", "his/her he", None, "none", "she  said aa he_ he"]


def brute(text, words):
    edge = lambda c: c == "_" or c.isascii() and c.isalnum()
    out = []
    for t in filter(None, TERMS):
        for a in range(len(text) - len(t) + 1):
            b = a + len(t)
            if text[a:b] == t and not (words and (a and edge(text[a - 1]) and edge(t[0]) or b < len(text) and edge(text[b]) and edge(t[-1]))):
                out.append((t, a, b))
    return sorted(out)


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("most", [terms.MOST_CHARACTERS, 6])
def test_terms_equal_brute_force(spark, words, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    table = spark.createDataFrame([(t,) for t in [*TERMS, "he", None]], "term string")
    found = term_spans(docs, table, whole_words=words, most=most).collect()
    assert sorted((r.id, r.term, r.start, r.end) for r in found) == sorted((i, *m) for i, t in enumerate(TEXTS) if t for m in brute(t, words))
    assert term_spans(docs, table.limit(0)).count() == 0 and term_spans(docs.limit(0), table).count() == 0


def test_random_terms_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = list({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(5)})
        text = "".join(rng.choices("ab", k=40))
        expected = sorted((a, a + len(w), i) for i, w in enumerate(words) for a in range(41 - len(w)) if text.startswith(w, a))
        assert sorted(Terms(words).matches(text)) == expected


def test_recall_equals_comparing_all_pairs(spark):
    labels = ["the", "he", "the", "", "no such", None]
    rows = [(1, "the end"), (1, "he"), (2, None), (3, ""), (None, "other")]
    got = {r.id: r for r in reports.recall(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(x,) for x in labels], "expected string")).collect()}
    for key in {r[0] for r in rows}:
        pairs = [x in t if t is not None and x is not None else None for k, t in rows if k == key for x in labels]
        known = [p for p in pairs if p is not None]
        assert (got[key].hits, got[key].total, got[key].accuracy) == (sum(known), len(pairs), sum(known) / len(known) if known else None)


def test_a_gazetteer_finds_people_places_and_groups(spark):
    names = spark.createDataFrame([("Ann Lee", "PERSON", 0.85), ("Lee", "LOCATION", 0.6), ("Basque", "NRP", 0.7), ("Lee", "PERSON", 0.5), ("", "PERSON", 1.0)], "term string, entity_type string, score double")
    find = gazetteer(names)
    docs = spark.createDataFrame([("Ann Lee of Lee, a Basque; Leeds, 12-3456789.",)], "text string")
    row = spans.sanitize(docs, provider=lambda text: F.concat(spans.detect(text), find(text))).first()
    assert row.sanitized_text == "<PERSON_1> of <LOCATION_1>, a <NRP_1>; Leeds, <EIN_1>."
    with pytest.raises(ValueError, match="term_spans"):
        Terms(["x" * (terms.MOST_CHARACTERS + 1)])
