import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i % 7} gamma{i}" for i in range(40))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, a null id."""
    texts = [None, "", "  \n\t ", "a", "a b", LONG, PROSE, PROSE, PROSE.replace("alpha3 ", "ALPHA3 "), PROSE + " more", "x\x0by\x1cz é ü", "a  b\n\n c"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return [*rows, (None, "no id at all"), (50, "twice the same row"), (50, "twice the same row")]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    columns = "doc_id long, text string, n_words long, words string, row int, block int, score double, kept boolean, component string, signature int"
    return spark.createDataFrame([(i, t, 7, "q", 1, 2, 0.5, False, "c", 3) for i, t in edge_rows()], columns)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, block int")


@pytest.fixture(scope="session")
def corpus():
    """A few hundred texts with exact and near copies and a shared passage."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "the of and to in is for on with by".split() for b in "ab cd ef gh ij kl mn op".split()]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for i in range(240):
        own = rng.choices(words, k=rng.randint(1, 160))
        if i % 5 == 0:
            own += passage.split()
        texts.append(" ".join(own))
    for i in range(60):
        own = texts[i % 12 + 100].split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    return [(i * 3, t) for i, t in enumerate(texts)]
