"""Many terms looked for in one pass over each text.

The terms make an Aho-Corasick automaton, built once per Python worker; a text is
read once, whatever the number of terms.  A list goes to the tasks inside the
function, so its size is checked; a larger table of terms is dealt into blocks
that each fit, and the texts are read once a block (``term_spans``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .spans import SPAN_TYPE

#: Characters of the terms that one automaton holds.
MOST_CHARACTERS = 20_000_000
#: Automata a worker remembers.
_KEPT = 4
_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(terms: list[str], name: str) -> ahocorasick.Automaton:
    """The automaton of ``terms`` (different, none empty), which knows each term's
    place; ``name`` tells lists apart."""
    if name not in _automata:
        if len(_automata) >= _KEPT:
            _automata.pop(next(iter(_automata)))
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(term, i)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _word(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum()


class Terms:
    """A list of terms of checked size; empty terms stand in every text."""

    def __init__(self, terms: list[str], whole_words: bool = False):
        size = sum(map(len, terms))
        if size > MOST_CHARACTERS:
            raise ValueError(f"{size} characters of terms; one list holds {MOST_CHARACTERS}, term_spans any number")
        self.terms, self.whole_words = terms, whole_words
        self.sizes = list(map(len, terms))
        self.name = hashlib.sha256("\0".join(terms).encode()).hexdigest()
        self.every = [i for i, t in enumerate(terms) if not t]

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, place of the term) of every occurrence, overlapping ones
        too, by end and then the longest first."""
        filled = [t for t in self.terms if t]
        if not filled:
            return
        places = [i for i, t in enumerate(self.terms) if t] if self.every else None
        for last, i in automaton(filled, self.name).iter(text):
            i = places[i] if places else i
            start, end = last + 1 - self.sizes[i], last + 1
            if self.whole_words and (
                start and _word(text[start - 1]) and _word(text[start]) or end < len(text) and _word(text[end]) and _word(text[end - 1])
            ):
                continue
            yield start, end, i

    def found(self, text: Column) -> Column:
        """The places of the terms that a text holds, in order; null for no text."""

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            out = [None if t is None else sorted({i for *_, i in self.matches(t)} | set(self.every)) for t in texts.to_pylist()]
            return pa.array(out, pa.list_(pa.int32()))

        return run(text)

    def weight(self, text: Column, weights: list[int]) -> Column:
        """The sum of the weights of the terms that a text holds."""

        @F.arrow_udf("long")
        def run(texts: pa.Array) -> pa.Array:
            out = [None if t is None else sum(weights[i] for i in {i for *_, i in self.matches(t)} | set(self.every)) for t in texts.to_pylist()]
            return pa.array(out, pa.int64())

        return run(text)

    def spans(self, text: Column, types: list[str], scores: list[float]) -> Column:
        """A provider's spans: every occurrence with its term's type and score."""
        kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text_snippet", pa.string())]))

        @F.arrow_udf(f"array<{SPAN_TYPE}>")
        def run(texts: pa.Array) -> pa.Array:
            one = lambda t, a, b, i: {"entity_type": types[i], "start": a, "end": b, "score": scores[i], "text_snippet": t[a:b]}
            return pa.array([None if t is None else [one(t, *m) for m in sorted(self.matches(t))] for t in texts.to_pylist()], kind)

        return run(text)


def gazetteer(terms: DataFrame, whole_words: bool = True):
    """A provider for ``spans.sanitize`` from a table of terms (term, entity_type,
    score) of checked size, such as names of people (PERSON), places (LOCATION)
    and groups (NRP)."""
    ship_package(terms.sparkSession)
    size = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"{size} characters of terms; one list holds {MOST_CHARACTERS}, term_spans any number")
    usable = terms.where("term <> ''").groupBy("term").agg(F.max_by(F.struct("entity_type", "score"), F.struct("score", "entity_type")).alias("r"))
    rows = usable.select("term", "r.*").orderBy("term").collect()  # bounded by MOST_CHARACTERS
    made = Terms([r["term"] for r in rows], whole_words)
    types, scores = [r["entity_type"] for r in rows], [float(r["score"]) for r in rows]
    return lambda text: made.spans(text, types, scores)


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text", whole_words: bool = False, most: int = MOST_CHARACTERS) -> DataFrame:
    """Every occurrence of any number of terms: the other columns of ``docs``, and
    term, start and end.  Null texts and empty or null terms find nothing."""
    spark = docs.sparkSession
    ship_package(spark)
    usable = terms.where("term <> ''").select("term").distinct()
    size = usable.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = -(-size // most) * (2 if size > most else 1)  # twice as many as needed: hashing does not fill them evenly
    keys = [c for c in docs.columns if c != text]
    found = []
    for k in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).orderBy("term")
        own = Terms([r["term"] for r in block.collect()], whole_words)  # bounded: one block
        marked = docs.select(*keys, F.explode(own.spans(F.col(text), [""] * len(own.terms), [1.0] * len(own.terms))).alias("s"))
        found.append(marked.select(*keys, F.col("s.text_snippet").alias("term"), "s.start", "s.end"))
    none = docs.select(*keys, F.lit("").alias("term"), F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    return reduce(DataFrame.unionByName, found, none)
