"""Operator 11 - alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) encodes blank + text, tokenizer B (SentencePiece)
encodes the text and puts the blank before it itself.  Every byte gets a label:
``n`` no token ends here, ``a`` one of A, ``b`` one of B, ``x`` one of both.  A
regular expression cuts the label string behind every ``x``; the labels of a
span count the tokens of its group.  Every label but ``n`` also ends a stretch
of bytes that lies in one token of each side: a link.

Both tokenizers end a token before every blank or line end that follows another
character, so labels of such chunks do not depend on what stands around them:
different chunks are labelled once (many at a time, as one string) and a text is
put together from its chunks.  Texts where that does not hold (runs of blanks,
characters beyond ``WHOLE``) are labelled whole.

For the counts of id pairs, chunks are counted first, inside tasks and then by a
shuffle, so each different chunk of the corpus is labelled once; its links, times
its count, are summed the same way.  For the sums a text's links look up their pair's count: the ``MOST_HOT`` most
frequent pairs reach every task as a broadcast of bounded size, links of rarer
pairs are shuffled to their counts, so neither side has to fit anywhere.

Texts that are null, empty, or that a tokenizer does not give back byte for byte
(B turns its blank symbol into a blank) have no tokens: zeros and an empty hash
column.  Rows without an id, repeated rows and ids keep their own results; a
text is held whole, with its labels, by one task; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, give_back, release, slices_of, store, table
from .sentencepieces import BLANK, PieceEncoder
from .tokens import BpeEncoder, slices

#: Pairs of the broadcast; 17 bytes each.
MOST_HOT = 1 << 20
#: Different chunks a worker remembers; when full, it starts afresh.
MOST_CHUNKS = 600_000
#: A group in a label string without the places where no token ends.
_GROUP = re.compile("[ab]*x")
#: Texts that are labelled whole: runs of blanks, a blank at the beginning, and
#: characters whose class is not the same for both tokenizers at all times.
WHOLE = "[ \n]{2}|^[ \n]|[^\n\x20-\x7e\u00a1-\u024f]"
_LABELS = np.frombuffer(b"nabx", np.uint8)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable
    Latin-1 characters stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of a worker, and the chunks it has labelled."""

    _of: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = BpeEncoder.of(a_path), PieceEncoder.of(b_path)
        to_byte = byte_level()
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(to_byte[c] for c in n) if all(c in to_byte for c in n) else n.encode() for n in names]
        pieces = [self.b.library.id_to_piece(i) for i in range(self.b.library.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(BLANK, " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = [str(i) for i in range(len(names))], [str(i) for i in range(len(pieces))]
        self.lead = self.b.library.piece_to_id(BLANK)
        # every character of a chunk has pieces that give its bytes back
        self.by_chunk = self.b.by_unit and {f"<0x{i:02X}>" for i in range(256)} <= set(pieces)
        self.forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._of:
            cls._of[a_path, b_path] = cls(a_path, b_path)
        return cls._of[a_path, b_path]

    def forget(self) -> None:
        """Start afresh with no chunk remembered."""
        self.index: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links of each chunk
        self.groups: list[bytes] = []
        self.pairs: list[bytes] = []
        self.a.chunks.clear()
        self.b.units.clear()

    def labels(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """For each byte 0, 1 (A ends), 2 (B ends) or 3."""
        found = np.zeros(size, np.uint8)
        found[np.cumsum(self.a_sizes[a]) - 1] = 1
        found[np.cumsum(self.b_sizes[b]) - 1] += 2
        return found

    def scan(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray, grouped: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The text of every group (if ``grouped``) and the byte behind it, and the
        id pairs of all links (A's id times 2^32, plus B's)."""
        marked = labels[labels > 0]
        at_a, at_b = np.cumsum(marked & 1) - (marked & 1), np.cumsum(marked >> 1) - (marked >> 1)
        pairs = (a.astype(np.int64)[at_a] << 32) + b.astype(np.int64)[at_b]
        groups, i, j = [], 0, 0
        if grouped:
            a_names, b_names = list(map(self.a_names.__getitem__, a.tolist())), list(map(self.b_names.__getitem__, b.tolist()))
            for span in _GROUP.findall(_LABELS[marked].tobytes().decode()):
                if span == "x":
                    groups.append(f"{a_names[i]}|{b_names[j]};")
                    i, j = i + 1, j + 1
                    continue
                m, n = i + 1 + span.count("a"), j + 1 + span.count("b")
                groups.append(f"{','.join(a_names[i:m])}|{','.join(b_names[j:n])};")
                i, j = m, n
        return groups, np.flatnonzero(labels == 3) + 1, pairs

    def whole(self, text: str, grouped: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts, group texts and id pairs of one text."""
        raw = f" {text}".encode()
        a, b = np.frombuffer(self.a.whole([f" {text}"])[0], "<u4"), np.array(self.b.library.encode(text), "<u4")
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return np.zeros(4, np.int64), [], np.zeros(0, np.int64)
        groups, ends, pairs = self.scan(a, b, self.labels(a, b, len(raw)), grouped)
        return np.array([len(a), len(b), len(ends), len(pairs)], np.int64), groups, pairs

    def aligned(self, chunks: list[str], grouped: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks as one string: the texts of all groups, the pairs of all links,
        where each chunk's groups and links begin, and its tokens of A and B."""
        self.a._learn(set(chunks))
        b_ids = [list(x) for x in self.b.library.encode(chunks, num_threads=1)]
        for n, chunk in enumerate(chunks):
            if chunk == "":
                b_ids[n] = [self.lead]
            elif chunk[0] == "\n":  # the library's dummy prefix cannot merge with a line end
                b_ids[n] = b_ids[n][1:]
        raw = [(c if c[:1] == "\n" else f" {c}").encode() for c in chunks]
        a_ids = [self.a.chunks[c] for c in chunks]
        a, b = np.frombuffer(b"".join(a_ids), "<u4"), np.array([i for x in b_ids for i in x], "<u4")
        borders = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        if self.a_sizes[a].sum() != borders[-1] or self.b_sizes[b].sum() != borders[-1]:
            raise RuntimeError("a tokenizer does not give a chunk back")
        labels = self.labels(a, b, int(borders[-1]))
        groups, ends, pairs = self.scan(a, b, labels, grouped)
        self.a.chunks.clear()
        tokens = np.array([[len(x) // 4 for x in a_ids], [len(x) for x in b_ids]], np.int64)
        return groups, pairs, np.searchsorted(ends, borders, "right"), np.concatenate([[0], np.cumsum(labels > 0)])[borders], tokens

    def learn(self, chunks: list[str]) -> None:
        """Remember new chunks."""
        groups, pairs, group_at, link_at, tokens = self.aligned(chunks)
        first, packed = len(self.groups), pairs.tobytes()
        self.index.update((c, first + n) for n, c in enumerate(chunks))
        self.counts = np.concatenate([self.counts, np.stack([*tokens, np.diff(group_at), np.diff(link_at)], 1)])
        g, k = group_at.tolist(), (8 * link_at).tolist()
        self.groups += ["".join(groups[lo:hi]).encode() for lo, hi in zip(g[:-1], g[1:])]
        self.pairs += [packed[lo:hi] for lo, hi in zip(k[:-1], k[1:])]

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All chunks of texts one after the other, where each text's begin, and
        which texts are labelled whole.  Null and empty texts count as one chunk."""
        alone = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        if not self.by_chunk:
            alone = pc.binary_length(texts).to_numpy() > 0
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        return parts.flatten(), parts.offsets.to_numpy().astype(np.int64), alone


class Batch:
    """The chunks of a run of texts: ``chunk`` numbers the worker's chunks, one
    for each place, ``bounds`` the places of each text, ``alone`` the texts that
    are labelled whole.  Texts that are null or empty have no place."""

    def __init__(self, aligner: Aligner, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        flat, bounds, alone = aligner.split(texts)
        cut = np.repeat(~alone & (pc.binary_length(texts).to_numpy() > 0), np.diff(bounds))
        coded = flat.filter(pa.array(cut)).dictionary_encode()
        names = coded.dictionary.to_pylist()
        missing = [name for name in names if name not in aligner.index]
        for k in range(0, len(missing), 2000):
            aligner.learn(missing[k : k + 2000])
        number = np.array([aligner.index[name] for name in names], np.int64)
        self.aligner, self.texts, self.alone = aligner, texts, np.flatnonzero(alone)
        self.chunk = number[coded.indices.to_numpy()]
        self.bounds = np.concatenate([[0], np.cumsum(cut)])[bounds]

    def total(self, of_chunk: np.ndarray) -> np.ndarray:
        """Sums over each text of a number of its chunks."""
        found = np.concatenate([[0], np.cumsum(of_chunk[self.chunk])]) if len(self.chunk) else np.zeros(1, np.int64)
        return found[self.bounds[1:]] - found[self.bounds[:-1]]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def _counted_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(chunk, pair, n): how often each chunk stands in the texts that are cut, and
    the pairs of the others."""
    names = ["chunk", "pair", "n"]

    def run(batches):
        aligner = Aligner.of(a_path, b_path)
        for batch in batches:
            column = pc.fill_null(batch.column(0), "")
            for lo, hi in slices(column, 8_000_000):
                texts = column.slice(lo, hi - lo)
                flat, bounds, alone = aligner.split(texts)
                cut = np.repeat(~alone & (pc.binary_length(texts).to_numpy() > 0), np.diff(bounds))
                counts = flat.filter(pa.array(cut)).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), pa.nulls(len(counts), pa.int64()), counts.field("counts")], names=names)
                for i in np.flatnonzero(alone).tolist():
                    pairs, n = _summed(*(lambda x: (x, np.ones(len(x), np.int64)))(aligner.whole(texts[i].as_py(), grouped=False)[2]))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.string()), pa.array(pairs), pa.array(n)], names=names)
        give_back()

    return docs.select("text").mapInArrow(run, "chunk string, pair long, n long").groupBy("chunk", "pair").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): the links of every id pair over all texts."""

    def run(batches):
        aligner = Aligner.of(a_path, b_path)
        aligner.forget()
        keys: list[np.ndarray] = []
        weights: list[np.ndarray] = []

        def told():
            key, n = _summed(np.concatenate(keys), np.concatenate(weights))
            keys.clear()
            weights.clear()
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

        for batch in slices_of(batches, 4000):
            ready = batch.column("chunk").is_null()
            own = batch.filter(ready)
            if own.num_rows:
                keys.append(own.column("pair").to_numpy())
                weights.append(own.column("n").to_numpy())
            rest = batch.filter(pc.invert(ready))
            if rest.num_rows:
                _, pairs, _, link_at, _ = aligner.aligned(rest.column("chunk").to_pylist(), grouped=False)
                keys.append(pairs)
                weights.append(np.repeat(rest.column("n").to_numpy(), np.diff(link_at)))
            if sum(map(len, keys)) > 2_000_000:
                yield from told()
        if keys:
            yield from told()

    return _counted_chunks(docs, a_path, b_path).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Hot:
    """The broadcast pairs, sorted, with their counts and whether a pair's count
    is the highest of its B id."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and best of each pair (zero where it is not hot), and which are."""
        if not len(self.pair):
            none = np.zeros(len(pairs), np.int64)
            return none, none, none.astype(bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        hot = self.pair[at] == pairs
        return np.where(hot, self.n[at], 0), np.where(hot, self.best[at], 0).astype(np.int64), hot


def _scores(docs: DataFrame, a_path: str, b_path: str, shared) -> DataFrame:
    """Everything about a text but its links of rare pairs, which are listed."""

    def run(batches):
        aligner, hot = Aligner.of(a_path, b_path), shared.value
        aligner.forget()
        known = np.zeros((0, 2), np.int64)  # of each chunk: sum of counts, best links
        rare: dict[int, np.ndarray] = {}  # pairs of a chunk that are not hot
        for batch in slices_of(batches):
            for lo, hi in slices(batch.column("text")):
                if len(aligner.index) > MOST_CHUNKS:
                    aligner.forget()
                    known, rare = np.zeros((0, 2), np.int64), {}
                part = batch.slice(lo, hi - lo)
                found = Batch(aligner, part.column("text"))
                first = len(known)
                if len(aligner.groups) > first:
                    pairs = np.frombuffer(b"".join(aligner.pairs[first:]), "<i8")
                    n, best, there = hot.find(pairs)
                    borders = np.concatenate([[0], np.cumsum(aligner.counts[first:, 3])])
                    sums = [np.concatenate([[0], np.cumsum(x)])[borders] for x in (n, best, ~there)]
                    known = np.concatenate([known, np.stack([np.diff(x) for x in sums[:2]], 1)])
                    for k in np.flatnonzero(np.diff(sums[2])).tolist():
                        own = slice(borders[k], borders[k + 1])
                        rare[first + k] = pairs[own][~there[own]]
                yield _rows(part, found, known, rare, hot)
        aligner.forget()
        give_back()

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, found: Batch, known: np.ndarray, rare: dict[int, np.ndarray], hot: Hot) -> pa.RecordBatch:
    aligner = found.aligner
    numbers = [found.total(aligner.counts[:, k]) for k in range(4)]
    best, sums = found.total(known[:, 1]), found.total(known[:, 0])
    # the groups of all places, one after the other, and where each text's begin
    different, at = np.unique(found.chunk, return_inverse=True)
    column = pa.array([aligner.groups[k] for k in different.tolist()], pa.large_binary()).take(pa.array(at))
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = memoryview(column.buffers()[2]) if len(column) else memoryview(b"")
    cuts = offsets[found.bounds].tolist()
    digests = [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:])]
    lists: list[np.ndarray | None] = [None] * batch.num_rows
    if rare:
        flags = np.zeros(len(aligner.groups), bool)
        flags[list(rare)] = True
        places = np.flatnonzero(flags[found.chunk])
        of = np.searchsorted(found.bounds, places, "right") - 1
        own: dict[int, list[np.ndarray]] = {}
        for i, p in zip(of.tolist(), places.tolist()):
            own.setdefault(i, []).append(rare[int(found.chunk[p])])
        for i, x in own.items():
            lists[i] = np.concatenate(x)
    for i in found.alone.tolist():
        counts, groups, pairs = aligner.whole(found.texts[i].as_py())
        n, is_best, there = hot.find(pairs)
        for k in range(4):
            numbers[k][i] = counts[k]
        best[i], sums[i] = is_best.sum(), n.sum()
        digests[i] = hashlib.sha256("".join(groups)[:-1].encode()).hexdigest() if groups else ""
        lists[i] = pairs[~there] if not there.all() else None
    columns = [batch.column("row"), batch.column("doc_id"), *map(pa.array, (*numbers, best, sums)), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare"])


def align(docs: DataFrame, a_path: str, b_path: str, most_hot: int = MOST_HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = store(count_pairs(docs, a_path, b_path), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))  # at most the size of B's vocabulary
    judged = pairs.join(F.broadcast(top), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    found = judged.orderBy(F.desc("n"), "pair").limit(most_hot).toArrow()  # bounded by most_hot
    shared = spark.sparkContext.broadcast(Hot(*(found.column(c).to_numpy() for c in ("pair", "n", "best"))))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    scored = _scores(docs, a_path, b_path, shared)
    if found.num_rows < most_hot:  # every pair is hot: no list of rare ones can be filled
        release(pairs)
        return scored.select(*columns)
    scored = store(scored, "aligned")
    rest = scored.where("rare IS NOT NULL").select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("m"))
    late = rest.join(judged, "pair").groupBy("row").agg(F.sum(F.col("m") * F.col("n")).alias("late_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("late_best"))
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    own = {"n_best": more("n_best", "late_best"), "count_sum": more("count_sum", "late_sum")}
    return scored.join(late, "row", "left").select(*(own.get(c, F.col(c)) for c in columns))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
