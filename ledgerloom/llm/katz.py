"""Operator 9 - Katz backoff language model (bigrams over words and an end).

Training counts come from every document outside the held-out fold.  Counts of
at most five are discounted by Good-Turing ratios; with one added to each
denominator every history keeps some mass, and backoff weights are normalised
exactly:

  P(w)    = d1(c) c / (N + 1), an unknown word gets what is left of 1
  P(w|h)  = d2(c) c / (c(h) + 1)            for a seen pair
          = alpha(h) P(w)                    otherwise, with
  alpha(h) = (1 - sum of seen P(.|h)) / (1 - sum of P(w) over seen w)

A text's score is the sum over its tokens; each token is evaluated by recursion
from pair to word.  Words are 64-bit hashes.

How it is spread: tokens are dealt by word (words above a share of all tokens,
a bounded list, by pair), so each part of the pair table is complete where the
tokens that ask for it arrive; a token's terms that belong to its word or pair
are added there.  What an unseen pair needs from its history (held-out texts
only) is a second, smaller deal by history.  The word table, the pair stage
and its history part are Parquet tables in the shared folder, partitioned by
kind; nothing grows on the driver except sums.

Null and empty texts have one token, the end; rows that share an id count as
one document whose figures add up; null ids are left out; with no training
rows every score is 0; an empty table gives no rows; only doc_id and text are
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, mix, release, remainder, store, table

END, BEGIN = np.uint64(0x5E5E5E5E00000001), np.uint64(0x5E5E5E5E00000002)
#: Counts up to here are discounted.
CUT = 5
#: A word with more than this share of all tokens is dealt by pair; so many at most.
HOT_SHARE = 1 / 4000
CHUNK_TOKENS, FLUSH_ROWS = 600_000, 500_000
#: Bits of a number that holds bucket, word and history of a token while sorting.
FIELDS = 64
_A = np.uint64(0x9E3779B97F4A7C15)
_SUMS = ["n_tokens", "n_known", *(f"k{r}" for r in range(1, CUT + 1))]


def good_turing(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Discount ratios by count 0..CUT (index 0 unused); where the counts of
    counts give no ratio in (0, 1), half a count is taken off."""
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, CUT + 2)]
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = np.ones(CUT + 1)
    for r in range(1, CUT + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return out


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1)
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.int64 and a.dtype != np.uint64 and len(a):
            a = a.astype(np.min_scalar_type(int(a.max())))
        if a.dtype == np.int64 and len(a):  # ids: differences
            a = np.diff(a, prepend=np.int64(0))
        raw = squeeze.compress(a.tobytes())
        parts.append(len(raw).to_bytes(4, "little") + a.dtype.str[1:].encode().ljust(2) + raw)
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at, open_ = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        kind = blob[at + 4 : at + 6].decode().strip()
        a = np.frombuffer(open_.decompress(blob[at + 6 : at + 6 + size]), kind)
        out.append(np.cumsum(a) if kind == "i8" else a)
        at += 6 + size
    return out


def _training(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), 7) != 2).alias("train")
    )


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over the training rows, stored."""

    def run(batches):
        held, size = [], 0

        def flush():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(word_hashes(text))
                size += len(held[-1])
                if size > 2 * CHUNK_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counted = rows.where("train").select("text").mapInArrow(run, "word long, n long")
    return store(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


class Words:
    """What a task knows of the word level: sums and the frequent words."""

    def __init__(self, total: int, types: int, counts_of_counts: dict[int, int], hot: list[tuple[int, int]]):
        self.total, self.types = total, types
        self.discount = good_turing(counts_of_counts)
        freed = sum(counts_of_counts.get(r, 0) * r * (1 - self.discount[r]) for r in range(1, CUT + 1))
        self.unknown = (1 + freed) / (total + 1)
        order = sorted((np.uint64(w & 0xFFFFFFFFFFFFFFFF), n) for w, n in hot)
        self.hot = np.array([w for w, _ in order], np.uint64)
        self.hot_counts = np.array([n for _, n in order], np.int64)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        ratio = np.where(counts <= CUT, self.discount[np.minimum(counts, CUT)], 1.0)
        return np.where(counts > 0, ratio * counts / (self.total + 1), self.unknown)

    def find_hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are frequent, and their counts (0 for others)."""
        if not len(self.hot):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        found = self.hot[at] == words
        return found, np.where(found, self.hot_counts[at], 0)


def word_level(counts: DataFrame) -> Words:
    sums = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("types"), *(F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, CUT + 2))
    ).first()
    total = sums["total"] or 0
    # at most 1 / HOT_SHARE words have that share
    hot = counts.where(F.col("n") > total * HOT_SHARE).select("word", "n").collect()
    return Words(total, sums["types"], {r: sums[f"n{r}"] for r in range(1, CUT + 2)}, [(r["word"], r["n"]) for r in hot])


def _deal_pairs(rows: DataFrame, words, buckets: int) -> DataFrame:
    """(bucket, blob): the tokens of a chunk of documents, sorted by pair."""

    def encode(ids: list[int], train: list[bool], tokens: list[np.ndarray]):
        sizes = np.array([len(t) for t in tokens])
        w = np.concatenate(tokens)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[np.cumsum(sizes) - sizes] = BEGIN
        hot = words.value.find_hot(w)[0]
        with np.errstate(over="ignore"):
            bucket = (mix(np.where(hot, w * _A + h, w)) % np.uint64(buckets)).astype(np.uint64)
        names, inverse = np.unique(np.concatenate([w, h]), return_inverse=True)
        wid, hid = inverse[: len(w)].astype(np.uint64), inverse[len(w) :].astype(np.uint64)
        width = np.uint64(int(len(names)).bit_length())
        if int(buckets).bit_length() + 2 * int(width) <= FIELDS:
            order = np.argsort((bucket << (width + width)) | (wid << width) | hid, kind="stable")
        else:  # more words or buckets than one number holds
            order = np.lexsort((hid, wid, bucket))
        bucket, wid, hid, doc = (x[order] for x in (bucket, wid, hid, doc))
        # one posting for each pair and document; a word's or pair's bucket is its own
        new_pair = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (wid[1:] != wid[:-1]) | (hid[1:] != hid[:-1])])
        new_post = new_pair | np.concatenate([[True], doc[1:] != doc[:-1]])
        at = np.flatnonzero(new_post)
        count = np.diff(at, append=len(order)).astype(np.uint32)
        doc = doc[at]
        pair_at = np.flatnonzero(new_pair[at])
        posts = np.diff(pair_at, append=len(at)).astype(np.uint32)
        pair_bucket, pair_w, pair_h = (x[at[pair_at]].astype(np.int64) for x in (bucket, wid, hid))
        cuts = np.concatenate([np.flatnonzero(np.diff(pair_bucket, prepend=-1)), [len(pair_w)]])
        post_at = np.concatenate([pair_at, [len(at)]])
        ids_, train_ = np.array(ids, np.int64), np.array(train, np.uint8)
        by_id = np.argsort(ids_, kind="stable")
        rank = np.empty(len(ids_), np.int64)
        rank[by_id] = np.arange(len(ids_))
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = post_at[a], post_at[b]
            used, local = np.unique(rank[doc[lo:hi]], return_inverse=True)
            w_at = np.concatenate([np.flatnonzero(np.diff(pair_w[a:b], prepend=-1)), [b - a]])
            yield int(pair_bucket[a]), _pack(
                ids_[by_id][used], train_[by_id][used], names[pair_w[a:b][w_at[:-1]]], np.diff(w_at).astype(np.uint32),
                names[pair_h[a:b]], posts[a:b], local.astype(np.uint32), count[lo:hi],
            )

    def run(batches):
        ids, train, tokens, size = [], [], [], 0

        def flush():
            for bucket, blob in encode(ids, train, tokens):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])
            ids.clear(), train.clear(), tokens.clear()

        for batch in batches:
            for key, text, known in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                ids.append(key)
                train.append(known)
                tokens.append(word_hashes(text))
                size += len(tokens[-1])
                if size >= CHUNK_TOKENS:
                    yield from flush()
                    size = 0
        if ids:
            yield from flush()

    return rows.select("doc_id", "text", "train").mapInArrow(run, "bucket int, blob binary")


class _Sums:
    """Rows of sums by a key, merged as they come and flushed when many."""

    def __init__(self, width: int):
        self.keys, self.rows = np.empty(0, np.int64), np.empty((0, width))

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        every = np.concatenate([self.keys, keys])
        self.keys, inverse = np.unique(every, return_inverse=True)
        stacked = np.concatenate([self.rows, rows])
        self.rows = np.stack([np.bincount(inverse, weights=stacked[:, c], minlength=len(self.keys)) for c in range(stacked.shape[1])], 1)


    def packed(self, buckets: int):
        """(bucket, blob) of all rows, emptied: whole numbers first, two real columns last."""
        part = (mix(self.keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(part):
            at = np.flatnonzero(part == b)
            whole = [self.rows[at, c].astype(np.uint32) for c in range(self.rows.shape[1] - 2)]
            yield int(b), _pack(self.keys[at], *whole, self.rows[at, -2], self.rows[at, -1])
        self.__init__(self.rows.shape[1])


def _score_pairs(dealt: DataFrame, words, buckets: int) -> DataFrame:
    """The pair stage: kind ``doc`` has sums of documents, ``history`` packed
    sums of histories, ``unseen`` packed events, ``pairs`` counts of counts."""

    def batch_of(kind: str, bucket: list[int], blob: list[bytes | None], n: list[int] | None = None) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(bucket)), pa.array(bucket, pa.int32()), pa.array(n or [None] * len(bucket), pa.int64()), pa.array(blob, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "n", "blob"])

    def run(batches):
        model = words.value
        docs, pairs = _Sums(len(_SUMS) + 2), np.zeros(CUT + 2, np.int64)
        histories: list[tuple[np.ndarray, ...]] = []
        unseen: list[tuple[np.ndarray, ...]] = []

        def flush_docs():
            for b, blob in docs.packed(buckets):
                yield batch_of("doc", [b], [blob])

        def flush_events():
            """Histories and unseen events of all buckets so far, by history bucket."""
            h, r, p = (np.concatenate(x) for x in zip(*histories)) if histories else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
            names, inverse = np.unique(h, return_inverse=True)
            sums = [np.bincount(inverse, weights=r == k, minlength=len(names)).astype(np.uint32) for k in range(1, CUT + 1)]
            mass = np.bincount(inverse, weights=p, minlength=len(names))
            part = (mix(names) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(part):
                at = np.flatnonzero(part == b)
                yield batch_of("history", [int(b)], [_pack(names[at], *(s[at] for s in sums), mass[at])])
            histories.clear()
            if unseen:
                h, d, n = (np.concatenate(x) for x in zip(*unseen))
                part = (mix(h) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((d, h, part))
                h, d, n, part = h[order], d[order], n[order], part[order]
                cuts = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    used, local = np.unique(d[a:b], return_inverse=True)
                    at = np.concatenate([np.flatnonzero(np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]])), [b - a]])
                    blob = _pack(h[a:b][at[:-1]], np.diff(at).astype(np.uint32), used, local.astype(np.uint32), n[a:b].astype(np.uint32))
                    yield batch_of("unseen", [int(part[a])], [blob])
                unseen.clear()

        def one_bucket(blobs: list[bytes]) -> int:
            parts = [_unpack(b) for b in blobs]
            w = np.concatenate([np.repeat(p[2], p[3].astype(np.int64)) for p in parts])
            h = np.concatenate([p[4] for p in parts])
            posts = np.concatenate([p[5] for p in parts]).astype(np.int64)
            first = np.cumsum([0, *(len(p[0]) for p in parts)])
            doc = np.concatenate([p[6].astype(np.int64) + f for p, f in zip(parts, first)])
            count = np.concatenate([p[7] for p in parts]).astype(np.int64)
            ids, train = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
            wu, wid = np.unique(w, return_inverse=True)
            hu, hid = np.unique(h, return_inverse=True)
            key, pid = np.unique(wid.astype(np.int64) * len(hu) + hid, return_inverse=True)
            of = np.repeat(np.arange(len(posts)), posts)  # chunk pair of each posting
            trained = np.bincount(of, weights=count * train[doc], minlength=len(posts))
            c = np.bincount(pid, weights=trained, minlength=len(key)).astype(np.int64)
            pair_w, pair_h = key // len(hu), key % len(hu)
            is_hot, hot_count = model.find_hot(wu)
            cw = np.where(is_hot, hot_count, np.bincount(pair_w, weights=c, minlength=len(wu)).astype(np.int64))
            p1 = model.probability(cw)
            for r in range(1, CUT + 2):
                pairs[r] += int((c == r).sum())
            seen = c > 0
            histories.append((hu[pair_h[seen]], np.minimum(c[seen], CUT + 1), p1[pair_w[seen]]))
            post_pair, post_w = pid[of], wid[of]
            pc, pw = c[post_pair], cw[post_w]
            new = pc == 0
            logs = np.where(new, np.log10(p1[post_w]), np.where(pc > CUT, np.log10(np.maximum(pc, 1)), 0.0))
            # as the next token's history, every word but the end; the first history is added here too
            logs = logs - np.where(wu[post_w] != END, np.log10(pw + 1), 0.0)
            begin = np.searchsorted(hu, BEGIN)
            if begin < len(hu) and hu[begin] == BEGIN:
                logs = logs - np.where(hid[of] == begin, model.begin, 0.0)
            columns = [count, count * (pw > 0), *(count * (pc == r) for r in range(1, CUT + 1)), count * np.log10(pw + 1), count * logs]
            sums = np.stack([np.bincount(doc, weights=x, minlength=len(ids)) for x in columns], 1)
            docs.add(ids, sums)
            if new.any():
                at = np.flatnonzero(new)
                unseen.append((h[of[at]], ids[doc[at]], count[at]))
            return int(seen.sum())

        held, bucket, rows = [], None, 0
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket and held:
                    rows += one_bucket(held)
                    held = []
                    if len(docs.keys) > FLUSH_ROWS:
                        yield from flush_docs()
                    if rows > 2 * FLUSH_ROWS:
                        yield from flush_events()
                        rows = 0
                bucket = b
                held.append(blob)
        if held:
            one_bucket(held)
        yield from flush_docs()
        yield from flush_events()
        yield batch_of("pairs", list(range(1, CUT + 2)), [None] * (CUT + 1), pairs[1:].tolist())

    return dealt.mapInArrow(run, "kind string, bucket int, n long, blob binary")


def _back_off(stage: DataFrame, discount: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob): what unseen pairs add to documents for their histories."""

    def run(batches):
        added = _Sums(len(_SUMS) + 2)

        def flush():
            for b, blob in added.packed(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        def one_bucket(parts: list[list[np.ndarray]], events: list[list[np.ndarray]]) -> None:
            if not events:
                return
            names, weight = np.empty(0, np.uint64), np.empty(0)
            if parts:
                names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                freed = sum(r * (1 - discount[r]) * np.concatenate([p[r] for p in parts]) for r in range(1, CUT + 1))
                freed = np.bincount(inverse, weights=freed, minlength=len(names))
                mass = np.bincount(inverse, weights=np.concatenate([p[-1] for p in parts]), minlength=len(names))
                weight = np.log10((1 + freed) / (1 - mass))
            for e in events:
                h = np.repeat(e[0], e[1].astype(np.int64))
                at = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
                own = np.where(names[at] == h, weight[at], 0.0) if len(names) else np.zeros(len(h))
                rows = np.zeros((len(e[2]), len(_SUMS) + 2))
                rows[:, -1] = np.bincount(e[3], weights=own * e[4], minlength=len(e[2]))
                added.add(e[2], rows)

        bucket, parts, events = None, [], []
        for batch in batches:
            for b, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
                if b != bucket:
                    one_bucket(parts, events)
                    parts, events = [], []
                    if len(added.keys) > FLUSH_ROWS:
                        yield from flush()
                bucket = b
                (parts if kind == "history" else events).append(_unpack(blob))
        one_bucket(parts, events)
        yield from flush()

    return stage.mapInArrow(run, "bucket int, blob binary")


def _documents(dealt: DataFrame) -> DataFrame:
    """One row per document from all its packed sums."""

    def one_bucket(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack(b) for b in blobs]
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([p[c] for p in parts]), minlength=len(keys)) for c in range(1, len(_SUMS) + 3)]
        columns = [keys, *(x.astype(np.int64) for x in sums[: len(_SUMS)]), *sums[len(_SUMS) :]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", *_SUMS, "base", "logs"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket and held:
                    yield one_bucket(held)
                    held = []
                bucket = b
                held.append(blob)
        if held:
            yield one_bucket(held)

    return dealt.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", base double, logs double")


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _training(docs)
    counts = count_words(rows)
    level = word_level(counts)
    level.begin = float(np.log10(rows.where("train").count() + 1))
    release(counts)
    words = spark.sparkContext.broadcast(level)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    # many small parts of the large deal; fewer of what follows, as every task writes to each
    buckets, later_buckets = 8 * tasks, 2 * tasks
    dealt = _deal_pairs(rows, words, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    stage = store(_score_pairs(dealt, words, later_buckets), "pair-stage", partition_by=("kind",))
    sums = stage.where("kind = 'pairs'").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    discount = good_turing({r["bucket"]: r["n"] for r in sums})
    later = stage.where("kind in ('history', 'unseen')").select("bucket", "kind", "blob")
    extra = _back_off(later.repartition(tasks, "bucket").sortWithinPartitions("bucket"), discount, later_buckets)
    both = stage.where("kind = 'doc'").select("bucket", "blob").unionByName(extra)
    total = _documents(both.repartition(tasks, "bucket").sortWithinPartitions("bucket"))
    seen = sum((F.col(f"k{r}") * F.lit(float(np.log10(discount[r] * r))) for r in range(1, CUT + 1)), F.lit(0.0))
    return total.select(
        "doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(level.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(level.total + level.types + 1)))).alias("base_score"),
        (F.col("logs") + seen).alias("score"),
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
