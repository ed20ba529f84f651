"""Operator 5 - best-fit packing by patterns and non-negative least squares.

Pieces of at most ``capacity`` tokens are packed into sequences from their
length histogram alone: patterns that no further piece fits into are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded up, largest first, as far as the histogram holds them,
and the residual lengths are packed by best fit, largest first, a whole run of equal lengths at
a time.  A fit counts only if it needs no more sequences than best fit alone.
The plan is a table of (length, rank range) -> (sequence, offset) whose size
depends on the capacity and not on the number of documents.

Null and empty texts are one piece that holds only the end id; documents longer
than the capacity are cut from the right, so only the first piece is shorter;
repeated rows and rows without an id are packed as rows of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, store, table
from .tokens import CACHE_CHUNKS, SLICE, BpeEncoder, slices

CAPACITY = 2048
#: Lengths that open patterns and patterns tried in a round.  They bound the fit,
#: not what is packed: best fit takes whatever the patterns leave.
PATTERN_LENGTHS, PATTERNS = 160, 1500
#: Rows of (task, length) counts that are broadcast to the pieces; more are merged by key.
BROADCAST_ROWS = 500_000


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient descent."""
    gram, target = a.T @ a, a.T @ b
    probe = np.ones(a.shape[1])
    for _ in range(20):  # power iteration for the step size; row sums bound it from above
        probe = gram @ probe
        probe /= np.linalg.norm(probe) or 1.0
    bound = min(1.05 * float(probe @ gram @ probe), float(np.abs(gram).sum(1).max())) or 1.0
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - (gram @ y - target) / bound)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def patterns(lengths: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns into which no further piece fits, least waste first: one or two
    common lengths, one of them repeated, and the longest pieces that still fit."""
    full = sorted(lengths)
    common = sorted(lengths, key=lambda n: (-n * lengths[n], n))[:PATTERN_LENGTHS]
    found = set()

    def close(parts: list[int]) -> None:
        """The pattern with its rest closed by the longest pieces that fit."""
        rest = capacity - sum(parts)
        while rest >= full[0]:
            n = full[bisect.bisect_right(full, rest) - 1]
            parts, rest = parts + [n] * (rest // n), rest % n
        need = Counter(parts)
        if all(c <= lengths[n] for n, c in need.items()):
            found.add(tuple(sorted(parts, reverse=True)))

    for i, a in enumerate(common):
        close([a])
        close([a] * (capacity // a))
        for b in common[: i + 1]:
            if a + b <= capacity:
                close([a, b])
                close([a] + [b] * ((capacity - a) // b))
                close([b] + [a] * ((capacity - b) // a))
    return sorted(found, key=lambda p: (capacity - sum(p), len(p), p))[:PATTERNS]


Segment = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """(length, first rank, count, first sequence, offset) segments that place
    every piece of the histogram once."""
    plans = [_plan(histogram, capacity, waste) for waste in (capacity, 0, -1)]
    return min(plans, key=_sequences)  # with patterns where that costs nothing


def _sequences(segments: list[Segment]) -> int:
    return max((first + count for _, _, count, first, _ in segments), default=0)


def _plan(histogram: dict[int, int], capacity: int, waste: int) -> list[Segment]:
    """A plan with patterns of at most so much waste (below 0: none)."""
    left = {n: c for n, c in histogram.items() if c}
    taken: Counter = Counter()
    segments, sequence = [], 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        segments.append((length, taken[length], count, first, offset))
        taken[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    if capacity in left:
        count = left[capacity]
        put(capacity, count, sequence, 0)
        sequence += count
    for _ in range(3):
        options = [p for p in patterns(left, capacity) if capacity - sum(p) <= waste] if left and waste >= 0 else []
        if not options:
            break
        rows = sorted({n for p in options for n in p})
        at = {n: i for i, n in enumerate(rows)}
        a = np.zeros((len(rows), len(options)))
        for k, p in enumerate(options):
            for n in p:
                a[at[n], k] += 1
        weight = np.array([n / capacity for n in rows])  # long pieces matter most
        fit = nnls(a * weight[:, None], np.array([left[n] for n in rows]) * weight)
        for k in sorted(range(len(options)), key=lambda k: (capacity - sum(options[k]), -fit[k])):
            need = Counter(options[k])
            repeat = min([math.ceil(fit[k] - 0.01), *(left.get(n, 0) // c for n, c in need.items())])
            if repeat < 1:
                continue
            offset = 0
            for n in options[k]:
                put(n, repeat, sequence, offset)
                offset += n
            sequence += repeat
    # residual: best fit decreasing over groups of equal sequences, by what they still hold
    room: dict[int, list[list[int]]] = {}
    free: list[int] = []

    def add(space: int, first: int, count: int) -> None:
        if space:
            if space not in room:
                bisect.insort(free, space)
                room[space] = []
            room[space].append([first, count])

    for length in sorted(left, reverse=True):
        while count := left.get(length, 0):
            i = bisect.bisect_left(free, length)
            if i == len(free):
                fits = capacity // length
                bins, extra = divmod(count, fits)
                for full, per in ((bins, fits), (1 if extra else 0, extra)):
                    if full:
                        for k in range(per):
                            put(length, full, sequence, k * length)
                        add(capacity - per * length, sequence, full)
                        sequence += full
                continue
            space = free[i]
            group = room[space][-1]
            used = min(count, group[1])
            put(length, used, group[0], capacity - space)
            add(space - length, group[0], used)
            group[0], group[1] = group[0] + used, group[1] - used
            if not group[1]:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    free.remove(space)
    return segments


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cache: int = CACHE_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, block, place: ``place`` numbers
    the pieces of one length within one task."""

    bound_batches(docs.sparkSession)
    def run(batches):
        encoder, block = BpeEncoder.of(tokenizer, cache), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        taken = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc, place = [], [], [], [], [], []
            for lo, hi in slices(texts, SLICE):
                for i, ids in enumerate(encoder.encode(texts[lo:hi]), lo):
                    ids += end
                    total = len(ids) // 4
                    first = (total - 1) % capacity + 1
                    for k, at in enumerate([0, *range(first, total, capacity)]):
                        size = first if k == 0 else capacity
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        place.append(taken[size])
                        taken[size] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([block] * len(row), pa.int32()),
                    pa.array(place, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"],
            )
        if cache < CACHE_CHUNKS:
            encoder.forget()

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long, block int, place long"
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, cache: int = CACHE_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``cache`` is
    how many different chunks a worker remembers (memory against time); fewer
    than usual are also given up at the end of each task."""
    spark = docs.sparkSession
    pieces = store(tokenised_pieces(docs, tokenizer, capacity, end_id, cache), "pieces")
    counts = store(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = sorted(plan(histogram, capacity))
    packed = np.array(segments, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(packed)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = counts.count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(offsets) if few else offsets.hint("merge"), ["block", "length"])

    def place(batches):
        rows = shared.value
        first = {int(n): i for i, n in reversed(list(enumerate(rows[:, 0])))}
        last = {int(n): i + 1 for i, n in enumerate(rows[:, 0])}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("base").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                at[own] = first[n] + np.searchsorted(rows[first[n] : last[n], 1], rank[own], side="right") - 1
            sequence, offset = rows[at, 3] + rank - rows[at, 1], rows[at, 4]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place", "base").mapInArrow(
        place, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
