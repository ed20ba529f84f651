"""Operator 7 - embedding near-duplicates by NN-descent.

1. Equal vectors form a class with a number of its own, by which the graph is
   keyed: ids may repeat, classes do not.
2. A neighbour graph starts from random hyperplane cells (small blocks compared
   inside), then NN-descent refines it: each node compares its neighbours and
   reverse neighbours with each other and offers every pair the better edge.
   A node whose whole list reaches the threshold is saturated and its list is
   enlarged.  Rounds go on while they find links.
3. Edges at or above the threshold (double precision) give the components.
4. A full list holds only the closest rows, so links between tight families may
   lie outside it.  The search is therefore run again with lists that hold only
   rows of other components (the old lists serve as ways), links found there
   join components, and so on until a search finds none.  No list has to hold a
   whole family, however large it is.
5. Inside a component every pair is counted exactly, in blocks of bounded size,
   so link counts do not depend on list lengths.
6. Recall is audited against brute force: every class with an id divisible by 20
   (``EVERY``) is a query against all classes, in blocks of ``QUERIES``.  Links
   that an audit finds between components join them, and search and audit follow
   anew until an audit misses nothing.  If ``AUDITS`` of them have missed links,
   the last one takes every class as a query, which is exact.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are kept, and so do rows without an id; vectors of different lengths
do not link, those of one length are searched on their own; equal vectors link;
rows with one id are vectors of their own, each with its own links; an empty
table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, release, store, table
from .components import connected_components

LIST, ENLARGED, TABLES, BLOCK, AUDITS = 8, 32, 6, 512, 6
#: One in so many ids is audited, so many classes at a time.
EVERY, QUERIES = 20, 4096
#: Rows of a component that are counted against as many others in one task.
COUNT_BLOCK = 4096
#: Cosines so near the threshold are computed again row by row, so that every
#: step decides alike.
NEAR = 1e-9


def _matrix(column, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v: the unit vector's doubles as bytes, or null."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                ok = x is not None and len(x) > 0 and None not in x
                v = np.array(x, np.float64) if ok else np.zeros(1)
                top = np.abs(v).max() if np.isfinite(v).all() else 0.0
                if not top > 0:
                    out.append(None)
                    continue
                v = v / top  # no overflow or underflow in the norm
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v binary")


def _cells(nodes: DataFrame, dims: int, bits: int, tables: int, seed: int) -> DataFrame:
    planes = np.random.default_rng(seed).standard_normal((tables, dims, bits))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dims, "<f8")
            for t in range(tables):
                code = ((x @ planes[t]) > 0) @ (1 << np.arange(bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code + (t << 40)), batch.column("id"), batch.column("c"), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())],
                    names=["cell", "id", "c", "v"],
                )

    return nodes.select("id", "c", "v").mapInArrow(run, "cell long, id long, c long, v binary")


def _start(nodes: DataFrame, dims: int, rows: int, k: int, seed: int) -> DataFrame:
    """Edges to the best rows of other components (c) in small blocks of cells."""
    bits = max(1, int(np.ceil(np.log2(max(2, rows / 128)))))
    cells = store(_cells(nodes, dims, bits, TABLES, seed), "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    split = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))

    def best(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        x = _matrix(group.column("v").combine_chunks(), dims, "<f4")
        take = min(k, len(ids) - 1)
        if take < 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        s, own = x @ x.T, group.column("c").to_numpy()
        s[own[:, None] == own] = -2
        at = np.argpartition(-s, take - 1, axis=1)[:, :take]
        best = np.take_along_axis(s, at, 1).ravel()
        apart = best > -2
        return pa.table({"a": np.repeat(ids, take)[apart], "b": ids[at].ravel()[apart], "s": best[apart]})

    found = split.groupBy("cell", "part").applyInArrow(best, "a long, b long, s float")
    return found.groupBy("a", "b").agg(F.max("s").alias("s"))


def _best(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best edges of every node: k, or ENLARGED where k all reach the threshold."""
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ENLARGED)
    return ranked.where((F.col("r") <= k) | (F.col("s") >= threshold)).select("a", "b", "s")


def _descend(graph: DataFrame, kin: DataFrame | None, nodes: DataFrame, dims: int, k: int) -> DataFrame:
    """One round: neighbours (either way) of each node, and its ``kin`` (edges
    inside components), are compared with each other across components."""
    ways = graph.select("a", "b", "s").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), F.xxhash64("b"))
    near = ways.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k).select("a", "b")
    if kin is not None:
        own = graph.select("a").distinct()
        near = near.unionByName(kin.join(own, "a", "left_semi").select("a", "b")).unionByName(own.select("a", F.col("a").alias("b"))).distinct()
    floor = graph.groupBy("a").agg(F.min("s").alias("floor")).select(F.col("a").alias("b"), "floor")
    narrow = nodes.select(F.col("id").alias("b"), "c", "v").join(floor, "b", "left")
    groups = near.join(narrow, "b").groupBy("a").agg(F.collect_list(F.struct("b", "c", "v", "floor")).alias("near"))

    def run(batches):
        for batch in batches:
            column = batch.column("near")
            flat, bounds = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            ids, own = flat.field("b").to_numpy(), flat.field("c").to_numpy()
            x = _matrix(flat.field("v"), dims, "<f8").astype(np.float32)
            floors = np.nan_to_num(flat.field("floor").to_numpy(zero_copy_only=False).astype(np.float32), nan=-2)
            a, b, s = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                sim = x[lo:hi] @ x[lo:hi].T
                sim[own[lo:hi, None] == own[lo:hi]] = -3
                i, j = np.nonzero(sim > floors[lo:hi, None])
                a.append(ids[lo + i])
                b.append(ids[lo + j])
                s.append(sim[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x_)) for x_ in (a, b, s)], names=["a", "b", "s"])

    offers = groups.mapInArrow(run, "a long, b long, s float")
    return graph.unionByName(offers).groupBy("a", "b").agg(F.max("s").alias("s"))


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``threshold``."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - threshold) < NEAR)
    s[i, j] = np.einsum("ij,ij->i", x[i], y[j])
    return s >= threshold


def _exact_edges(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges whose cosine in double precision reaches the threshold."""
    rough = edges.where(F.col("s") >= threshold - 1e-3).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = rough.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dims = len(batch.column("x")[0].as_py()) // 8
                x, y = _matrix(batch.column("x"), dims, "<f8"), _matrix(batch.column("y"), dims, "<f8")
                good = pa.array(np.einsum("ij,ij->i", x, y) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _count_links(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(id, links): for each node the rows it links with in its component,
    counted block by block; ``members`` has component, id, v, copies."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("parts"))
    placed = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a block meets every block of its component once; small components share groups
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", "id", "v", "copies", "part",
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(4096)).cast("long")).otherwise(F.col("component")).alias("bucket"),
        (F.col("parts") == 1).alias("small"),
    )

    def count(group: pa.Table) -> pa.Table:
        component, part = group.column("component").to_numpy(), group.column("part").to_numpy()
        order = np.lexsort((part, component))
        component, part, ids, copies = (group.column(c).to_numpy()[order] for c in ("component", "part", "id", "copies"))
        x = _matrix(group.column("v").combine_chunks(), dims, "<f8")[order]
        bounds = np.flatnonzero(np.diff(component, prepend=component.min() - 1, append=component.max() + 1))
        links = np.zeros(len(ids), np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            # one part with itself, or two parts with each other
            cut = lo + int(np.searchsorted(part[lo:hi], part[lo], "right"))
            left, right = ((lo, hi), (lo, hi)) if cut == hi else ((lo, cut), (cut, hi))
            for i in range(left[0], left[1], BLOCK):
                for j in range(right[0], right[1], BLOCK):
                    a, b = slice(i, min(i + BLOCK, left[1])), slice(j, min(j + BLOCK, right[1]))
                    meets = _reaches(x[a], x[b], threshold)
                    if cut == hi:
                        meets &= ids[a, None] != ids[b]
                    else:
                        links[b] += meets.T @ copies[a]
                    links[a] += meets @ copies[b]
        return pa.table({"id": ids, "links": links})

    return dealt.groupBy("small", "bucket", "i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _search(nodes: DataFrame, kin: DataFrame | None, dims: int, rows: int, k: int, threshold: float, rounds: int, seed: int) -> DataFrame:
    """NN-descent among different components: (a, b, s)."""
    graph = store(_best(_start(nodes, dims, rows, k, seed), k, threshold), "graph")
    known = graph.where(F.col("s") >= threshold).count()
    for _ in range(rounds):
        new = store(_best(_descend(graph, kin, nodes, dims, k), k, threshold), "graph")
        release(graph)
        graph, before = new, known
        known = graph.where(F.col("s") >= threshold).count()
        if known - before <= 0.01 * known:
            break
    return graph


def _join(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` after links between components (a, b are components) joined them."""
    joined = connected_components(links).withColumnRenamed("node", "c")
    out = store(nodes.join(joined, "c", "left").select("id", "v", "copies", "asked", F.coalesce("component", "c").alias("c")), "nodes")
    release(nodes)
    return out


def _closed(nodes: DataFrame, kin: DataFrame | None, dims: int, rows: int, k: int, threshold: float, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Searches and joins until a search finds no link between components;
    returns the nodes with their components, and the k best edges met inside."""
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    while True:
        graph = _search(nodes, kin, dims, rows, k, threshold, rounds, seed)
        links = store(_exact_edges(graph, nodes, threshold), "embedding-links")
        if links.isEmpty():
            release(links, graph)
            return nodes, kin
        left, right = (nodes.select(F.col("id").alias(c), F.col("c").alias(f"c{c}")) for c in "ab")
        between = store(links.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "component-links")
        nodes = _join(nodes, between)
        near = graph.where(F.col("s") >= threshold)
        near = near if kin is None else near.unionByName(kin)
        kin_ = store(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("a", "b", "s"), "kin")
        release(links, between, graph, *([] if kin is None else [kin]))
        kin, seed = kin_, seed + 1


def _audit(nodes: DataFrame, dims: int, threshold: float, every_node: bool = False) -> DataFrame:
    """(a, b, n): brute-force links of the queries, counted by the components of
    both ends; a row with a <> b holds missed links."""
    asked = nodes if every_node else nodes.where("asked")
    blocks = store(asked.select("id", "v", "c").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // QUERIES))))), "queries")
    found = []
    for block in sorted(r[0] for r in blocks.select("block").distinct().collect()):  # a row a block
        queries = blocks.where(F.col("block") == block).select("id", "v", "c").collect()  # about QUERIES rows
        q = np.frombuffer(b"".join(r["v"] for r in queries), "<f8").reshape(-1, dims)
        names, own = np.array([r["id"] for r in queries], np.int64), np.array([r["c"] for r in queries], np.int64)

        def run(batches, q=q, names=names, own=own):
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(lo, BLOCK)
                    ids, c = part.column("id").to_numpy(), part.column("c").to_numpy()
                    i, j = np.nonzero(_reaches(_matrix(part.column("v"), dims, "<f8"), q, threshold))
                    keep = ids[i] != names[j]
                    ends, n = np.unique(np.stack([own[j[keep]], c[i[keep]]], 1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        found.append(store(nodes.select("id", "c", "v").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "audit"))
    release(blocks)
    none = nodes.sparkSession.createDataFrame([], "a long, b long, n long")
    return reduce(DataFrame.unionByName, found, none)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, k: int = LIST, rounds: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall."""
    bound_batches(rows.sparkSession)
    vectors = store(_unit_vectors(rows), "vectors")
    usable = vectors.where("v is not null and vec_id is not null")
    lengths = sorted(r[0] for r in usable.select(F.octet_length("v")).distinct().collect())  # mostly one
    alone = vectors.where("v is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audited_recall")
    )
    found = [_of_one_length(usable.where(F.octet_length("v") == n), n // 8, threshold, k, rounds) for n in lengths]
    return reduce(DataFrame.unionByName, found, alone)


def _of_one_length(usable: DataFrame, dims: int, threshold: float, k: int, rounds: int) -> DataFrame:
    """The result for stored unit vectors (vec_id, v) of one length."""
    asked = F.bool_or(F.col("vec_id") % EVERY == 0).alias("asked")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), asked)
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    nodes = store(classes.select("id", "v", "copies", "asked", F.col("id").alias("c")), "nodes")
    count, kin, recall = nodes.count(), None, 1.0
    for turn in range(AUDITS if count else 0):
        nodes, kin = _closed(nodes, kin, dims, count, k, threshold, rounds, seed=5 + 100 * turn)
        exact = turn == AUDITS - 1
        audit = _audit(nodes, dims, threshold, every_node=exact)
        links, hits = audit.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0))).first()
        recall = hits / links if links else 1.0
        if hits == links:
            break
        nodes = _join(nodes, audit.where("a <> b").select("a", "b"))
    linked = nodes.groupBy("c").count().where("count > 1").select("c")
    members = nodes.join(linked, "c", "left_semi").select(F.col("c").alias("component"), "id", "v", "copies")
    links = store(_count_links(members, dims, threshold), "link-counts")
    numbered = nodes.select("id", "c").join(classes.select("id", "least"), "id")
    names = numbered.groupBy("c").agg(F.min("least").alias("component_id"))
    named = (
        classes.join(nodes.select("id", "c"), "id").join(names, "c").join(links, "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    return usable.join(named, "v").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"),
        F.lit(float(recall)).alias("audited_recall"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
