"""Connected components of a stored link table, by hooking and contraction.

Each round every node of the contracted graph points to its smallest neighbour,
pointers are halved until they reach a root, and links between roots make the
next graph.  At least half of all nodes with links vanish in a round.  Tables
stay distributed; every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its
    smallest node."""
    graph = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    found = None
    while True:
        ends = graph.union(graph.select("b", "a"))
        parents = store(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = store(parents.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            release(parents)
            parents = jumped
            if not moved:
                break
        if found is None:
            found = parents.select("node", F.col("up").alias("component"))
            found._ledgerloom_path = parents._ledgerloom_path
        else:
            above = parents.select(F.col("node").alias("component"), "up")
            new = store(found.join(above, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "components")
            release(found)
            found = new
        left, right = parents.select(F.col("node").alias("a"), F.col("up").alias("x")), parents.select(F.col("node").alias("b"), F.col("up").alias("y"))
        rest = graph.join(left, "a").join(right, "b").where("x <> y")
        smaller = store(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        release(graph)
        graph = smaller
        if graph.isEmpty():
            release(graph)
            return found
