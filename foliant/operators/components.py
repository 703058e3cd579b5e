"""Connected components by alternating large-star and small-star steps.

Method: Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Each step needs only the smallest neighbour of a node, which is a partially
aggregated minimum, so a node with very many edges is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import settle

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them.

    ``large``: neighbours above the node. Otherwise the node and its neighbours
    below it.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a is the node, b its neighbour.
    seen = both if large else both.filter(F.col("b") < F.col("a"))
    low = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = seen.join(low, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        # One more row per node links the node itself to its minimum.
        out = linked.filter(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").unionByName(
            low.select(F.col("m").alias("a"), F.col("a").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge ``(a, b)``.

    The root is the smallest node of the component. Each round is written to
    the checkpoint folder; rounds grow with the logarithm of the longest chain.
    """
    current = settle(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        current = settle(_star(_star(current, large=True), large=False))
        seen = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s"),
        ).first()
        if tuple(seen) == mark:
            roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(
                current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
