"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (a, b). Large: every larger neighbour of a node is hung on the least of its neighbourhood.
    Small: the node and its smaller neighbours are hung there."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return hung.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge table (a, b), component being the least node reachable.

    Rounds of a large and a small star until the edges no longer change; each round's edges are checkpointed, so
    lost executors cost one round at most. Only two numbers a round reach the driver. Self-edges and repeated edges
    have no effect; an empty table gives an empty one."""
    now = cut(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == before:
            break
        before = (seen["n"], seen["h"])
        now = cut(_star(_star(now, True), False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
