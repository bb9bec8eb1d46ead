"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The most rounds; the number needed grows with the logarithm of the longest path.
ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest of them (or the node itself).

    Large: the larger neighbours; small: the node and its smaller neighbours. edges (a, b) have a > b.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    at = both.join(least, both.a == least.n)
    if large:
        out = at.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = at.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n"), F.col("m")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node with an edge. edges: a, b, of one orderable type.

    Direction, repeats and loops don't matter. Each round is written to the shared folder; only its number of edges and a
    checksum come to the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        now = cut(_star(_star(now, True), False), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
