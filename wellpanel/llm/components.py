"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellpanel.llm.storage import staged

#: Edges halve their depth with every pair of steps, so 2**MAX_ROUNDS exceeds any path.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every neighbour above a node to the node's smallest neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    above = both.filter("b > a").join(least, "a")
    return above.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Self loops and repeated edges are ignored; without edges the result is empty.  Every step groups with
    partial aggregation and joins one row per node, so a node with very many neighbours is summed map-side and
    its join partition can be split.
    """
    current = staged(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        current = staged(_small_star(_large_star(current)), "edges")
        now = tuple(current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
