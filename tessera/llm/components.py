"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import durable, forget


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame) -> DataFrame:
    """Smallest of each a's neighbours and itself; partial minima meet, so a hub costs no more than another node."""
    return neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Every step reads and writes a stored table of edges.  Each pair of steps at least halves the longest way to the
    smallest node; `most` only guards against endless work and raises when it is reached.
    """
    now = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = _directed(now)
        large = both.where("b > a").join(_star(both), "a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _star(down)
        small = down.join(least, "a").select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        before, now = now, durable(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        forget(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == mark:
            nodes = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
            return nodes.union(now.select("a", "a").distinct().toDF("node", "component"))
        mark = state
    raise RuntimeError("components did not settle")
