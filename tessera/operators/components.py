"""Connected components of an edge table, by alternating large-star and small-star steps over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node that can be reached from each node of edges (a, b).

    Each step replaces every node's edges by edges to its smallest neighbour, so their number doesn't grow, and a hub is
    summed up in parts.  Steps are stored in `folder`, which driver and executors share.
    """
    spark, number = edges.sparkSession, 0

    def stored(df: DataFrame) -> DataFrame:
        nonlocal number
        number += 1
        down = df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down.write.parquet(f"{folder}/{number}")
        return spark.read.parquet(f"{folder}/{number}")

    def least(neighbours: DataFrame) -> DataFrame:
        return neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    now, mark = stored(edges), None  # the greater node stands in a
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(least(both), "a").select(F.col("m").alias("a"), "b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        small = down.join(least(down), "a").select("b", "m").union(least(down).select("a", "m")).toDF("a", "b")
        now = stored(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = state
