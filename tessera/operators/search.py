"""Literal search that doesn't scan: postings of trigrams, intersected rarest first, verified on the texts.

Each batch of texts that is added gets postings of its own, (trigram, id) sorted in buckets of trigrams, so Parquet
packs the rising ids of a trigram and a search reads the row groups of its trigrams only; texts added before are not
read again.  A search looks up how many texts hold each trigram of the literal, reads the postings of the rarest ones,
keeps the ids that all of them name, and compares only those texts.  A literal under three letters has no trigram and
is searched for in all texts.  Letters match in any case.  Adding one id twice makes its texts alternatives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import contains_any_case

BUCKETS = 64


def trigrams(text: Column) -> Column:
    """The different trigrams of a text in lower case; none for null and texts under three letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))  # in one pass; by position it would take the square


def bucket_of(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index under `path` of texts with 64-bit ids; the texts stay where they are."""

    def __init__(self, spark: SparkSession, path: str, rarest: int = 4):
        self.spark, self.path, self.rarest = spark, path.rstrip("/"), rarest

    def add(self, texts: DataFrame, id_column: str, text_column: str) -> None:
        """Index a batch.  Counts are written last: a batch that dies before has postings that no search asks for."""
        batch = uuid.uuid4().hex
        each = texts.select(F.col(id_column).cast("long").alias("id"), F.explode(trigrams(F.col(text_column))).alias("trigram"))
        rows = each.withColumn("bucket", bucket_of(F.col("trigram")))
        spread = F.pmod(F.xxhash64("id"), F.lit(8))  # a bucket's postings come from several tasks
        rows.repartition("bucket", spread).sortWithinPartitions("bucket", "trigram", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        stored = self.spark.read.parquet(f"{self.path}/postings/batch={batch}") if texts.take(1) else rows
        counts = stored.groupBy("trigram", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(batch))
        counts.sortWithinPartitions("trigram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/counts")

    def plan(self, literal: str) -> list[tuple[str, int, list[str]]]:
        """The trigrams that a search reads, rarest first, with how many postings each has and in which batches."""
        wanted = self.spark.range(1).select(F.explode(trigrams(F.lit(literal))).alias("trigram")).withColumn("bucket", bucket_of(F.col("trigram")))
        own = {r["trigram"]: r["bucket"] for r in wanted.collect()}  # as many as the literal has letters
        if not own:
            return []
        counts = self.spark.read.schema("trigram string, n long, batch string, bucket int").parquet(f"{self.path}/counts")
        known = counts.where(F.col("bucket").isin(sorted({*own.values()})) & F.col("trigram").isin(list(own)))
        found = {r["trigram"]: (r["n"], r["batches"]) for r in known.groupBy("trigram").agg(F.sum("n").alias("n"), F.collect_set("batch").alias("batches")).collect()}
        return sorted(((t, *found.get(t, (0, []))) for t in own), key=lambda x: (x[1], x[0]))[: self.rarest]

    def candidates(self, literal: str) -> DataFrame | None:
        """Ids of texts that hold the rarest trigrams of a literal; None if it has none."""
        parts = self.plan(literal)
        if not parts:
            return None
        batches = sorted(set.intersection(*({*b} for _, _, b in parts)))
        if not batches:
            return self.spark.createDataFrame([], "id long")
        rows = self.spark.read.option("basePath", f"{self.path}/postings").schema("trigram string, id long, bucket int").parquet(*[f"{self.path}/postings/batch={b}" for b in batches])
        names = [t for t, _, _ in parts]
        buckets = self.spark.range(1).select(F.explode(F.lit(names)).alias("t")).select(bucket_of(F.col("t")).alias("b")).distinct().collect()
        held = rows.where(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("trigram").isin(names)).groupBy("id").agg(F.countDistinct("trigram").alias("n"))
        return held.where(F.col("n") == len(names)).select("id")

    def search(self, texts: DataFrame, id_column: str, text_column: str, literal: str) -> DataFrame:
        """The rows of texts that hold a literal, in any case; texts are those that were added."""
        hits = contains_any_case(F.col(text_column), literal)
        ids = self.candidates(literal)
        if ids is None:
            return texts.where(hits)
        return texts.join(ids, F.col(id_column) == F.col("id"), "left_semi").where(hits)
