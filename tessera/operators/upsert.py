"""Upserts on immutable tables: latest wins, counted outcomes, idempotent inserts, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.perkey import latest


def in_batch(batch: DataFrame, keys: Sequence[str], ts: str, position: str) -> DataFrame:
    """One row a key of a batch: the newest, of equally new ones the first."""
    ranked = batch.withColumn("_first", -F.col(position))
    return latest(ranked, keys, [ts, "_first"]).drop("_first")


def merge_latest(target: DataFrame, batch: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The target after the batch (one row a key): a newer or equally new row replaces, an older one is skipped.

    The column `_outcome` tells inserted, updated, skipped and kept (not in the batch) rows apart.
    """
    names = target.columns
    t = target.select(*keys, F.struct(*names).alias("_t"))
    b = batch.select(*keys, F.struct(*[F.col(c).cast(dict(target.dtypes)[c]).alias(c) for c in names]).alias("_b"))
    outcome = (
        F.when(F.col("_b").isNull(), "kept").when(F.col("_t").isNull(), "inserted")
        .when(F.coalesce(F.col(f"_b.{ts}") >= F.col(f"_t.{ts}"), F.lit(True)), "updated").otherwise("skipped")
    )
    got = t.join(b, list(keys), "full_outer").withColumn("_outcome", outcome)
    row = F.when(F.col("_outcome").isin("inserted", "updated"), F.col("_b")).otherwise(F.col("_t"))
    return got.select(row.alias("_row"), "_outcome").select("_row.*", "_outcome")


def outcome_counts(batch: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped and deduplicated rows of a batch; they sum to its size."""
    size = batch.agg(F.count(F.lit(1)).alias("_size"))
    one = lambda k: F.count_if(F.col("_outcome") == k).alias(k)
    got = merged.agg(one("inserted"), one("updated"), one("skipped"))
    return got.crossJoin(size).select("inserted", "updated", "skipped", (F.col("_size") - F.col("inserted") - F.col("updated") - F.col("skipped")).alias("deduplicated"))


def insert_missing(candidates: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Candidates whose key (nulls are equal) isn't there yet, the first of each."""
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    new = candidates.alias("c").join(existing.select(*keys).distinct().alias("e"), on, "left_anti")
    return new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def corrected(target: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Target with the non-null columns of its corrections (one row a key)."""
    new = corrections.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    fixed = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    return target.join(new, key, "left").withColumns(fixed).select(*target.columns)
