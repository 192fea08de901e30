"""Reads and writes by key on immutable tables: look-ups, inserts with defaults, updates, deletes.

A write gives the table as it is afterwards; storing it (a partition overwrite, a new version) is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schemas import TABLES, conform, record_id


def lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows whose columns equal all given values (None: null): a filter that reaches the scan."""
    for c, v in keys.items():
        table = table.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return table


def lookup_all(table: DataFrame, asked: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of many look-ups at once: those whose key is among the asked ones."""
    return table.join(asked.select(*on).distinct(), list(on), "left_semi")


def inserted(table: DataFrame, rows: DataFrame, name: str, key: Sequence[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """The table with new rows in its columns; ids are hashes of `key`, so a repeated insert adds nothing."""
    filled = rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in (defaults or {}).items()})
    filled = filled.withColumn("id", record_id(*[F.col(c) for c in key])).dropDuplicates(["id"])
    new = conform(filled, name) if name in TABLES else filled.select(*table.columns)
    return table.unionByName(new.join(table.select("id"), "id", "left_anti").select(*table.columns))


def updated(table: DataFrame, condition: Column, **changes) -> DataFrame:
    """The table with columns set in the rows for which the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items()})


def deleted(table: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows for which the condition holds; rows for which it is null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def deleted_by_key(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on), list(on), "left_anti")


def touched(parents: DataFrame, children: DataFrame, key: str, column: str = "updated_at", ts: str = "created_at") -> DataFrame:
    """Parents whose `column` is at least the time of their newest child."""
    last = children.groupBy(F.col(key).alias("id")).agg(F.max(ts).alias("_last"))
    return parents.join(last, "id", "left").withColumn(column, F.greatest(column, "_last")).select(*parents.columns)


def durations(calls: DataFrame, started: str = "started_at", ended: str = "completed_at") -> DataFrame:
    """Adds duration_ms of finished calls."""
    return calls.withColumn("duration_ms", F.unix_millis(ended) - F.unix_millis(started))


def checked_labels(labels: DataFrame, companies: DataFrame) -> DataFrame:
    """Labels of threads with a column refusal: neither company nor label given, or an unknown company; labels are trimmed."""
    clean = labels.withColumn("label", F.nullif(F.trim("label"), F.lit("")))
    known = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("_known"))
    got = clean.join(known, "company_id", "left")
    why = F.when(F.col("company_id").isNull() & F.col("label").isNull(), "company or label needed").when(F.col("company_id").isNotNull() & F.col("_known").isNull(), "unknown company")
    return got.select(*labels.columns, why.alias("refusal"))


def checked_bindings(rows: DataFrame, companies: DataFrame, bindings: DataFrame) -> DataFrame:
    """New phone bindings with their normal phone and a column refusal: no phone, unknown company, or bound already (also by an earlier row)."""
    from tessera.functions.contact import normalize_phone

    got = rows.withColumn("phone_e164", normalize_phone(F.col("phone")))
    known = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("_known"))
    bound = bindings.select("phone_e164", F.lit(True).alias("_bound")).distinct()
    first = got.where("phone_e164 is not null").groupBy("phone_e164").agg(F.min("id").alias("_first"))
    got = got.join(known, "company_id", "left").join(bound, "phone_e164", "left").join(first, "phone_e164", "left")
    why = (
        F.when(F.col("phone_e164").isNull(), "no phone of ten digits").when(F.col("_known").isNull(), "unknown company")
        .when(F.col("_bound").isNotNull() | (F.col("id") != F.col("_first")), "bound already")
    )
    return got.select("id", "phone_e164", "company_id", why.alias("refusal"))


def success_rate(done: Column, failed: Column) -> Column:
    """Per cent of what was done; 100 if nothing was tried."""
    return F.when(done + failed == 0, 100.0).otherwise(100.0 * done / (done + failed))


def reactivated(table: DataFrame, rows: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """The table after rows were created: an existing key only becomes active again, a new one is added (the first of each)."""
    asked = rows.select(F.col(key).alias("_key")).distinct()
    kept = table.join(asked, F.col(key) == F.col("_key"), "left").withColumn(flag, F.when(F.col("_key").isNotNull(), True).otherwise(F.col(flag))).select(*table.columns)
    kinds = dict(table.dtypes)
    new = rows.join(table.select(key), key, "left_anti").dropDuplicates([key]).withColumn(flag, F.lit(True))
    return kept.unionByName(new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns]))


def exists_by_json(asked: DataFrame, key: str, df: DataFrame, column: str, path: str) -> DataFrame:
    """asked with `found`: whether some row of df holds its key under a path of a JSON column; a null key is never found."""
    known = df.select(F.get_json_object(column, path).alias("_key")).where("_key is not null").distinct()
    got = asked.withColumn("_key", F.col(key).cast("string")).join(known.withColumn("_found", F.lit(True)), "_key", "left")
    return got.select(*asked.columns, F.coalesce("_found", F.lit(False)).alias("found"))
