"""First, last and top-k rows per key, pages and counts.

Picks of one row use aggregation (max_by of a struct), which combines before it shuffles, so a hot key costs one
row a task.  Only picks of several rows sort a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    by = F.struct(*[F.col(c) for c in order])
    got = df.groupBy(*keys).agg(agg(row, by).alias("_row"))
    return got.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest `order` columns (end them with a unique one); nulls come lowest."""
    return _pick(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """k rows of each key; Spark drops rows beyond k before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows for which all given conditions hold; None stands for a filter that isn't asked for."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def within(ts: Column, since=None, until=None) -> Column | None:
    """Closed range with optional ends."""
    parts = [ts >= F.lit(since)] * (since is not None) + [ts <= F.lit(until)] * (until is not None)
    return parts[0] & parts[-1] if parts else None


def ranked_versions(df: DataFrame, key: str, order: Sequence[str], id_column: str) -> DataFrame:
    """Each key's last row is canonical, the others are superseded by it (columns dedup_status, superseded_by, supersedes_count)."""
    best = df.groupBy(key).agg(F.max_by(F.col(id_column), F.struct(*order)).alias("_canonical"), F.count(F.lit(1)).alias("_n"))
    canonical = F.col(id_column) == F.col("_canonical")
    return df.join(best, key).select(
        *df.columns, F.when(canonical, "canonical").otherwise("superseded").alias("dedup_status"),
        F.when(canonical, "").otherwise(F.col("_canonical").cast("string")).alias("superseded_by"),
        F.when(canonical, F.col("_n") - 1).otherwise(0).cast("long").alias("supersedes_count"),
    )


def beyond(order: Sequence[tuple[str, bool]], cursor: Sequence) -> Column:
    """Whether a row comes after the cursor (the order's columns of some row); order: (column, descending), none of them null."""
    out = F.lit(False)
    for (name, down), value in reversed(list(zip(order, cursor, strict=True))):
        c, v = F.col(name), F.lit(value)
        out = ((c < v) if down else (c > v)) | ((c == v) & out)
    return out


def seek(df: DataFrame, order: Sequence[tuple[str, bool]], cursor: Sequence | None = None, limit: int = 100) -> DataFrame:
    """The page after a cursor, or the first one: what a deep page skips is never read, as the condition reaches the files.

    End the order with a unique column; the cursor of the next page is the last row's.  Over a table that `clustered`
    has written, files and row groups before the cursor are left out by their smallest and largest values.
    """
    rows = df if cursor is None else df.where(beyond(order, cursor))
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit)


def clustered(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Write df in ranges of the order's columns, sorted within each, for `seek`."""
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(path)


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Numbers the rows of a page (a bounded number of rows) in order, from 1."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def united(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    both = a.unionByName(b)
    return both.distinct() if distinct else both


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that are in both."""
    return a.intersect(b.select(*a.columns))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that aren't in b."""
    return a.subtract(b.select(*a.columns))
