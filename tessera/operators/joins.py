"""Joins that have no operator of their own: first match by any of several keys, as-of, intervals, containment, patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_match_any_key(
    left: DataFrame, right: DataFrame, left_id: str, keys: Sequence[Sequence[tuple[str, str]]], right_order: Sequence[str],
    residual: Column | None = None, newest: bool = False,
) -> DataFrame:
    """left_id and, as `match`, the first right row that equals the left one in all columns of at least one key.

    keys holds groups of (left column, right column).  Each group is an equi-join of its own, and the best matches of
    the groups meet by left_id: a join with OR would compare all pairs.  `residual` is a condition over columns l_* and
    r_*.  Rows without a match are left out.
    """
    order = F.struct(*[F.col(f"r_{c}") for c in right_order])
    pick = F.max_by if newest else F.min_by
    lefts = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    rights = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    row = F.struct(*[F.col(f"r_{c}").alias(c) for c in right.columns])

    def group(columns: Sequence[tuple[str, str]]) -> DataFrame:
        on = [F.col(f"l_{a}") == F.col(f"r_{b}") for a, b in columns]
        got = lefts.join(rights, reduce(lambda a, b: a & b, on))
        got = got if residual is None else got.where(residual)
        return got.groupBy(f"l_{left_id}").agg(pick(row, order).alias("match"), (F.max if newest else F.min)(order).alias("_order"))

    found = reduce(DataFrame.unionByName, [group(k) for k in keys])
    return found.groupBy(F.col(f"l_{left_id}").alias(left_id)).agg(pick("match", F.col("_order")).alias("match"))


#: Width of the time buckets that cut the sequence of a hot key into parts, in seconds.
BUCKET = 24 * 3600


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _carried(marks: DataFrame, keys: Sequence[str], value: Column, back: bool = False) -> DataFrame:
    """(keys, _b, _c): for each bucket of a key the nearest value of the buckets before it (behind it, if `back`).

    marks has a row a bucket: few numbers a key, however many rows a bucket has.
    """
    order = F.desc("_b") if back else F.asc("_b")
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return marks.select(*keys, "_b", F.last(value, ignorenulls=True).over(before).alias("_c"))


def next_within(events: DataFrame, keys: Sequence[str], ts: str, wanted: Column, seconds: float | None, out: str, bucket: int = BUCKET) -> DataFrame:
    """Adds the time of each row's first later row of its keys for which `wanted` holds, before `seconds` have passed.

    Both ends are exclusive; rows with a null key have no next row.  A key's rows are cut into buckets of time: a
    window finds what follows within the bucket, and a row a bucket tells what follows behind it.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    at = _micros(F.col(ts))
    rows = events.withColumns({n: F.col(k) for n, k in zip(names, keys, strict=True)} | {"_b": F.floor(at / (bucket * 1_000_000)), "_w": F.when(held & wanted, F.col(ts))})
    firsts = rows.where(held).groupBy(*names, "_b").agg(F.min("_w").alias("_v"))
    behind = _carried(firsts, names, F.col("_v"), back=True).where("_c is not null")
    # null keys would meet in one task: they are spread by the bucket alone and get no answer
    w = W.partitionBy(*names, "_b").orderBy(at).rangeBetween(1, W.unboundedFollowing)
    got = rows.withColumn("_own", F.min("_w").over(w)).join(behind, [*names, "_b"], "left")
    found = F.coalesce("_own", "_c")
    if seconds is not None:
        found = F.when(_micros(found) - at < int(seconds * 1_000_000), found)
    return got.select(*events.columns, found.alias(out))


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_t: Column, right_t: Column, columns: Sequence[str], order: Sequence[str] = (),
    after: bool = False, equal: bool = False, width: int = BUCKET * 1_000_000, prefix: str = "matched_",
) -> DataFrame:
    """Adds `columns` of the right row of the same keys whose number is nearest below that of each left row.

    With `after` the nearest above it is taken, with `equal` an equal one counts too.  left_t and right_t are whole
    numbers; of right rows of one number the one with the greatest (with `after` the smallest) `order` counts.  Null keys and null numbers match nothing.  Both sides are laid in one sequence per keys and bucket
    of `width`, and the last right row is carried forward, over buckets by a row a bucket: no pair of rows is built and
    a hot key is cut.
    """
    sign = -1 if after else 1
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    tie = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or columns)])
    held = lambda side: reduce(lambda a, b: a & b, [F.col(k[side]).isNotNull() for k in keys])
    number = lambda t: F.floor(t / width)
    b = right.select(*[F.col(r).alias(n) for n, (_, r) in zip(names, keys, strict=True)], (sign * right_t).alias("_t"), tie.alias("_o"), row.alias("_r")).where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names]) & F.col("_t").isNotNull())
    b = b.groupBy(*names, "_t").agg((F.min_by if after else F.max_by)("_r", "_o").alias("_r")).withColumn("_b", number(F.col("_t")))
    a = left.select(*[F.col(k).alias(n) for n, (k, _) in zip(names, keys, strict=True)], (sign * left_t).alias("_t"), F.struct(*left.columns).alias("_l"), (held(0) & left_t.isNotNull()).alias("_h"))
    # rows that can't match are spread by a hash of themselves
    a = a.withColumn("_b", F.when(F.col("_h"), number(F.col("_t"))).otherwise(F.pmod(F.xxhash64("_l"), F.lit(1 << 20))))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    marks = b.groupBy(*names, "_b").agg(F.max_by("_r", "_t").alias("_v"))
    asked = a.where("_h").select(*names, "_b").distinct().withColumn("_v", none(b, "_r"))
    marks = marks.unionByName(asked).groupBy(*names, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.lit(1))).alias("_v"))
    carried = _carried(marks, names, F.col("_v")).where("_c is not null")
    sequence = [
        a.select(*names, "_b", "_t", F.lit(1 if equal else -1).alias("_side"), "_l", none(b, "_r").alias("_r"), "_h"),
        b.select(*names, "_b", "_t", F.lit(0).alias("_side"), none(a, "_l").alias("_l"), "_r", F.lit(True).alias("_h")),
        carried.select(*names, "_b", F.lit(None).cast("bigint").alias("_t"), F.lit(0).alias("_side"), none(a, "_l").alias("_l"), F.col("_c").alias("_r"), F.lit(True).alias("_h")),
    ]
    # what was carried has no number and so comes first
    w = W.partitionBy(*names, "_b").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = reduce(DataFrame.unionByName, sequence).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    return got.select("_l.*", *[F.when(F.col("_h"), F.col(f"_m.`{c}`")).alias(f"{prefix}{c}") for c in columns])


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: Sequence[str], right_order: Sequence[str] = ()) -> DataFrame:
    """Adds `columns` of the latest right row of the same key before each left row's time (strictly); null without one.

    Of right rows of one time the one with the greatest `right_order` counts.  Null keys match nothing.
    """
    return nearest(left, right, [(key, key)], _micros(F.col(left_ts)), _micros(F.col(right_ts)), columns, right_order)


def oldest_since(
    left: DataFrame, right: DataFrame, left_id: str, keys: Sequence[Sequence[tuple[str, str]]], low: Column, high: Column, right_t: Column, columns: Sequence[str], order: Sequence[str],
    width: int = 14 * BUCKET * 1_000_000,
) -> DataFrame:
    """left_id and, as `match`, the right row of smallest number (then `order`) in [low, high] that equals the left one in all columns of some key.

    low, high and right_t are whole numbers.  All keys share one walk: a row stands once for each key that it has (rows
    with a null in a key have no such key), left ones also once for each bucket of `width` that [low, high] touches, and
    in a bucket the first right row above `low` counts.  No pairs of rows are built, and a hot key is cut into buckets;
    `width` is best near high - low.  The best of a row's answers is taken.
    """
    slots = [(g, i, pair) for g, key in enumerate(keys) for i, pair in enumerate(key)]
    names = [f"_k{g}_{i}" for g, i, _ in slots]

    def keyed(df: DataFrame, side: int) -> Column:
        """A struct for each key of a row: its number, its columns, and nulls for those of the other keys."""
        each = []
        for g, key in enumerate(keys):
            own = [F.when(F.lit(h == g), F.col(pair[side])).alias(n) for (h, _, pair), n in zip(slots, names, strict=True)]
            each.append(F.when(reduce(lambda a, b: a & b, [F.col(pair[side]).isNotNull() for pair in key]), F.struct(F.lit(g).alias("_g"), *own)))
        return F.explode(F.array_compact(F.array(*each))).alias("_key")

    number = lambda t: F.floor(t / width)
    tie = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or columns)])
    b = right.select(keyed(right, 1), right_t.alias("_t"), tie.alias("_o"), F.struct(*[F.col(c).alias(c) for c in columns]).alias("_r")).where("_t is not null")
    a = left.select(keyed(left, 0), F.col(left_id).alias("_id"), low.alias("_t"), high.alias("_high")).where("_t <= _high")
    a = a.select("*", F.explode(F.sequence(number(F.col("_t")), number(F.col("_high")))).alias("_b"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    found = F.struct("_r", "_t", "_o")
    sequence = a.select("_key.*", "_b", "_t", F.lit(0).alias("_right"), none(b, "_o"), none(b, "_r"), "_id", "_high").unionByName(
        b.select("_key.*", number(F.col("_t")).alias("_b"), "_t", F.lit(1).alias("_right"), "_o", "_r", none(a, "_id"), none(a, "_high"))
    )
    # from the last number to the first: the last right row passed is the nearest one from here on
    w = W.partitionBy("_g", *names, "_b").orderBy(F.desc("_t"), F.desc("_right"), F.desc("_o")).rowsBetween(W.unboundedPreceding, W.currentRow)
    got = sequence.withColumn("_m", F.last(F.when(F.col("_right") == 1, found), ignorenulls=True).over(w)).where("_right = 0 and _m._t <= _high")
    return got.groupBy(F.col("_id").alias(left_id)).agg(F.min_by("_m._r", F.struct("_m._t", "_m._o")).alias("match"))


def count_between(probes: DataFrame, events: DataFrame, key: str, after: str, until: str, ts: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """Adds how many events of its key lie in (after, until] of each probe: a running count, read at both ends.

    Probes' ends and events are laid in one sequence per key and bucket of time, on which the counts of earlier buckets
    (a row a bucket) are carried; no pair of rows is built.  Null keys have no events.
    """
    width = bucket * 1_000_000
    cols = F.struct(*probes.columns)
    ends = probes.select(F.col(key).alias("_k"), F.monotonically_increasing_id().alias("_id"), cols.alias("_p"))
    both = F.array(F.struct(_micros(F.col(f"_p.`{after}`")).alias("t"), F.lit(-1).alias("sign")), F.struct(_micros(F.col(f"_p.`{until}`")).alias("t"), F.lit(1).alias("sign")))
    ends = ends.select("_k", "_id", "_p", F.explode(both).alias("_e"))
    marks = ends.select("_k", F.col("_e.t").alias("_t"), F.lit(1).alias("_side"), "_id", "_p", F.col("_e.sign").alias("_sign"), F.lit(0).cast("long").alias("_n"))
    marks = marks.withColumn("_b", F.when(F.col("_k").isNotNull(), F.floor(F.col("_t") / width)).otherwise(F.pmod("_id", F.lit(1 << 20))))
    none = lambda c: F.lit(None).cast(marks.schema[c].dataType).alias(c)
    own = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), _micros(F.col(ts)).alias("_t"), F.lit(0).alias("_side"), none("_id"), none("_p"), F.lit(0).alias("_sign"), F.lit(1).cast("long").alias("_n"))
    own = own.withColumn("_b", F.floor(F.col("_t") / width))
    counted = own.groupBy("_k", "_b").agg(F.sum("_n").alias("_v")).unionByName(marks.where("_k is not null").select("_k", "_b").distinct().withColumn("_v", F.lit(0).cast("long")))
    earlier = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = counted.groupBy("_k", "_b").agg(F.sum("_v").alias("_v")).select("_k", "_b", F.sum("_v").over(earlier).alias("_n")).where("_n > 0")
    carried = carried.select("_k", "_b", F.lit(None).cast("bigint").alias("_t"), F.lit(0).alias("_side"), none("_id"), none("_p"), F.lit(0).alias("_sign"), "_n")
    w = W.partitionBy("_k", "_b").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = reduce(DataFrame.unionByName, [marks, own, carried]).withColumn("_sum", F.sum("_n").over(w)).where("_side = 1")
    value = F.when(F.col("_k").isNotNull(), F.col("_sign") * F.col("_sum")).otherwise(0)
    got = running.groupBy("_id").agg(F.first("_p").alias("_p"), F.greatest(F.sum(value), F.lit(0)).cast("long").alias(out))
    return got.select("_p.*", out)


def recent(replies: DataFrame, sent: DataFrame, key: str, at: str, sent_at: str, minutes: int, columns: Sequence[str], of: str | None = None) -> DataFrame:
    """Adds `candidates`, how many rows of `sent` of its key lie within `minutes` before (or at) each reply, and recent_* of the last.

    With `of` only the last row of each value of that column counts: a row then counts until the next one of its key and
    value, or until `minutes` are over, so candidates are the rows that have begun less those that have ended.  Counts
    are running counts, and the last row is an as-of join: no pairs of a key are built.  If there is one candidate, it
    is the last row.
    """
    width = minutes * 60 * 1_000_000
    ended = F.timestamp_micros(_micros(F.col(sent_at)) + width + 1)
    rows = sent.where(F.col(key).isNotNull()).select(F.col(key).alias("_rk"), F.col(sent_at).alias("_from"), ended.alias("_until"), *([F.col(of).alias("_of")] if of else []))
    if of:
        rows = next_within(rows.distinct(), ["_rk", "_of"], "_from", F.lit(True), None, "_next").withColumn("_until", F.least("_until", "_next"))
    probes = replies.withColumns({"_rk": F.col(key), "_begin": F.lit("0001-01-02").cast("timestamp"), "_end": F.col(at)})
    probes = count_between(probes, rows, "_rk", "_begin", "_end", "_from", "_begun")
    probes = count_between(probes, rows, "_rk", "_begin", "_end", "_until", "_over")
    last = nearest(probes, sent, [(key, key)], _micros(F.col(at)), _micros(F.col(sent_at)), [*columns, sent_at], columns, equal=True, prefix="recent_")
    inside = _micros(F.col(f"recent_{sent_at}")) >= _micros(F.col(at)) - width
    return last.select(*replies.columns, (F.col("_begun") - F.col("_over")).alias("candidates"), *[F.when(inside, F.col(f"recent_{c}")).alias(f"recent_{c}") for c in columns])


def first_company_by_pattern(messages: DataFrame, companies: DataFrame, message_id: str, text: str, at_once: int = 1_000) -> DataFrame:
    """(message_id, company_id, company_name): the company of lowest priority whose patterns match each message.

    A company matches if all patterns of one of its groups are found.  Companies become literals that every row is
    tested against in order, so the first hit ends the search and nothing is shuffled; they come to the driver
    `at_once` at a time, and each lot is tested only on rows that no earlier one has hit.
    """
    ranked = companies.where("is_active").select("priority", "id", "name", "identification_patterns")
    ranked = ranked.where(F.size("identification_patterns") > 0).orderBy("priority", "name", "id")
    out = messages.select(message_id, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.lit(None).cast("struct<company_id:string,company_name:string>").alias("_hit"))
    skip = 0
    while rows := ranked.offset(skip).limit(at_once).collect():
        hit = F.when(F.lit(False), F.lit(None).cast("struct<company_id:string,company_name:string>"))  # one flat CASE, in order of priority
        for r in rows:
            groups = [list(g["patterns"] or []) for g in r["identification_patterns"]]
            tests = [reduce(lambda a, b: a & b, [F.col("_t").rlike(f"(?imUd){p}") for p in g]) for g in groups if g]
            if tests:
                found = F.struct(F.lit(r["id"]).alias("company_id"), F.lit(r["name"]).alias("company_name"))
                hit = hit.when(reduce(lambda a, b: a | b, tests), found)
        out = out.withColumn("_hit", F.when(F.col("_hit").isNotNull(), F.col("_hit")).otherwise(hit))
        skip += at_once
    return out.where("_hit is not null").select(message_id, "_hit.*")
