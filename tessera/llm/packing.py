"""Best-fit packing of token sequences whose bin counts are certified by dual feasible functions.

Every document is its token ids and an end id; only documents longer than `capacity` are cut.  The pieces (a few
numbers each, never their tokens) are dealt at random to partitions of about `rows` pieces and packed there by
best-fit decreasing.  Dual feasible functions give a lower bound of each partition's bin count; where the count
meets the bound nothing better exists.  Partitions with a gap exchange documents: `fan` of them at a time release
their emptiest bins and pack what was in them again, together; that repeats `rounds` times or until no gap is left.
A bound over the lengths of all pieces then certifies the whole; if there are more sequences, every partition, with or
without a gap of its own, puts its emptiest one into a last exchange.  `gap` is how many sequences are left above that
bound.  The result is the same for every order of rows, unless so many rows are equal that they fill partitions of
their own (then equal rows are dealt out by their place).  Null and empty texts give one piece with the end id; very
long ones are cut only into pieces of `capacity`; repeated rows are packed as often as they come; an empty table gives
no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Bpe, crc, encoded
from tessera.llm.shared import durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, part long, gap long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest bound that two families of dual feasible functions give for the number of bins.

    The first drops items below a and counts items above capacity - a as full, for every a up to half the capacity;
    the second rounds (k + 1) * length / capacity down where it isn't whole, for k up to 100.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each length."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    items, mass = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    below = np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    total = mass[capacity - a] - below + capacity * (items[-1] - items[capacity - a])
    best = int((-(-total // capacity)).max())
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item (items must come in decreasing order) and the number of bins."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    out, bins = np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return out, bins


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)


def with_offsets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places in each sequence: longer pieces first."""
    pdf = in_order(pdf).sort_values("sequence_id", kind="stable", ignore_index=True)
    pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
    return pdf


def pack_partition(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = in_order(pdf)
    bins, n = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
    pdf["sequence_id"] = pdf["part"] * 2**32 + bins
    pdf["gap"] = n - lower_bound(pdf["length"].to_numpy(), capacity)
    return with_offsets(pdf)


def repack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Partitions with gaps release their emptiest bins and pack their pieces together; kept if that saves bins."""
    fill = pdf.groupby("sequence_id")["length"].sum().sort_values(kind="stable")
    bound = lower_bound(pdf["length"].to_numpy(), capacity)
    gap = len(fill) - bound
    if gap > 0:
        free = (capacity - fill).cumsum()
        share = 4
        while True:  # more and more bins, as long as that pays
            n = min(len(fill), int((free < share * gap * capacity).sum()) + 1)
            released = pdf["sequence_id"].isin(fill.index[:n])
            part = in_order(pdf[released])
            bins, used = best_fit_decreasing(part["length"].to_numpy(), capacity)
            if used < n:
                ids = np.sort(fill.index[:n].to_numpy())
                part["sequence_id"] = ids[bins]
                pdf = pd.concat([pdf[~released], part], ignore_index=True)
                gap -= n - used
                break
            if n == len(fill):
                break
            share *= 4
    pdf["gap"] = gap
    return with_offsets(pdf)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every document's ids and end id, with the piece's checksum."""
    end = np.uint32(end_id).tobytes()

    def rows(_: Bpe, ids: list, codes: Iterator[bytes]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for doc, code in zip(ids, codes, strict=True):
            code += end
            for k, at in enumerate(range(0, len(code), 4 * capacity)):
                part = code[at : at + 4 * capacity]
                for column, value in zip(out, (doc, k, at // 4, len(part) // 4, crc(part)), strict=True):
                    column.append(value)
        return out

    return encoded(docs, path, PIECES, rows)


def pack(found: DataFrame, capacity: int = 2048, rows: int = 20_000, fan: int = 4, rounds: int = 3) -> DataFrame:
    """Sequences for pieces (columns PIECES): adds sequence_id and offset, and the gap of each piece's partition.

    `found` is read several times, so it should be a stored table.  No group holds more than about
    rows * fan ** rounds pieces.
    """
    n = found.count()
    parts = max(1, -(-n // rows))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    most = found.groupBy(deal.alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 4 * rows:  # equal rows would fill a partition
        deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts))
    placed = durable(
        found.withColumn("part", deal).withColumn("gap", F.lit(0).cast("long")).groupBy("part")
        .applyInPandas(lambda pdf: pack_partition(pdf, capacity)[names], PLACED),
        "packed",
    )
    for k in range(1, rounds + 1):
        if n <= rows or placed.where("gap > 0").select("part").distinct().count() < 2:
            break
        group = F.floor(F.col("part") / fan**k)
        open_ = placed.where("gap > 0").withColumn("team", group)
        again = open_.groupBy("team").applyInPandas(lambda pdf: repack(pdf.drop(columns="team"), capacity)[names], PLACED)
        placed = durable(placed.where("gap = 0").unionByName(again), "packed")
        if -(-n // rows) <= fan**k:
            break
    counts = np.zeros(capacity + 1, np.int64)
    for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    bound = bound_of_counts(counts, capacity)
    used = placed.select("sequence_id").distinct().count()
    if used > bound and parts > 1:
        placed = durable(last_exchange(placed, capacity), "packed")
        used = placed.select("sequence_id").distinct().count()
    return placed.withColumn("gap", F.lit(used - bound).cast("long"))


def last_exchange(placed: DataFrame, capacity: int, fan: int = 2000) -> DataFrame:
    """The emptiest sequence of every partition is packed again with those of up to `fan` others."""
    fill = placed.groupBy("part", "sequence_id").agg(F.sum("length").alias("fill"))
    free = fill.groupBy("part").agg(F.min(F.struct("fill", "sequence_id")).alias("e")).select("e.sequence_id")
    free = durable(free, "emptiest")  # a row a partition
    again = placed.join(free, "sequence_id", "left_semi").withColumn("team", F.floor(F.col("part") / fan))
    again = again.groupBy("team").applyInPandas(lambda pdf: repack(pdf.drop(columns="team"), capacity)[names], PLACED)
    return placed.join(free, "sequence_id", "left_anti").unionByName(again)


names = [x.split()[0] for x in PLACED.split(", ")]


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and gap of every piece of every document."""
    return pack(durable(pieces(docs, path, capacity, end_id), "pieces"), capacity).drop("part")
