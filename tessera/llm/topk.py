"""Exact top-k inner products over a bit-sliced index.

Vectors of whole numbers are kept in blocks; of each block every attribute is cut into bit slices, one bitmap a
bit (the lowest `dropped` bits are left out).  Slices and vectors are stored once: that is the index.  For a query the
slices are added, weighted by the signed binary digits of its components, with carry-save adders on the bitmaps; that
yields the slices of every row's rough score at once.  From the most significant slice downward the block's best rows
are selected.  Rows whose rough score lies within the rounding error of that boundary are scored exactly, so the
result is exact.

Every query meets every block.  The index stays where it is stored: queries go past it in broadcasts of about
`queries` rows and NUMBERS components, each of which is one scan of the index without a shuffle.  A task keeps k rows a query over all its
blocks; the k best of those are the answer.

Vectors that are null or hold null or non-finite components and rows without an id take no part.  Only vectors of equal
length are compared; repeated ids count as rows of their own, and as one query (any of its rows).  Ties go to the
smaller id.  An empty table gives no rows; other columns don't matter, whatever their names.  Vectors with a component of
2**26 or more after scaling go in blocks of their own, which are scored in whole numbers of any size; a component of
2**62 or more, or a score beyond a long, raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import durable

WIDE = 1 << 26  # from here on components go to wide blocks: products of narrow ones fit 64 bits in 2**10 dimensions
LARGEST = 1 << 62
NUMBERS = 1 << 21  # components of all queries that are broadcast together: 16 MB
BLOCK = "dim int, ids binary, data binary, low binary, shift int, bits int, slices binary"


def whole(values: pa.Array | None, scale: float) -> np.ndarray | None:
    """Components as whole numbers, None for vectors that take no part."""
    if values is None or values.null_count or not len(values):
        return None
    x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if not np.isfinite(values.to_numpy(zero_copy_only=False)).all():
        return None
    if np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(x).max():.3g} after scaling: scores would not fit a long")
    return x.astype(np.int64)


def _index(df: DataFrame, rows: int, scale: float, dropped: int) -> DataFrame:
    """Blocks of up to `rows` vectors of one length with their bit slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}

        def block(key: tuple[int, bool]) -> pa.RecordBatch:
            own = held.pop(key)
            made = BitSlices.of(np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64), dropped)
            return pa.RecordBatch.from_pylist([{"dim": key[0]} | made.stored()], schema)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = whole(v.values, scale)
                if i is None or x is None:
                    continue
                key = len(x), bool(np.abs(x).max() >= WIDE)
                held.setdefault(key, []).append((i, x))
                if len(held[key]) == rows:
                    yield block(key)
        for key in list(held):
            yield block(key)

    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("low", pa.binary()), ("shift", pa.int32()), ("bits", pa.int32()), ("slices", pa.binary())])
    return df.mapInArrow(run, BLOCK)


def digits(weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(attribute, power, sign) of the non-adjacent form of every weight: signed binary digits, few of them non-zero."""
    out = []
    for j, w in enumerate(weights.tolist()):
        power = 0
        while w:
            if w & 1:
                sign = 2 - (w & 3)
                out.append((j, power, sign))
                w -= sign
            w >>= 1
            power += 1
    return out


@dataclass
class BitSlices:
    """The slices of one block of vectors."""

    ids: np.ndarray
    data: np.ndarray
    low: np.ndarray  # least component of each attribute
    shift: int  # lowest bits that are left out
    bits: int
    slices: np.ndarray  # attribute by attribute, and all of them inverted

    def __post_init__(self) -> None:
        width = -(-len(self.ids) // 64) * 64
        self.valid = np.packbits(np.arange(width) < len(self.ids), bitorder="little").view(np.uint64)
        self.most = max(1, int(np.abs(self.data).max()))

    @classmethod
    def of(cls, ids: np.ndarray, data: np.ndarray, dropped: int) -> BitSlices:
        low = data.min(0)
        above = data - low  # below 2**63
        shift = min(dropped, max(0, int(above.max()).bit_length() - 1))
        rough = above >> shift
        bits = max(1, int(rough.max()).bit_length())
        width = -(-len(ids) // 64) * 64
        packed = np.empty((data.shape[1], bits, width // 64), np.uint64)
        for j in range(data.shape[1]):
            rows = np.zeros((bits, width), np.uint8)
            rows[:, : len(ids)] = (rough[:, j][None] >> np.arange(bits)[:, None]) & 1
            packed[j] = np.packbits(rows, axis=1, bitorder="little").view(np.uint64)
        return cls(ids, data, low, shift, bits, packed.reshape(-1, width // 64))

    def stored(self) -> dict:
        narrow = int(np.abs(self.data).max()) < 1 << 31
        arrays = {"ids": self.ids, "data": self.data.astype(np.int32 if narrow else np.int64), "low": self.low, "slices": self.slices}
        return {"shift": self.shift, "bits": self.bits} | {k: v.astype(v.dtype.newbyteorder("<")).tobytes() for k, v in arrays.items()}

    @classmethod
    def load(cls, row: dict) -> BitSlices:
        ids = np.frombuffer(row["ids"], "<i8")
        narrow = len(row["data"]) == 4 * len(ids) * row["dim"]
        data = np.frombuffer(row["data"], "<i4" if narrow else "<i8").reshape(-1, row["dim"]).astype(np.int64)
        packed = np.frombuffer(row["slices"], "<u8").reshape(row["dim"] * row["bits"], -1)
        return cls(ids, data, np.frombuffer(row["low"], "<i8"), row["shift"], row["bits"], np.concatenate([packed, ~packed]))

    def product(self, left: np.ndarray, query: np.ndarray) -> list[int]:
        """Inner products of rows with the query, in numbers of any size if 64 bits might not do."""
        if self.most * int(np.abs(query).max()) * len(query) < 1 << 62:
            return (left @ query).tolist()
        return (left.astype(object) @ query.astype(object)).tolist()

    def add(self, weights: list[tuple[int, int, int]]) -> list[np.ndarray]:
        """Slices of each row's sum of weighted rough attributes, up to a constant of all rows."""
        at: dict[int, list[int]] = {}
        negative = len(self.slices) // 2
        for j, power, sign in weights:
            for b in range(self.bits):
                at.setdefault(power + b, []).append(j * self.bits + b + (negative if sign < 0 else 0))
        out, carried, power = [], [], 0
        last = max(at, default=-1)
        while power <= last or carried:
            parts = carried + ([self.slices[at[power]]] if power in at else [])
            s = np.concatenate(parts) if parts else np.zeros((1, len(self.valid)), np.uint64)
            carried = []
            while len(s) > 2:
                k = len(s) // 3
                a, b, c = s[:k], s[k : 2 * k], s[2 * k : 3 * k]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                s = np.concatenate([odd ^ c, s[3 * k :]])
            if len(s) == 2:
                carried.append((s[0] & s[1])[None])
                s = (s[0] ^ s[1])[None]
            out.append(s[0])
            if power >= last and carried and not any(c.any() for c in carried):
                break
            power += 1
        return out

    def others(self, own: int) -> np.ndarray:
        """The block's rows without those of the id `own`, as a bitmap."""
        same = np.flatnonzero(self.ids == own)
        if not len(same):
            return self.valid
        mask = np.unpackbits(self.valid.view(np.uint8), bitorder="little")
        mask[same] = 0
        return np.packbits(mask, bitorder="little").view(np.uint64)

    def boundary(self, slices: list[np.ndarray], k: int, valid: np.ndarray) -> int:
        """The k-th largest sum of the rows in `valid` (0, if there are fewer rows), from the top slice down."""
        equal, above, value = valid, np.zeros_like(valid), 0
        for i in range(len(slices) - 1, -1, -1):
            more = above | (equal & slices[i])
            if int(np.bitwise_count(more).sum()) >= k:
                equal = equal & slices[i]
                value |= 1 << i
            else:
                above, equal = more, equal & ~slices[i]
        return value

    def at_least(self, slices: list[np.ndarray], value: int, valid: np.ndarray) -> np.ndarray:
        """Numbers of the rows in `valid` whose sum is at least `value`."""
        if value >> len(slices):
            return np.zeros(0, np.int64)
        above, equal = np.zeros_like(valid), valid
        for i in range(len(slices) - 1, -1, -1):
            if value >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))

    def best(self, own: int, query: np.ndarray, weights: list[tuple[int, int, int]], k: int, least: int | None) -> list[tuple[int, int]]:
        """(-score, id) of the block's k best rows other than `own`; rows that score below `least` may be left out."""
        slices, valid = self.add(weights), self.others(own)
        error = sum(map(abs, query.tolist())) * ((1 << self.shift) - 1)  # of rough scores, from end to end
        bound = self.boundary(slices, k, valid) - -(-error // (1 << self.shift))
        if least is not None:
            offset = sum(((1 << self.bits) - 1) << power for _, power, sign in weights if sign < 0)
            fixed = self.product(self.low[None], query)[0]
            up = sum(x for x in query.tolist() if x > 0) * ((1 << self.shift) - 1)
            bound = max(bound, -(-(least - fixed - up) // (1 << self.shift)) + offset)
        rows = self.at_least(slices, max(0, bound), valid)
        found = zip(self.product(self.data[rows], -query), self.ids[rows].tolist(), strict=True)
        return sorted(found)[:k]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, rows: int = 32_768, queries: int = 16_384, dropped: int = 2,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for every row for which `is_query` holds."""
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("q"))
    n = picked.count()
    rows = min(rows, max(64, -(-n // (2 * spark.sparkContext.defaultParallelism))))  # a few blocks for every core
    index = durable(_index(picked.select("id", "v").repartition(max(1, -(-n // rows))), rows, scale, dropped), "bit_slices")
    taken = F.when(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), None).otherwise(F.col("v"))
    asked = picked.where("q and id is not null").select("id", taken.alias("v")).where("size(v) > 0").dropDuplicates(["id"])
    stored = durable(asked, "queries")
    held = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("v")).alias("numbers")).first()
    turns = max(1, -(-held["rows"] // queries), -(-(held["numbers"] or 0) // NUMBERS))
    dealt = stored.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)))
    found = None
    for turn in range(turns):  # each takes about `queries` rows, hash-dealt
        table = dealt.where(F.col("turn") == turn).select("id", "v").toArrow()
        now = [(i, whole(v.values, scale)) for i, v in zip(table["id"].to_pylist(), table["v"], strict=True)]
        best = durable(_best(index, now, k), "best")
        found = best if found is None else found.union(best)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(index: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of every task's blocks for each query."""
    shared = index.sparkSession.sparkContext.broadcast(asked)  # bounded by top_k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in shared.value]
        for b in batches:
            for k_row in range(b.num_rows):
                block = BitSlices.load({n: b.column(n)[k_row].as_py() for n in b.schema.names})
                for own, (i, x) in zip(best, shared.value, strict=True):
                    if len(x) == len(block.low):
                        least = -own[k - 1][0] if len(own) >= k else None
                        own[:] = sorted(own + block.best(i, x, digits(x), k, least))[:k]
        for a in range(0, len(best), 1000):
            flat = [(i, v, -s) for (i, _), own in zip(shared.value[a : a + 1000], best[a : a + 1000], strict=True) for s, v in own]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long")
