"""Small helpers that several operators share: durable intermediate tables, text columns, chunk tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.store import shared_folder as shared_dir


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Names of the folders that `durable` makes.
STORED = re.compile(r"\w+-[0-9a-f]{32}")


def forget(*tables: DataFrame) -> None:
    """Remove tables that `durable` stored and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for f in t.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if not STORED.fullmatch(path.getName()):
                raise ValueError(f"{path} is no table of durable()")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Stores tables for one part of a job and removes them after it."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def store(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self.tables.append(durable(df, name, compression))
        return self.tables[-1]

    def clear(self) -> None:
        forget(*self.tables)
        self.tables = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n: the split into training and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


SPACE = np.zeros(256, bool)  # ASCII white space
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ... as one array."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class ChunkTable:
    """What a task knows of each distinct white-space separated chunk that it has met.

    `make(chunks)` gets only chunks not known yet and returns bytes for each (32-bit numbers).  Chunks are found by a
    hash of 64 bits and compared by their content, so a clash of hashes costs a call of `make` and nothing else.  All
    is kept in flat arrays; the table is emptied between groups of texts once it holds `most` bytes.

    Chunks also end between an ASCII letter and one of the ASCII characters `apart`, so that a word is one chunk with
    and without a comma.
    """

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], apart: str = "", most: int = 48 << 20):
        self.make, self.most = make, most
        self.kind = np.where(SPACE, 0, 1).astype(np.uint8)
        self.kind[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 2
        self.kind[[*map(ord, apart)]] = 3
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # in order, with the entry of each
        self.entry = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)  # of each entry's chunk, whose content is 64-bit lanes from lane_at
        self.lane_at = np.zeros(0, np.int64)
        self.lanes = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)  # of each entry's value, from value_at
        self.value_at = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.uint32)

    @property
    def held(self) -> int:
        return 48 * len(self.entry) + self.lanes.nbytes + self.values.nbytes

    def _made(self, chunks: list[bytes]) -> np.ndarray:
        """Appends the values of chunks; their sizes."""
        made = self.make(chunks)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        self.values = np.concatenate([self.values, np.frombuffer(b"".join(made), "<u4")])
        return size

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        raw = b"\n".join(texts) + b"\n" + bytes(8)
        data = np.frombuffer(raw, np.uint8)[:-8]
        kind = self.kind[data]
        border = kind[1:] + kind[:-1] == 5
        start = np.flatnonzero((kind[1:] > 0) & (border | (kind[:-1] == 0))) + 1
        end = np.flatnonzero((kind[:-1] > 0) & (border | (kind[1:] == 0))) + 1
        if kind[0]:
            start = np.append(0, start)
        if not len(start):
            yield from [b""] * len(texts)
            return
        length = end - start
        n = (length + 7) >> 3
        first = np.cumsum(n) - n
        which = spread(np.zeros(len(n), np.int64), n)
        at = np.repeat(start, n) + 8 * which
        lanes = np.ndarray((len(data),), "<u8", raw, 0, (1,))[at] & LOW_BYTES[np.minimum(np.repeat(end, n) - at, 8)]
        hashes = mixed(np.add.reduceat(mixed(lanes + which.astype(np.uint64) * ODD), first) + length.astype(np.uint64))
        own, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, own)
        have = np.zeros(len(own), bool)
        inside = place < len(self.hashes)
        have[inside] = self.hashes[place[inside]] == own[inside]
        new = sample[~have]
        if len(new):
            known, filled = len(self.entry), len(self.values)
            size = self._made(list(map(raw.__getitem__, map(slice, start[new].tolist(), end[new].tolist()))))
            self.hashes = np.insert(self.hashes, place[~have], own[~have])
            self.entry = np.insert(self.entry, place[~have], known + np.arange(len(new)))
            self.length = np.concatenate([self.length, length[new]])
            self.lane_at = np.concatenate([self.lane_at, len(self.lanes) + np.cumsum(n[new]) - n[new]])
            self.lanes = np.concatenate([self.lanes, lanes[spread(first[new], n[new])]])
            self.size = np.concatenate([self.size, size])
            self.value_at = np.concatenate([self.value_at, filled + np.cumsum(size) - size])
        entry = self.entry[np.searchsorted(self.hashes, own)][back]
        value_at, size = self.value_at[entry], self.size[entry]
        wrong = self.length[entry] != length
        same = np.where(wrong, 0, n)
        if same.any():
            differ = lanes[spread(first, same)] != self.lanes[spread(self.lane_at[entry], same)]
            wrong[np.repeat(np.arange(len(n)), same)[differ]] = True
        for i in np.flatnonzero(wrong).tolist():  # another chunk with the same hash
            value_at[i] = len(self.values)
            size[i] = self._made([raw[start[i] : end[i]]])[0]
        out = self.values[spread(value_at, size)]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, ends)].tolist()
        for a, b in zip([0, *bounds[:-1]], bounds, strict=True):
            yield out[a:b].tobytes()

    def joined(self, texts: Iterator[bytes], most: int = 1 << 20) -> Iterator[bytes]:
        """For each text the values of its chunks, one after the other; texts go in groups of about `most` bytes."""
        for group in in_batches(texts, len, most):
            if self.held > self.most:
                self.clear()
            if len(group[-1]) <= most:
                yield from self._group(group)
                continue
            yield from self._group(group[:-1]) if len(group) > 1 else ()
            parts = []
            for part in cut(group[-1], most):
                if self.held > self.most:
                    self.clear()
                parts += self._group([part])
            yield b"".join(parts)


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text of about `most` bytes that end where a chunk does."""
    a = 0
    while a < len(text):
        b = a + most
        if b < len(text):
            view = SPACE[np.frombuffer(text, np.uint8, min(4096, len(text) - b), b)]
            while not view.any() and b + len(view) < len(text):
                b += len(view)
                view = SPACE[np.frombuffer(text, np.uint8, min(4096, len(text) - b), b)]
            b += int(view.argmax()) if view.any() else len(view)
        yield text[a:b]
        a = b


def scored(docs: DataFrame, keep: tuple[str, ...], text_column: str, outputs: str, judge: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """The columns of `keep` and `outputs` (DDL); a kept column of an output's name gives way to it.

    Each task calls `judge()` once; what it returns makes the output columns of an Arrow column of texts.
    """
    names = [x.split()[0] for x in outputs.split(", ")]
    keep = tuple(c for c in keep if c not in names)
    sent = docs.select(*keep) if text_column in keep else docs.select(*keep, F.col(text_column).alias("_text"))
    at = keep.index(text_column) if text_column in keep else len(keep)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in sent.dtypes[: len(keep)]), outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *of(b.column(at))], [*b.schema.names[: len(keep)], *names])

    return sent.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every value of an Arrow string column, b"" for null; no Python string is made."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def in_batches(items: Iterator, size: Callable, most: int = 8 << 20, rows: int = 4000) -> Iterator[list]:
    """Lists of items of about `most` bytes (by `size`) and `rows` items at most."""
    batch, held = [], 0
    for x in items:
        batch.append(x)
        held += size(x)
        if held >= most or len(batch) >= rows:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch
