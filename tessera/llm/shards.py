"""Token shards in training order: fixed-stride binary records, placed by a keyed permutation.

1. Every task joins its documents' token ids (each with an end id behind it) and cuts them into sequences of
   `length` ids; only a task's last sequence is padded.  The sequences are stored once, numbered within their task.
2. The number of sequences of each task, a row a task, gives every sequence a global index below N.
3. A Feistel network keyed by `key` permutes the numbers below the next power of four; walking its cycle until the
   number is below N makes that a permutation of 0..N-1 (each step stays below 4 N, so walks are short).  The result is
   the sequence's slot: its place in training order.  Nothing is sorted globally, and any slot can be computed alone.
4. Slots are dealt to range partitions of `per_shard` slots.  Each writes one file of records of the same size in the
   order of slots: ids as little-endian unsigned integers of 2 bytes (4 if the vocabulary needs it) and one byte at
   the end.  Slot s lies in shard s // per_shard at byte (s % per_shard) * stride, so readers can seek and resume.
   An index beside them, also by shard, names the documents of every sequence.

Files go through Spark's committer, so a lost executor leaves no half of a shard, and to any file system that Spark
can write.  Null and empty texts have only the end id.  An empty table gives no shards.  Very long texts go over as
many sequences as they need; repeated rows and rows without an id are written as often as they come; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import chunk_table
from tessera.llm.shared import durable, text_bytes

ROUNDS = 4
TURNS = 4  # in which shards are written, so that only a part of all records lies in shuffle files at once
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MOST_STEPS = 10_000  # a step fails with a chance of 3/4 at most


def slot_of(index: Column, n: int, key: int) -> Column:
    """Slot of each index in 0..n-1: a Feistel network with cycle-walking, as an expression."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for r in range(ROUNDS):
            left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(key), F.lit(r), right).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    # the walk: an expression of fixed depth can't loop, so it unrolls in a fold that stops changing once below n
    def walked(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda x, _: F.when(x < n, x).otherwise(once(x)))

    # a walk of 64 steps hardly ever falls short; the few that do go on from where they stopped
    long = F.transform(F.array(walked(once(index), 64)), lambda x: F.when(x < n, x).otherwise(walked(x, MOST_STEPS)))[0]
    return F.when(long < n, long).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long"))


def sequences(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, pad_id: int = 0, width: int = 2) -> DataFrame:
    """(part, i, ids, n_tokens, doc_ids): the sequences of every task, numbered within it; ids are `width` bytes each."""
    end = np.uint32(end_id).tobytes()
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, i, table = TaskContext.get().partitionId(), 0, chunk_table(path)
        rest, owners, full = b"", [], 4 * length

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def row(data: bytes, own: list[int]) -> tuple:
            nonlocal i
            ids = np.frombuffer(data, "<u4")
            if width == 2 and ids.max() > 0xFFFF:
                raise ValueError("ids need width=4")
            out = np.full(length, pad_id, kind)
            out[: len(ids)] = ids
            i += 1
            return part, i - 1, out.tobytes(), len(ids), list(dict.fromkeys(own))

        for b in batches:
            rows, size = [], 0
            for doc, code in zip(b.column(0).to_pylist(), table.joined(text_bytes(b.column(1))), strict=True):
                rest += code + end
                owners.append(doc)
                at = 0
                while len(rest) - at >= full:
                    rows.append(row(rest[at : at + full], owners))
                    at += full
                    owners = [doc] if len(rest) > at else []
                    size += 1
                    if size % 256 == 0:
                        yield batch(rows)
                        rows = []
                rest = rest[at:]
            if rows:
                yield batch(rows)
        if rest:
            yield batch([row(rest, owners)])

    names = ["part", "i", "ids", "n_tokens", "doc_ids"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, i long, ids binary, n_tokens int, doc_ids array<long>")


def materialise(
    docs: DataFrame, tokenizer: str, out: str, length: int = 2048, per_shard: int = 4096, key: int = 20240229, width: int = 2,
) -> DataFrame:
    """Write the shards under `out`/tokens and their index under `out`/index; the index is returned.

    The index has slot, shard, position (byte offset in the shard), n_tokens, doc_ids and crc32 of the record's ids.
    """
    found = durable(sequences(docs, tokenizer, length, width=width), "sequences", "zstd")
    counts = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a task
    n, first = 0, []
    for part in sorted(counts):
        first.append((part, n))
        n += counts[part]
    spark = docs.sparkSession
    starts = spark.createDataFrame(first, "part int, first long")
    slot = slot_of(F.col("first") + F.col("i"), n, key)
    stride = length * width + 1
    placed = found.join(F.broadcast(starts), "part").withColumn("slot", slot)
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    shards = max(1, -(-n // per_shard))
    record = F.col("ids").cast("string").alias("value")  # the bytes as they are
    turns = min(TURNS, shards)
    cleanup = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the files of a turn's shuffle go when it is written
    try:
        for turn in range(turns):
            now = placed.where(F.col("shard") % turns == turn).select("shard", "slot", record)
            dealt = now.repartitionById(-(-shards // turns), F.floor(F.col("shard") / turns).cast("int")).sortWithinPartitions("shard", "slot")
            dealt.select("value", "shard").write.mode("append").partitionBy("shard").text(f"{out}/tokens", lineSep="\n")
    finally:
        spark.conf.set(CLEANUP, cleanup)
    index = placed.select("slot", "shard", ((F.col("slot") % per_shard) * stride).alias("position"), "n_tokens", "doc_ids", F.crc32("ids").alias("crc32"))
    index.write.parquet(f"{out}/index")
    return spark.read.parquet(f"{out}/index")


def _records(
    spark: SparkSession, out: str, length: int, width: int, start_shard: int, result: str, kind: pa.DataType, make: Callable[[memoryview], object],
) -> DataFrame:
    """(shard, position, `result`) of every record from `start_shard` on, `make` of its ids; a shard is never copied."""
    stride = length * width + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/tokens")
    if "shard" not in files.columns:  # no sequence, so no shard
        files = files.withColumn("shard", F.lit(0))
    size = length * width
    name = result.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0), b.column(1), strict=True):
                data, own = memoryview(content.as_buffer()), shard.as_py()
                starts = range(0, len(data) - stride + 1, stride)
                for k in range(0, len(starts), 256):
                    part = starts[k : k + 256]
                    arrays = [pa.array([own] * len(part), pa.int32()), pa.array(list(part), pa.int64()), pa.array([make(data[i : i + size]) for i in part], kind)]
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "position", name])

    rows = files.where(F.col("shard") >= start_shard).select(F.col("shard").cast("int").alias("shard"), "content")
    return rows.mapInArrow(run, f"shard int, position long, {result}")


def read_records(spark: SparkSession, out: str, length: int = 2048, width: int = 2, start_shard: int = 0) -> DataFrame:
    """(shard, position, ids) of every record from `start_shard` on; shards before it aren't opened."""
    return _records(spark, out, length, width, start_shard, "ids binary", pa.binary(), bytes)


def verified(spark: SparkSession, index: DataFrame, out: str, length: int = 2048, width: int = 2) -> DataFrame:
    """The index with read_crc32, of the record that lies at each slot's place in the shard files (null if none does)."""
    read = _records(spark, out, length, width, 0, "read_crc32 long", pa.int64(), zlib.crc32)
    return index.join(read, ["shard", "position"], "left")
