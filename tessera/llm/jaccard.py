"""Exact Jaccard join on word n-grams by signature trees, with components of the linked documents.

1. Every text becomes its set of n-gram hashes; texts with equal sets are one class from there on.
2. A sketch of fixed size counts n-grams, which decides about order only.  In the order (count, hash) two sets that link share one of the first
   |A| - ceil(t |A|) + 1 n-grams of each, so those are dealt out; classes under one n-gram are a block.  Common
   passages come last in that order and make no large blocks.  Blocks with equal members, or within another, are
   dropped.  N-grams of more than CHUNK classes (counted exactly) join into clusters, which are cut by size and hash
   into chunks, so no walk holds more than a chunk and as many visitors.
3. Each block gets a signature tree: its leaves hold bitmaps of the sets (a fraction of a byte an n-gram), its nodes
   the OR of the bitmaps below and the range of sizes.  Walking pairs of nodes from the root down, a pair is left if
   its sizes don't fit or if the common bits leave too small an overlap.  Only the bitmaps are dealt to the blocks;
   members that reach no possible partner go, and so do blocks that then lie in another.
4. What is left gets its whole sets and is walked again, with pairs of leaves verified on the sets.  First every set
   goes to one block, its home, which finds most of each component; of a cluster's chunks then one set a component
   meets.  Blocks that still hold several components are walked by bitmaps once more, without pairs of one component
   or one home, and only the sets that are possible partners there meet again.  Of a cluster, members outside its
   largest component go to all chunks of fitting size, the others stay in their own.
5. Links found in blocks meet in connected components.

No pair of a group is expanded: a block of n like texts costs about n verifications.  N-grams are hashes of 64 bits
(48 when whole sets are compared).
Texts without words (or null) have empty sets and link with nothing; texts of fewer than `words` words are one n-gram.
Very long texts are sets like any other; repeated rows link with one another; a row without an id takes part, and only
the ids of others name its component; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import ODD, SPACE, Scratch, durable, forget, in_batches, mixed, text_bytes

SLOTS = 18  # the sketch has 2**SLOTS counters
BLOOM = 26  # at most 2**BLOOM bits
CHUNK = 2000
SMALL = 2_000_000  # rows of (block, set_id) that may be broadcast: 32 MB

CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
CODES[ord("A") : ord("Z") + 1] = CODES[ord("a") : ord("z") + 1]  # lower case

def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, ODD, np.uint64), dtype=np.uint64)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    ink = ~SPACE[data]
    edge = np.flatnonzero(np.diff(ink.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    length = end - start
    own = np.flatnonzero(ink)
    place = own - np.repeat(start, length)
    value = CODES[data[own]] * powers(int(length.max()))[place]
    word = mixed(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], ends_of_text[:-1]]))
    count = np.diff(np.append(first, len(start)))
    gram = np.zeros(len(word), np.uint64)
    for k in range(words):
        gram[: len(word) - k] = gram[: len(word) - k] * ODD + word[k:]
    gram = mixed(gram)
    out = []
    for f, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= words:
            g = gram[f : f + c - words + 1].copy()
            g.sort()
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif c:
            whole = np.uint64(c)
            for w in word[f : f + c]:
                whole = np.uint64((int(whole) * int(ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """Name of a class of equal sets."""
    return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for group in in_batches(text_bytes(column), len, 2 << 20):
        yield from shingles(group, words)


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n has with any that it links with."""
    return -(-percent * n // 100)


def links(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set: two to four bits for every n-gram, a power of two of them."""
    width = max(256, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def aligned(signatures: list[bytes]) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words: wider ones are folded, which their slots (hash mod width) allow."""
    width = min(map(len, signatures))
    rows = [np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in signatures]
    return np.array(rows)


class Tree:
    """Signature tree over one block; subclasses say what is done at pairs of leaves, and which pairs need no visit."""

    FAN = 8

    def __init__(self, packed: np.ndarray, size: np.ndarray, percent: int):
        self.percent = percent
        excess = size - np.bitwise_count(packed).sum(1).astype(np.int64)
        self.levels = [(packed, size, size, excess)]
        while len(self.levels[-1][0]) > self.FAN:
            b, low, high, over = self.levels[-1]
            at = np.arange(0, len(b), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))

    def visit(self, a: int, b: int) -> None:
        raise NotImplementedError

    def settled(self, level: int, a: int, b: int) -> bool:
        raise NotImplementedError

    def children(self, level: int, node: int) -> range:
        return range(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][0])))

    def below(self, level: int, node: int) -> slice:
        return slice(node * self.FAN**level, min((node + 1) * self.FAN**level, len(self.levels[0][0])))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a linking pair, by their size ranges and the largest overlap their bits allow."""
        bits, low, high, over = self.levels[level]
        p = self.percent
        fits = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a])
        a_, b_ = a[fits], b[fits]
        if level == 0:  # bits of one that the other lacks are n-grams that it lacks
            common = np.minimum(
                high[a_] - np.bitwise_count(bits[a_] & ~bits[b_]).sum(1).astype(np.int64),
                high[b_] - np.bitwise_count(bits[b_] & ~bits[a_]).sum(1).astype(np.int64),
            )
        else:
            common = np.bitwise_count(bits[a_] & bits[b_]).sum(1).astype(np.int64) + np.minimum(over[a_], over[b_])
        fits[fits] = (100 + p) * common >= p * (low[a_] + low[b_])
        return fits

    def pairs(self, level: int, first: range, second: range | None) -> None:
        """Walk the pairs of nodes of two families, or of one with itself."""
        a = np.repeat(np.array(first), len(second or first))
        b = np.tile(np.array(second or first), len(first))
        if second is None:
            a, b = a[a < b], b[a < b]
        ok = self.possible(level, a, b)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if level == 0:
                self.visit(x, y)
            elif not self.settled(level, x, y):
                self.pairs(level - 1, self.children(level, x), self.children(level, y))

    def walk(self) -> None:
        """Visit every pair of leaves that isn't pruned or settled."""
        for level in range(1, len(self.levels)):
            for node in range(len(self.levels[level][0])):
                self.pairs(level - 1, self.children(level, node), None)
        top = len(self.levels) - 1
        self.pairs(top, range(len(self.levels[top][0])), None)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all values of both arrays are one value other than 0."""
    return bool(x[0] != 0 and x[0] == y[0] and (x == x[0]).all() and (y == x[0]).all())


class Partners(Tree):
    """Which sets have a possible partner, by signatures alone; not one of their own component or home (0: none)."""

    def __init__(self, signatures: list[bytes], size: np.ndarray, percent: int, component: np.ndarray | None = None, home: np.ndarray | None = None):
        super().__init__(aligned(signatures), size, percent)
        self.paired = np.zeros(len(signatures), bool)
        self.same = [x for x in (component, home) if x is not None]

    def visit(self, a: int, b: int) -> None:
        if not any(x[a] == x[b] != 0 for x in self.same):
            self.paired[a] = self.paired[b] = True

    def settled(self, level: int, a: int, b: int) -> bool:
        x, y = self.below(level, a), self.below(level, b)
        return bool(self.paired[x].all() and self.paired[y].all()) or any(alike(s[x], s[y]) for s in self.same)


class Links(Tree):
    """Components of the sets that link, verified on the whole sets; sets of one home (0: none) are verified already."""

    def __init__(self, sets: list[np.ndarray], percent: int, component: np.ndarray | None = None, home: np.ndarray | None = None):
        super().__init__(aligned(list(map(signature, sets))), np.array([len(s) for s in sets]), percent)
        self.sets, self.root = sets, np.arange(len(sets))
        self.home = np.zeros(len(sets), np.int64) if home is None else home
        if component is not None:
            _, first, own = np.unique(component, return_index=True, return_inverse=True)
            self.root = first[own]

    def visit(self, a: int, b: int) -> None:
        if self.root[a] == self.root[b] or self.home[a] == self.home[b] != 0:
            return
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        if links(int((y[at] == x).sum()), len(x), len(y), self.percent):
            old, new = max(self.root[a], self.root[b]), min(self.root[a], self.root[b])
            self.root[self.root == old] = new

    def settled(self, level: int, a: int, b: int) -> bool:
        """Whether everything below both nodes is one component or of one home."""
        x, y = self.below(level, a), self.below(level, b)
        return alike(self.root[x] + 1, self.root[y] + 1) or alike(self.home[x], self.home[y])

    def join(self) -> np.ndarray:
        """Root of each set's component within the block."""
        self.walk()
        return self.root


KEEP = np.uint64(16)  # bits of hashes that whole sets go without between tasks


def packed(s: np.ndarray) -> bytes:
    """A sorted set as steps between its 48-bit values, a plane for each byte: the high planes of steps compress away."""
    steps = np.diff(s >> KEEP, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple]]]:
    """(block, columns after it by set id) from batches sorted by block; a class may come from several tasks."""
    key, rows = None, {}
    for b in batches:
        for block, i, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block != key:
                if rows:
                    yield key, rows
                key, rows = block, {}
            rows[i] = tuple(rest)
    if rows:
        yield key, rows


def describe(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, set_id, n_shingles, signature) of all documents, stored, and the sketch of n-gram counts over distinct sets.

    A task gives the signature of each class of equal sets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SLOTS, np.int64), set()
        names = ["doc_id", "set_id", "n_shingles", "signature", "part", "counts"]

        def batch(*columns: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            own, n, bits = [], [], []
            for s in _sets(b.column(1), words):
                own.append(set_id(s) if len(s) else None)
                n.append(len(s))
                bits.append(None)
                if len(s) and own[-1] not in seen:
                    seen.add(own[-1])
                    bits[-1] = signature(s)
                    np.add.at(counts, (s >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
            yield batch(b.column(0).to_pylist(), own, n, bits, [None] * len(n), [None] * len(n))
        if counts.any():
            parts = np.split(counts.astype("<u4"), 64)
            yield batch(*[[None] * 64] * 4, list(range(64)), [p.tobytes() for p in parts])

    schema = "doc_id long, set_id long, n_shingles long, signature binary, part int, counts binary"
    found = durable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "sets")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    # 64 parts of fixed size, summed on executors
    rows = found.where("part is not null").select("part", "counts").repartition(64, "part").mapInArrow(total, "part int, counts binary").collect()
    sketch = np.zeros((64, (1 << SLOTS) // 64), np.int64)
    for r in rows:
        sketch[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return found.where("part is null").select("doc_id", "set_id", "n_shingles", "signature"), sketch.reshape(-1)


def deal(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """Members of blocks: (heavy, block, set_id, size), stored; heavy rows name an n-gram, others a hash of their members."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32))  # fixed size
    heavy_from = max(CHUNK, int(8 * sketch.mean()))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        sketch = shared.value
        for b in batches:
            grams, owner, heavy = [], [], []
            for s in _sets(b.column(0), words):
                if not len(s) or (own := set_id(s)) in seen:
                    continue
                seen.add(own)
                n = sketch[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]
                at = np.argsort(n, kind="stable")[: len(s) - needed(len(s), percent) + 1]
                grams.append(s[at])
                owner.append(np.full(len(at), own, np.int64))
                heavy.append(n[at] >= heavy_from)
            if grams:
                arrays = [np.concatenate(grams).view(np.int64), np.concatenate(owner), np.concatenate(heavy)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["gram", "set_id", "heavy"])

    rows = docs.select("text").mapInArrow(prefixes, "gram long, set_id long, heavy boolean")
    salt = F.when(F.col("heavy"), F.xxhash64("set_id")).otherwise(F.lit(0))
    dealt = rows.repartition("gram", salt).sortWithinPartitions("gram", "set_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(gram: np.ndarray, own: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
            gram, own, heavy = gram[new], own[new], heavy[new]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(first, len(gram)))
            heavy = heavy | np.repeat(size > CHUNK, size)  # by the exact number of its sets
            name = mixed(np.add.reduceat(mixed(own.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
            keep = heavy | np.repeat(size > 1, size)
            block = np.where(heavy, gram, np.repeat(name, size))
            columns = (heavy, block, own, np.repeat(size, size))
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["heavy", "block", "set_id", "size"])

        rest, crowded = None, None  # the last n-gram of a batch may go on in the next; one that is known to be too large
        for b in batches:
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            if crowded is not None:
                now[2] = now[2] | (now[0] == crowded)
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if len(np.unique(now[1][cut:])) > CHUNK:  # no task holds more of one n-gram
                crowded, now[2] = now[0][-1], now[2] | (now[0] == now[0][-1])
                cut = len(now[0])
            rest = [x[cut:] for x in now]
            if cut:
                yield found(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield found(*rest)

    return durable(dealt.mapInArrow(blocks, "heavy boolean, block long, set_id long, size long"), "blocks")


def largest_blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, set_id) without blocks that lie in another; blocks are named by their members, so equal ones are one."""
    rows = scratch.store(members.select("block", "set_id", "size").distinct(), "light")
    top = rows.groupBy("set_id").agg(F.max(F.struct("size", "block")).alias("top"))
    tops = rows.join(top, "set_id").groupBy("block").agg(F.min("top.block").alias("low"), F.max("top.block").alias("high"))
    # all members have the same largest block: it holds this one
    return rows.join(tops.where((F.col("low") != F.col("high")) | (F.col("low") == F.col("block"))).select("block"), "block").select("block", "set_id")


def clusters(members: DataFrame, group: str) -> DataFrame:
    """(set_id, cluster): the sets that groups of members connect; `group` holds 64-bit names."""
    least = members.groupBy(group).agg(F.min("set_id").alias("a"))
    edges = members.join(least, group).select("a", F.col("set_id").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))


def chunked(of: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(set_id, cluster, kind, chunks, block): clusters cut into chunks of about CHUNK sets.

    kind is the size class: sets that link lie in one class or in two neighbouring ones.  chunks is how many the class
    has in the cluster.
    """
    kind = F.floor(F.log("n_shingles") / float(np.log(100 / percent))).cast("int")
    sized = of.join(sizes, "set_id").select("set_id", "cluster", kind.alias("kind"))
    cut = sized.groupBy("cluster", "kind").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    return sized.join(cut, ["cluster", "kind"]).withColumn("block", chunk_name("kind", chunk))


def chunk_name(kind: str | Column, chunk: Column) -> Column:
    return F.xxhash64(F.lit("chunk"), "cluster", kind, chunk)


def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with `component` and `home` of their sets; sets that aren't known are components of their own without a home."""
    return rows.join(known, "set_id", "left").withColumns({"component": F.coalesce("component", "set_id"), "home": F.coalesce("home", F.lit(0).cast("long"))})


def representatives(cut: DataFrame, known: DataFrame) -> DataFrame:
    """(block, set_id): one set of each component of a cluster, in blocks of about CHUNK sets."""
    each = labelled(cut.select("set_id", "cluster"), known).groupBy("cluster", "component").agg(F.min("set_id").alias("set_id"))
    n = each.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = each.join(n, "cluster")
    return named.select(F.xxhash64(F.lit("one"), "cluster", F.pmod(F.xxhash64("set_id"), F.col("chunks"))).alias("block"), "set_id")


def odd_blocks(cut: DataFrame, known: DataFrame) -> DataFrame:
    """(block, set_id): chunks with the members outside the cluster's largest component from all chunks of fitting size.

    A chunk that more than CHUNK such members visit stands once for every CHUNK of them, so no block is larger than a
    chunk and CHUNK visitors.
    """
    rows = labelled(cut, known)
    n = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    rows = rows.join(main, "cluster")
    odd = rows.where("component <> main").select("set_id", "cluster", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)).alias("near"))
    turns = odd.groupBy("cluster", "near").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("turns"))
    kinds = cut.select("cluster", F.col("kind").alias("near"), F.col("chunks").alias("near_chunks")).distinct().join(turns, ["cluster", "near"])
    name = lambda chunk, turn: F.xxhash64(F.lit("turn"), "cluster", "near", chunk, turn).alias("block")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = rows.withColumnRenamed("kind", "near").join(kinds, ["cluster", "near"]).withColumn("turn", each("turns"))
    own = own.select(name(F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"), F.col("turn")), "set_id")
    odd = odd.join(kinds, ["cluster", "near"]).withColumn("chunk", each("near_chunks"))
    odd = odd.select(name(F.col("chunk"), F.pmod(F.xxhash64(F.lit("turn"), "set_id"), F.col("turns")).cast("int")), "set_id")
    return own.union(odd).distinct()


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of fixed size over set ids; false positives only cost work."""
    slot = F.pmod("set_id", F.lit(1 << bits))
    words = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("v"))
    rows = words.toPandas()  # at most 2**(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, grams) of documents whose class is (almost surely) wanted, once a task."""
    n = wanted.count()
    bits = min(BLOOM, max(12, (16 * n).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, have = set(), shared.value
        for b in batches:
            for group in in_batches(_sets(b.column(0), words), lambda s: 8 * len(s), 4 << 20):
                ids, data = [], []
                for s in group:
                    if not len(s) or (own := set_id(s)) in seen:
                        continue
                    slot = own % (1 << bits)
                    if int(have[slot >> 6]) >> (slot & 63) & 1:
                        seen.add(own)
                        ids.append(own)
                        data.append(packed(s))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["set_id", "grams"])

    return docs.select("text").mapInArrow(run, "set_id long, grams binary")


def with_partners(blocks: DataFrame, signatures: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(block, set_id, size) of the members that may link within their block, by its signature tree; blocks get new names.

    Pairs of one component or one home of `known` (set_id, component, home) don't count.
    """
    extra = ["component", "home"] if known is not None else []
    rows = blocks if known is None else labelled(blocks, known)
    rows = rows.join(signatures, "set_id").select("block", "set_id", "n_shingles", "signature", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one in by_block(batches):
            if len(one) < 2:
                continue
            own = sorted(one, key=lambda i: (one[i][0], i))
            same = [np.array([one[i][2 + k] for i in own], np.int64) for k in range(len(extra))]
            tree = Partners([one[i][1] for i in own], np.array([one[i][0] for i in own]), percent, *same)
            tree.walk()
            left = np.array(own, np.int64)[tree.paired]
            if len(left):
                name = set_id(np.sort(left.view(np.uint64)))
                columns = (np.full(len(left), name), left, np.full(len(left), len(left)))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["block", "set_id", "size"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, set_id long, size long")


def tree_links(blocks: DataFrame, sets: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b): each class and the root of its component within a block, from the block's signature tree."""
    n = blocks.count()
    extra = ["component", "home"] if known is not None else []
    blocks = blocks if known is None else labelled(blocks, known)
    small = F.broadcast(blocks) if n <= SMALL else blocks  # 32 bytes a row; beyond that the sets meet their blocks in a shuffle
    rows = sets.join(small, "set_id").select("block", "set_id", "grams", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one in by_block(batches):
            if len(one) < 2:
                continue
            own = sorted(((unpacked(x), i) for i, (x, *_) in one.items()), key=lambda x: (len(x[0]), int(x[0][0]), x[1]))
            same = [np.array([one[i][1 + k] for _, i in own], np.int64) for k in range(len(extra))]
            root = Links([s for s, _ in own], percent, *same).join().tolist()
            found = [(own[r][1], own[k][1]) for k, r in enumerate(root) if r != k]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def join_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    described, sketch = describe(docs, words)
    members = deal(docs, sketch, words, percent)
    signatures = described.where("signature is not null").select("set_id", "n_shingles", "signature").dropDuplicates(["set_id"])

    def linked(blocks: DataFrame, edges: DataFrame | None, known: DataFrame | None = None) -> DataFrame:
        """Components (node, component) of the links within blocks and the edges known before."""
        sets = whole_sets(docs, blocks.select("set_id").distinct(), words)
        new = tree_links(blocks, sets, percent, known)
        found = components(new if edges is None else new.union(edges))
        return durable(found, "linked")

    scratch = Scratch()
    paired = scratch.store(with_partners(largest_blocks(members.where("not heavy"), scratch), signatures, percent), "paired")
    trees = durable(largest_blocks(paired, scratch), "trees")
    scratch.clear()
    heavy = members.where("heavy").select("block", "set_id")
    crowded = not heavy.isEmpty()
    size = trees.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    home = trees.join(size, "block").groupBy("set_id").agg(F.max_by("block", F.struct("n", "block")).alias("home"))
    if crowded:
        cut = durable(chunked(clusters(heavy, "block"), signatures.select("set_id", "n_shingles"), percent), "chunks")
        own = durable(with_partners(cut.select("block", "set_id"), signatures, percent), "own").select("set_id", F.col("block").alias("home"))
        home = own.union(home.join(own, "set_id", "left_anti"))
    home = durable(home, "homes")
    forget(members)
    links = linked(home.select(F.col("home").alias("block"), "set_id"), None)

    def known() -> DataFrame:
        return home.join(links.select(F.col("node").alias("set_id"), "component"), "set_id", "full_outer")

    if crowded:
        ones = durable(representatives(cut, known()), "ones")
        links = linked(ones, links.toDF("b", "a").select("a", "b"))
    named = durable(known(), "known")
    open_ = labelled(trees, named).groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    again = trees.join(open_.select("block"), "block")
    if crowded:
        again = again.union(odd_blocks(cut, named))
    again = durable(largest_blocks(scratch.store(with_partners(again, signatures, percent, named), "paired"), scratch), "trees")
    scratch.clear()
    if not again.isEmpty():
        links = linked(again, links.toDF("b", "a").select("a", "b"), named)
    # classes of equal sets take part with their smallest document
    of = described.groupBy("set_id").agg(F.min("doc_id").alias("first")).where("set_id is not null")
    of = of.join(links, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("component", "set_id").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(least, "component").select("set_id", "component_id")
    # empty texts have no class: a join would bring them all to one task
    alone = described.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return described.where("set_id is not null").join(named, "set_id").select("doc_id", "n_shingles", "component_id").union(alone)
