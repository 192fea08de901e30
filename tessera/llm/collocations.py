"""Collocations: phrases of two or three words that stand together more often than their parts would by chance.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and laid out as shards of one language
and about `shard_bytes` each, a table in the shared folder.  Every shard tells the slots that the hashes of its words
and phrases fall into, and how often; a slot's sum over all shards is an upper bound for each phrase in it, and every
shard is told which of its own slots reach the threshold.  The phrases of such slots are the shard's candidates: they
are compiled into Aho-Corasick automata whose patterns begin and end with the delimiter, the shard is scanned once per
automaton, overlapping matches count, and counts are summed over shards before thresholds apply.  So the bounds only
save work, and every number is exact.

The number of slots follows the size of the corpus (2**23 for every 32 MB of text), and no task holds more than a
shard, an automaton of `patterns` phrases, or the messages of one part of the slots or phrases; nothing is broadcast.
There is a message for every shard and part, so beyond some hundred TB of text shards should be larger.

Counts go through the shuffle as one compressed message for every shard and part, its phrases in order, so that
neighbours share their beginnings.

Null texts are empty, a null language is `und`; rows that repeat count as often as they stand there.  A text longer
than a segment is cut between words, and the next segment repeats its last two words, whose own counts are taken off
again.  Ties in rank end in the phrase.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import ODD, Scratch, cut, mixed, text_bytes

#: ASCII bytes that end a piece become line ends, tabs become spaces.
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
SLOT_BITS = 23
PART_BYTES = 32 << 20
SALTS = 64


def segments(docs: DataFrame, text: str, lang: str, shard_bytes: int, segment_bytes: int = 1 << 20) -> DataFrame:
    """Normalised texts with the shard that each belongs to; `skip` bytes at a segment's start repeat the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = count(TaskContext.get().partitionId() << 32), {}  # language: its shard and the bytes in it
        for b in batches:
            out: list[list] = [[], [], [], []]
            for raw, name in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                tail = b""
                for part in cut(raw.lower().translate(BREAKS), segment_bytes):
                    shard, held = own.get(name, (-1, shard_bytes))
                    if held >= shard_bytes:
                        shard, held = next(number), 0
                    own[name] = shard, held + len(part)
                    whole = tail + part
                    for column, value in zip(out, (shard, name, len(tail), whole), strict=True):
                        column.append(value)
                    tail = b" ".join(whole.rsplit(b"\n", 1)[-1].split()[-2:]) if len(raw) > segment_bytes else b""
            types = (pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["shard", "lang", "skip", "text"])

    sent = docs.select(F.col(text), F.coalesce(F.col(lang).cast("string"), F.lit("und")))
    return sent.mapInArrow(run, "shard long, lang string, skip long, text binary")


def squeezed(x: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x)


def whole(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


class Tokens:
    """The words and phrases of one language's texts as numbers."""

    def __init__(self, texts: list[bytes], lang: str):
        text = pa.array([b"\n".join([b"", *texts]).decode("utf-8", "replace").replace("\n", " \n ")], pa.large_string())
        found = pc.split_pattern(text, " ").flatten()
        found = found.filter(pc.not_equal(found, "")).dictionary_encode()
        self.ids = found.indices.to_numpy().astype(np.int64)
        self.words = found.dictionary.to_pylist()  # in order of their first place, so 0 is the line end
        del text, found
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        a = self.ids
        self.first = [np.flatnonzero(a > 0)]
        pair = np.flatnonzero((a[:-1] > 0) & (a[1:] > 0)) if len(a) > 1 else np.zeros(0, np.int64)
        triple = pair[(pair + 2 < len(a))]
        triple = triple[a[triple + 2] > 0]
        self.first += [pair, triple]  # where phrases of one, two and three words begin
        h = hashes[a]
        two = mixed(h[pair] * ODD + h[pair + 1])
        inside = np.zeros(len(a), np.uint64)
        inside[pair] = two
        self.hashes = [mixed(h[self.first[0]]), two, mixed(inside[triple] * ODD + h[triple + 2])]

    def slots(self, bits: int) -> list[np.ndarray]:
        return [x >> np.uint64(64 - bits) for x in self.hashes]


def planes(x: np.ndarray) -> bytes:
    """Numbers under 2**32, compressed: all lowest bytes first, so that the zeros stand together."""
    return squeezed(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(whole(x), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Rising numbers under 2**32 as compressed differences."""
    return planes(np.diff(x, prepend=0))


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(numbers(x))


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[bytes]]]:
    for b in batches:
        texts: defaultdict[tuple[int, str], list[bytes]] = defaultdict(list)
        for shard, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            texts[shard, lang].append(text)
        for (shard, lang), own in texts.items():
            yield shard, lang, own


def sketch(stored: DataFrame, part_bits: int, least: int) -> DataFrame:
    """shard, part, slots, counts: the slots that a shard's words and phrases fall into, by part of the slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lang, texts in by_shard(batches):
            slots, n = np.unique(np.concatenate(Tokens(texts, lang).slots(SLOT_BITS + part_bits)), return_counts=True)
            if not len(slots):  # nothing but separators
                continue
            parts, at = np.unique(slots >> np.uint64(SLOT_BITS), return_index=True)
            ends = [*at[1:].tolist(), len(slots)]
            low = (slots & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            n = np.minimum(n, least).astype(np.uint8)
            columns = [
                pa.array([shard] * len(parts), pa.int64()), pa.array(parts.astype(np.int32)),
                pa.array([packed(low[a:b]) for a, b in zip(at.tolist(), ends, strict=True)], pa.binary()),
                pa.array([squeezed(n[a:b].tobytes(), 1) for a, b in zip(at.tolist(), ends, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "slots", "counts"])

    return stored.select("shard", "lang", "text").mapInArrow(run, "shard long, part int, slots binary, counts binary")


def answers(told: DataFrame, least: int) -> DataFrame:
    """shard, part, slots: of the slots that a shard named those whose sum over all shards reaches the threshold."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << SLOT_BITS, np.uint8)  # up to `least`, which is all that matters
        read = [(unpacked(s), n) for s, n in zip(table["slots"].to_pylist(), table["counts"].to_pylist(), strict=True)]
        for slots, n in read:
            n = np.frombuffer(whole(n), np.uint8)
            sums[slots] = np.minimum(sums[slots].astype(np.int64) + n, least)
        kept = [packed(slots[sums[slots] >= least]) for slots, _ in read]
        return pa.table({"shard": table["shard"], "part": table["part"], "slots": pa.array(kept, pa.binary())})

    return told.groupBy("part").applyInArrow(run, "shard long, part int, slots binary")


def present(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Where slots are among keys (sorted, at least one): a bitmap of their low bits first, then the keys themselves."""
    low = np.zeros(1 << 22, bool)
    low[keys & (len(low) - 1)] = True
    at = np.flatnonzero(low[(slots & np.uint64(len(low) - 1)).astype(np.int64)])
    found = slots[at].astype(np.int64)
    return at[keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found]


def scanned(ids: np.ndarray, less: list[np.ndarray], words: list[str], phrases: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """The matches of each phrase (rows of word numbers, 0 behind the last) in ids, overlapping ones included.

    Matches in `less` are taken off.  Patterns begin and end with the delimiter, a space; in the text, line ends and
    words of no phrase of the block are line ends between two delimiters, so no match reaches across.
    """
    for k in range(0, len(phrases), block):
        own = phrases[k : k + block]
        used = np.zeros(len(words), bool)
        used[own] = True
        used[0] = False
        automaton = ahocorasick.Automaton()
        for i, (x, y, z) in enumerate(own.tolist()):
            automaton.add_word(f" {words[x]} {words[y]} {words[z]} " if z else f" {words[x]} {words[y]} ", i)
        automaton.make_automaton()

        def matches(x: np.ndarray) -> np.ndarray:
            x = np.where(used[x], x, 0)
            x = x[np.concatenate([[True], (x[1:] > 0) | (x[:-1] > 0)])]  # one line end for many
            found = automaton.iter(f" {' '.join(map(words.__getitem__, x.tolist()))} ")
            return np.bincount(np.fromiter(map(itemgetter(1), found), np.int64), minlength=len(own))

        yield matches(ids) - sum(map(matches, less), np.zeros(len(own), np.int64))


def counted(stored: DataFrame, hot: DataFrame, part_bits: int, block: int) -> DataFrame:
    """lang, part, phrases, n of every shard: its candidates and their possible parts, "" for all words, by part."""
    bits = part_bits + 1

    def run(texts: pa.Table, hot: pa.Table) -> pa.Table:
        lang = texts["lang"][0].as_py() if len(texts) else ""
        rows = texts["text"].to_pylist()
        less = [t[:n].decode("utf-8", "replace").split(" ") for t, n in zip(rows, texts["skip"].to_pylist(), strict=True) if n]
        tokens = Tokens(rows, lang)
        del rows, texts
        number = dict(zip(tokens.words, range(len(tokens.words)))) if less else {}
        less = [np.array([number[w] for w in x]) for x in less]
        keys = [p * (1 << SLOT_BITS) + unpacked(s) for p, s in zip(hot["part"].to_pylist(), hot["slots"].to_pylist(), strict=True)]
        keys = np.unique(np.concatenate([*keys, np.array([-1])]))
        own = [present(keys, slots) for slots in tokens.slots(SLOT_BITS + part_bits)]
        one, two, three = (at[x] for at, x in zip(tokens.first, own, strict=True))
        parts = [(h[x] >> np.uint64(64 - bits)).astype(np.int64) for h, x in zip(tokens.hashes, own, strict=True)]
        tokens.hashes = own = []
        a, w = tokens.ids, tokens.words
        n = np.bincount(a, minlength=len(w)) - sum((np.bincount(x, minlength=len(w)) for x in less), np.zeros(len(w), np.int64))
        hot_pair = np.zeros(len(a) + 1, bool)
        hot_pair[two] = hot_pair[two + 1] = True
        scanned_ids = np.where(hot_pair[:-1], a, 0)  # both pairs of a triple that is no false candidate are candidates
        phrases, part = [np.zeros((1, 3), np.int64)], [np.zeros(1, np.int64)]  # word numbers, 0 behind the last
        for words, (at, p) in enumerate(zip((one, two, three), parts, strict=True), 1):
            key = a[at]
            for k in range(1, words):
                key = np.unique(key, return_inverse=True)[1] * len(w) + a[at + k]
            first = np.unique(key, return_index=True)[1]
            at = at[first]
            phrases.append(np.stack([a[at + k] if k < words else np.zeros(len(at), np.int64) for k in range(3)], 1))
            part.append(p[first])
        found = [np.array([n[1:].sum()]), n[phrases[1][:, 0]], *scanned(scanned_ids, less, w, np.concatenate(phrases[2:]), block)]
        phrases, part, found = map(np.concatenate, (phrases, part, found))
        order = np.lexsort((phrases[:, 1] * len(w) + phrases[:, 2], part * len(w) + phrases[:, 0]))
        order = order[(found[order] > 0) | (order == 0)]
        phrases, part, found = phrases[order], part[order], found[order]
        parts, at = np.unique(part, return_index=True)
        ends = [*at.tolist(), len(part)]
        first, later = pa.array(["", *w[1:]], pa.large_string()), pa.array(["", *(f" {x}" for x in w[1:])], pa.large_string())
        names = pc.binary_join_element_wise(*(x.take(pa.array(y)) for x, y in zip((first, later, later), phrases.T, strict=True)), pa.scalar("", pa.large_string()))
        lines = (b"\n".join(names.slice(x, y - x).cast(pa.large_binary()).to_pylist()) for x, y in zip(ends, ends[1:]))
        return pa.table({
            "lang": pa.array([lang] * len(parts), pa.string()), "part": pa.array(parts.astype(np.int32)),
            "phrases": pa.array(map(squeezed, lines), pa.binary()), "n": pa.array([planes(found[x:y]) for x, y in zip(ends, ends[1:])], pa.binary()),
        })

    # texts and answers meet by shard, and every shard has both or neither
    return stored.groupBy("shard").cogroup(hot.groupBy("shard")).applyInArrow(run, "lang string, part int, phrases binary, n binary")


def summed(told: DataFrame, least: int, most: int = 1 << 20) -> DataFrame:
    """lang, phrase, words, n: the phrases that reach the threshold over all shards, and under 0 words the sum of all words.

    A task holds the sums of its part and about as many new counts, `most` at least.
    """

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return sums.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for lang, phrases, n in zip(*(b.column(c).to_pylist() for c in ("lang", "phrases", "n")), strict=True):
                phrase = pc.split_pattern(pa.array([whole(phrases).decode("utf-8")], pa.large_string()), "\n").flatten()
                held.append(pa.table({"lang": pa.repeat(lang, len(phrase)), "phrase": phrase, "n": numbers(n)}))
                rows += len(phrase)
                if rows >= max(most, len(held[0])):
                    held, rows = [merged(held)], 0
        sums = merged(held)
        words = pc.if_else(pc.equal(sums["phrase"], ""), 0, pc.add(pc.count_substring(sums["phrase"], " "), 1)).cast(pa.int32())
        sums = pa.table({"lang": sums["lang"], "phrase": sums["phrase"].cast(pa.string()), "words": words, "n": sums["n"]})
        yield from sums.filter(pc.or_(pc.equal(words, 0), pc.greater_equal(sums["n"], least))).to_batches()

    return told.groupBy("part").applyInArrow(run, "lang string, phrase string, words int, n long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact while a is under 10**16."""
    long = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", long(a) * long(a) * F.lit(1_000_000).cast("decimal(7,0)"), long(left) * long(right))


def collocations(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", least: int = 10, inside_percent: int = 50, best: int = 2000,
    shard_bytes: int = 8 << 20, patterns: int = 100_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `best` phrases that `least` occurrences support.

    A phrase of two words goes if a candidate of three holds it and has `inside_percent` of its occurrences.
    """
    keep = Scratch()
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    part_bits = max(0, (size // PART_BYTES).bit_length())
    stored = keep.store(segments(docs, text_column, lang_column, shard_bytes), "segments", "zstd")
    hot = answers(sketch(stored, part_bits, least), least)
    sums = Scratch().store(summed(counted(stored, hot, part_bits, patterns), least), "phrases")
    keep.clear()

    word = F.split("phrase", " ")
    cuts = F.when(F.col("words") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    part = lambda first, last: F.array_join(F.slice(word, first, last), " ")
    cut_at = sums.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("k"))
    cut_at = cut_at.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    parts = sums.where("words in (1, 2)")
    for side, name in (("left", "l"), ("right", "r")):
        cut_at = cut_at.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cut_at = cut_at.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    judged = cut_at.groupBy("lang", "phrase", "words", "a").agg(least_cut).select("lang", "phrase", "a", "words", "cut.l", "cut.r", "cut.score")
    inside = sums.where("words = 3").select("lang", "n", F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = judged.join(inside, ["lang", "phrase"], "left").where(f"words = 3 or longer is null or 100 * longer < {int(inside_percent)} * a")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    totals = sums.where("words = 0").select("lang", "n")
    return few.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
