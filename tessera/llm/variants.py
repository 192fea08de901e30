"""Spelling variants: words one letter apart, and the frequent form that each rare one leads to.

Tasks count the runs of letters of their texts; sums over all texts give the words.  A word's keys are 64-bit
polynomial hashes of the word and of what is left without one letter: with the running sum of letter * base**place over
a batch of words, the part before a letter and the part behind it (divided by the base, which is odd and so has an
inverse) give every deletion key by two subtractions.  Keys are dealt by their leading bits and sorted; words that
share a key are compared by the strings they share, so a clash of hashes joins nothing.  Equal letters in a row give
one key, with the places it stands for.  Two words of one length are near if both lose the same place; words whose
lengths differ by one, if one is the other's deletion.  A group tells every member how many others are near it and
which is best, without building pairs; roots follow by doubling the steps of the few words that have a form.

Keys of words up to SHORT letters carry the word.  Longer words would make that quadratic: theirs carry a number, and
only keys that two words share fetch the strings.  Groups are small at any size, since a place holds at most 90
letters.

Null texts have no words and a null id counts as empty; rows that repeat count as often as they stand there.  Texts of
any length are read a part at a time; ties end in the smaller word; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ODD, Scratch, cut, durable, mixed, spread, text_bytes

RUN = re.compile("[a-zÀ-ÿ]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SHORT = 64
RADIX_BITS = 16
HELD = 200_000  # words that a task counts before it passes them on
KEYS = "key long, lo int, hi int, whole boolean, id long, word string, n long"


def occurrences(docs: DataFrame, id_column: str, text_column: str, every: int) -> DataFrame:
    """word, n: runs of letters, one letter deleted in those whose checksum with the document's id `every` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                start = zlib.crc32(f"{doc or ''}:".encode())
                for part in cut(raw.lower(), 1 << 20):
                    for word, n in Counter(RUN.findall(part.decode("utf-8", "replace"))).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                    if len(total) >= HELD:
                        yield passed_on()
        yield passed_on()

    return docs.select(F.col(id_column).cast("string"), F.col(text_column)).mapInArrow(run, "word string, n long")


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points in one array, where each word starts, and its length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(length) - length, length


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def keyed(words: list[str]) -> tuple[np.ndarray, ...]:
    """row, key, lo, hi, whole: one key a word, and one for every run of equal letters, places lo to hi."""
    letters, start, length = flat(words)
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(letters)) - start[row]
    power = powers(int(length.max(initial=0)) + 1)
    term = mixed(letters.astype(np.uint64) + ODD) * power[place]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    before, end = upto[start], upto[start + length]
    first = np.flatnonzero((place == 0) | (letters != np.concatenate([letters[:1], letters[:-1]])))
    last = np.append(first[1:], len(letters))[: len(first)] - 1
    of = row[first]
    left = (upto[first] - before[of]) + INVERSE * (end[of] - upto[first + 1])
    key = np.concatenate([end - before, left])
    size = np.concatenate([length, length[of] - 1])
    key = mixed(key + size.astype(np.uint64) * ODD).view(np.int64)
    zero = np.zeros(len(words), np.int64)
    whole = np.arange(len(key)) < len(words)
    return np.concatenate([np.arange(len(words)), of]), key, np.concatenate([zero, place[first]]), np.concatenate([zero, place[last]]), whole


def keys(words: DataFrame, carry: bool) -> DataFrame:
    """The keys of words up to SHORT letters with the words (carry), or those of longer ones with their numbers.

    The longest short words are whole among the keys of longer ones, as they can be nothing else to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1).to_pylist()
            row, key, lo, hi, whole = keyed(words)
            length = np.fromiter(map(len, words), np.int64, len(words))[row]
            left = (whole & (length < SHORT)) | (~whole & (length <= SHORT)) if carry else (whole & (length >= SHORT)) | (~whole & (length > SHORT))
            row, key, lo, hi, whole = (x[left] for x in (row, key, lo, hi, whole))
            word = b.column(1).take(pa.array(row)) if carry else pa.nulls(len(row), pa.string())
            columns = [pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(whole), b.column(0).take(pa.array(row)), word, b.column(2).take(pa.array(row))]
            for at in range(0, len(row), 50_000):  # a batch has as many keys as letters
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], ["key", "lo", "hi", "whole", "id", "word", "n"])

    limit = f"char_length(word) <= {SHORT}" if carry else f"char_length(word) >= {SHORT}"
    return words.where(limit).select("id", "word", "n").mapInArrow(run, KEYS)


def split(group: np.ndarray, words: list[str], lo: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Numbers of groups in which not only the key but the string behind it is the same; group: of rows in order of key."""
    letters, start, length = flat(words)
    own = length - ~whole
    skip = np.where(whole, length, lo)
    same = np.flatnonzero(group[1:] == group[:-1])  # row i against row i + 1
    equal = own[same] == own[same + 1]
    rows = same[equal]
    at = spread(np.zeros(len(rows), np.int64), own[rows])
    which = np.repeat(rows, own[rows])
    a = letters[start[which] + at + (at >= skip[which])]
    b = letters[start[which + 1] + at + (at >= skip[which + 1])]
    bad = {*group[same[~equal]].tolist(), *group[which[a != b]].tolist()}
    if bad:  # a clash of hashes
        group, fresh = group.copy(), int(group.max()) + 1
        for g in bad:
            strings: dict[str, int] = {}
            for i in np.flatnonzero(group == g).tolist():
                text = words[i] if whole[i] else words[i][: lo[i]] + words[i][lo[i] + 1 :]
                group[i] = strings.setdefault(text, fresh + len(strings))
            fresh += len(strings)
    return group


def best_of_others(group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the size of its group and the row of its group that comes first in `order`, itself left out."""
    by = np.lexsort((order, group))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) > 0]))
    size = np.diff(np.append(starts, len(by)))
    first, second = by[starts], by[np.minimum(starts + 1, len(by) - 1)]
    number = np.empty(len(by), np.int64)
    number[by] = np.repeat(np.arange(len(starts)), size)
    return size[number], np.where(first[number] == np.arange(len(by)), second[number], first[number])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, n, form: what every group of one key adds to its members; batches come in order of key."""
    held: list[pa.RecordBatch] = []

    def told(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        many = np.bincount(group)[group] > 1
        table, group = table.filter(pa.array(many)), group[many]
        words, n, whole = table["word"].combine_chunks(), table["n"].to_numpy(), table["whole"].to_numpy()
        lo, hi = table["lo"].to_numpy().astype(np.int64), table["hi"].to_numpy().astype(np.int64)
        group = split(group, words.to_pylist(), lo, whole) if len(group) else group
        rank = np.asarray(pc.rank(words, tiebreaker="dense")) if len(group) else np.zeros(0, np.int64)
        order = np.empty(len(n), np.int64)
        order[np.lexsort((rank, -n))] = np.arange(len(n))

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, how many are near, the best of them
        cut_rows = np.flatnonzero(~whole)
        if len(cut_rows):
            run = hi[cut_rows] - lo[cut_rows] + 1
            row, place = np.repeat(cut_rows, run), spread(lo[cut_rows], run)
            same = group[row] * (int(place.max()) + 1) + place
            size, other = best_of_others(same, order[row])
            near = size > 1
            out.append((row[near], size[near] - 1, row[other[near]]))
            holder = np.full(int(group.max()) + 1, -1, np.int64)
            holder[group[whole]] = np.flatnonzero(whole)
            longer = cut_rows[holder[group[cut_rows]] >= 0]
            if len(longer):
                short = holder[group[longer]]
                out.append((longer, np.ones(len(longer), np.int64), short))
                by = np.lexsort((order[longer], short))
                starts = np.flatnonzero(np.concatenate([[True], np.diff(short[by]) > 0]))
                out.append((short[by[starts]], np.diff(np.append(starts, len(by))), longer[by[starts]]))
        row, near, best = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        columns = [words.take(pa.array(row)), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), words.take(pa.array(best))]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "n", "form"])

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if last or held and held[-1].column(0)[-1].as_py() != key[0]:
            yield told(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        held.append(b.slice(last))
    if held:
        yield told(pa.Table.from_batches(held))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form: each round doubles the steps, and counts at least double with each step."""
    keep = Scratch()
    now = keep.store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep.store(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            result = durable(after.select("word", "root"), "roots")
            keep.clear()
            return result
        now = after.select("word", "root")


def variants(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", letters: int = 5, least: int = 3, times: int = 2, every: int = 97,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `letters` letters or more that stand `least` times or more."""
    keep = Scratch()
    found = occurrences(docs, id_column, text_column, every).where(f"char_length(word) >= {int(letters)}")
    found = found.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {int(least)}")
    words = keep.store(found.withColumn("id", F.monotonically_increasing_id()), "words")
    long = keys(words, False)
    shared = long.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    long = long.drop("word").join(shared, "key", "left_semi").join(words.select("id", "word"), "id").select("key", "lo", "hi", "whole", "id", "word", "n")
    every_key = keys(words, True).unionByName(long)
    dealt = every_key.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    near = dealt.mapInArrow(met, "word string, n_near long, n long, form string")
    best = F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    good = F.expr(f"-best.less >= {int(times)} * n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
    )
    judged = durable(judged, "judged")
    keep.clear()
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
