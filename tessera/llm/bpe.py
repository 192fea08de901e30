"""BPE encoding and decoding by speculation: greedy longest match proposes, pair checks verify, few words are merged.

A word's greedy longest-match split is its BPE encoding if every token encodes to itself and every two neighbours
are compatible, i.e. no merge across their border would come before the merges inside them.  Both conditions are
checked for all words of a batch at once with numpy; only words that fail go through the merge loop, which also
runs for all of them together.  Encodings depend on white-space separated chunks alone, so each task encodes every
distinct chunk once and looks the others up in a table of bounded size.

Null and empty texts have no tokens.  Very long texts are encoded whole, in parts that end at white space; repeated
rows and rows without an id are encoded as any other; an empty table gives no rows; other columns don't matter.  Special tokens are matched in the raw text, as the tokenizers library does.
The files must be BPE of whole lower-cased words with an end-of-word suffix and no decoder (then decoding joins the
tokens with spaces); other files are refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.shared import ChunkTable, text_bytes

#: What the tokenizer's patterns take as white space, and its split into words.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SUFFIX = "</w>"
WORDS_AND_ENDS = regex.compile(WORDS.pattern + "|\n")
NEVER = np.int64(1) << 40
APART = "0123456789!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # never in one word with a letter, nor in a special token
LAST = 1 << 10  # above all byte letters
KNOWN = 150_000  # words that an encoder remembers; no word is longer than MEMORABLE letters
MEMORABLE = 100


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for every byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") or model.get("end_of_word_suffix") != SUFFIX or model["type"] != "BPE":
            raise ValueError(f"{path}: not a word BPE with the suffix {SUFFIX} and without a decoder")
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        if any(set(APART) & set(x) for x in special):
            raise ValueError(f"{path}: special tokens with one of {APART}")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        names = [""] * size
        for k, v in [*vocab.items(), *special.items()]:
            names[v] = k
        self.names = [x.encode() for x in names]
        self.finder = ahocorasick.Automaton()  # leftmost longest tokens of words whose last letter is moved by LAST
        self.span = np.zeros(size, np.int64)
        for k, v in vocab.items():
            word = k.removesuffix(SUFFIX)
            if k.endswith(SUFFIX):
                word = word[:-1] + chr(ord(word[-1]) + LAST)
            self.finder.add_word(word, v)
            self.span[v] = len(word)
        self.finder.make_automaton()
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.inner_of, self.last_of = np.full((2, LAST), -1, np.int64)
        for c in self.letters.values():
            if c not in vocab or c + SUFFIX not in vocab:
                raise ValueError(f"{path}: no token for {c}")
            self.inner_of[ord(c)], self.last_of[ord(c)] = vocab[c], vocab[c + SUFFIX]

        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self.rank_of[made] = np.arange(len(pairs))
        self.left_of, self.right_of = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left_of[made], self.right_of[made] = left, right
        order = np.argsort(left << 20 | right)
        self.keys, self.ranks, self.made = (left << 20 | right)[order], order.astype(np.int64), made
        if (self.rank_of[left] >= np.arange(len(pairs))).any() or (self.rank_of[right] >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge uses tokens of later merges")
        self.good = self._self_encoding(pairs, made, left, right)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, NEVER if there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _self_encoding(self, pairs: list, made: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each token's own text encodes to it."""
        fits = self.compatible(left, right, np.arange(len(pairs)))
        good = np.ones(len(self.names), bool)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), fits.tolist(), strict=True):
            good[m] = ok and good[a] and good[b]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b happens (before the merge of rank `until`, if given).

        Goes back in time: x and y touch the border and last until merges of rank x_end and y_end take them;
        a merge of x and y itself must come no earlier.  Among merges of one rank the leftmost comes first.
        """
        n = len(a)
        ok, alive = np.ones(n, bool), np.arange(n)
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_end = np.full(n, NEVER) if until is None else until.astype(np.int64)
        y_end = x_end.copy() if until is None else x_end - 1
        while len(alive):
            r = self._rank(x, y)
            crossed = (r < x_end) & (r <= y_end) & (r < NEVER)
            ok[alive[crossed]] = False
            rx, ry = self.rank_of[x], self.rank_of[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            alive, x, y, x_end, y_end, rx, ry = (v[go] for v in (alive, x, y, x_end, y_end, rx, ry))
            undo_x = rx > ry
            x_end, y_end = np.where(undo_x, rx, np.minimum(x_end, ry + 1)), np.where(undo_x, np.minimum(y_end, rx), ry)
            x, y = np.where(undo_x, self.right_of[x], x), np.where(undo_x, y, self.left_of[y])
        return ok

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words, one word after the other, their number in each, and words not covered.

        One scan proposes for all.  A word's last letter is moved by LAST, as in the tokens that end words, so no token
        reaches over the end of a word.
        """
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).copy()
        letters[ends - 1] += LAST
        found = np.fromiter(chain.from_iterable(self.finder.iter_long(letters.tobytes().decode("utf-32-le"))), np.int64).reshape(-1, 2)
        end, ids = found[:, 0], found[:, 1]
        word = np.searchsorted(ends - 1, end)
        covered = np.bincount(word, self.span[ids], len(words)) == np.diff(ends, prepend=0)
        return ids, np.bincount(word, minlength=len(words)), ~covered

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words written in byte letters."""
        if not words:
            return []
        ids, lengths, failed = self.propose(words)
        ends = np.cumsum(lengths)
        bad = ~self.good[ids]
        inside = np.ones(len(ids), bool)
        inside[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inside)
        key, back = np.unique(ids[at] << 20 | ids[at + 1], return_inverse=True)
        bad[at] |= ~self.compatible(key >> 20, key & 0xFFFFF)[back]
        failed |= np.bincount(np.repeat(np.arange(len(words)), lengths)[bad], minlength=len(words)) > 0
        failed = np.flatnonzero(failed).tolist()
        data = ids.astype("<u4").tobytes()
        bounds = [0, *(4 * ends).tolist()]
        out = list(map(data.__getitem__, map(slice, bounds[:-1], bounds[1:])))
        for i, x in zip(failed, self.merge([words[i] for i in failed]), strict=True):
            out[i] = x
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Exact merging, step by step, of all words side by side (words of like length together)."""
        out: list = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            most = len(words[order[0]]) + max(1, len(words[order[0]]) // 8)
            n = next((k for k, i in enumerate(order) if len(words[i]) > most), len(order))
            n = min(n, max(1, (1 << 18) // most))
            part, order = order[:n], order[n:]
            step = self._merge if most <= 64 else self._merge_long
            for i, ids in zip(part, step([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all letters, with the word and the place in it of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        ids = self.inner_of[letters]
        ids[ends - 1] = self.last_of[letters[ends - 1]]
        return ids, np.repeat(np.arange(len(words)), lengths), np.arange(len(ids)) - np.repeat(ends - lengths, lengths)

    def _merge(self, words: list[str]) -> list[bytes]:
        """Merges of many short words: a row a place, a column a word, so each step runs along many words."""
        long = max(map(len, words))
        ids, word, place = self._symbols(words)
        sym = np.full((long, len(words)), -1, np.int64)
        sym[place, word] = ids
        rank = np.full(sym.shape, NEVER)
        for c in range(long - 1):
            rank[c] = np.where(sym[c + 1] >= 0, self._rank(sym[c], np.maximum(sym[c + 1], 0)), NEVER)
        done: list = [b""] * len(words)
        names = np.arange(len(words))

        def finish(which: np.ndarray) -> None:
            n = (sym[:, which] >= 0).sum(0)
            flat = sym[:, which].T[np.arange(long) < n[:, None]].astype("<u4").tobytes()
            ends = np.cumsum(4 * n).tolist()
            for i, x, y in zip(names[which].tolist(), [0, *ends], ends, strict=False):
                done[i] = flat[x:y]

        while len(names):
            low, at = rank[0].copy(), np.zeros(len(names), np.int64)
            for c in range(1, long):  # the leftmost of the lowest
                at[rank[c] < low] = c
                np.minimum(low, rank[c], out=low)
            going = low < NEVER
            if not going.all():
                finish(np.flatnonzero(~going))
                keep = np.flatnonzero(going)
                if not len(keep):
                    break
                sym, rank, names, low, at = sym[:, keep], rank[:, keep], names[keep], low[keep], at[keep]
            made = self.made[low]
            for c in range(long - 1):  # what stands right of the merge moves left
                after = at < c
                sym[c] = np.where(after, sym[c + 1], np.where(at == c, made, sym[c]))
                rank[c] = np.where(after, rank[c + 1], rank[c])
            sym[long - 1] = np.where(at < long - 1, -1, sym[long - 1])
            k = np.arange(len(names))
            right = np.where(at + 1 < long, sym[np.minimum(at + 1, long - 1), k], -1)
            rank[at, k] = np.where(right >= 0, self._rank(made, np.maximum(right, 0)), NEVER)
            i = np.flatnonzero(at > 0)
            rank[at[i] - 1, i] = self._rank(sym[at[i] - 1, i], made[i])
        return done

    def _merge_long(self, words: list[str]) -> list[bytes]:
        """Merges of a few long words: a row a word."""
        ids, word, place = self._symbols(words)
        sym = np.full((len(words), max(map(len, words))), -1, np.int64)
        sym[word, place] = ids
        rank = np.full(sym.shape, NEVER)
        i, j = np.nonzero(sym[:, 1:] >= 0)
        rank[i, j] = self._rank(sym[i, j], sym[i, j + 1])
        done: list = [b""] * len(words)
        rows = np.arange(len(words))
        cols = np.arange(sym.shape[1])[None, :]
        while len(rows):
            at = rank.argmin(1)  # the leftmost of the lowest
            low = rank[np.arange(len(rows)), at]
            for i in np.flatnonzero(low == NEVER).tolist():
                done[rows[i]] = sym[i][sym[i] >= 0].astype("<u4").tobytes()
            go = np.flatnonzero(low < NEVER)
            sym, rank, at, low, rows = sym[go], rank[go], at[go], low[go], rows[go]
            k = np.arange(len(rows))
            sym[k, at] = self.made[low]
            moved = cols + (cols > at[:, None])  # what stands right of the merge moves left
            moved[:, -1] = np.minimum(moved[:, -1], sym.shape[1] - 1)
            sym, rank = np.take_along_axis(sym, moved, 1), np.take_along_axis(rank, moved, 1)
            short = at < sym.shape[1] - 1
            sym[short, -1], rank[short, -1] = -1, NEVER
            for side in (at - 1, at):
                i = np.flatnonzero((side >= 0) & (side + 1 < sym.shape[1]))
                a, b = sym[i, side[i]], sym[i, side[i] + 1]
                rank[i, side[i]] = np.where(b >= 0, self._rank(a, np.maximum(b, 0)), NEVER)
        return done

    def _special_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that may hold special tokens."""
        out = b""
        for p in self.special_pattern.split(chunk):
            out += np.uint32(self.special[p]).tobytes() if p in self.special else b"".join(self.encode_chunks([p.encode()], False))
        return out

    def encode_chunks(self, chunks: list[bytes], special: bool = True) -> list[bytes]:
        """Ids of chunks without ASCII white space as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start in range(0, len(chunks), 50_000):
            part = chunks[start : start + 50_000]
            text = b"\n".join(part).decode("utf-8", "replace")
            raw = text.split("\n") if special and self.special_pattern and "<|" in text else None
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            lower = text.lower().split("\n")
            plain = list(map(str.isalpha, lower))
            words = WORDS_AND_ENDS.findall("".join(f"{c}\n" for c, p in zip(lower, plain, strict=True) if not p))
            if len(self.known) > KNOWN:
                self.known = {}
            new = list({*compress(lower, plain), *words}.difference(self.known, "\n"))
            if new:
                letters = [w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.letters) for w in new]
                self.known.update(zip(new, self.encode_words(letters), strict=True))
            self.known["\n"] = b""
            got = list(map(self.known.__getitem__, words))
            ends = [i for i, w in enumerate(words) if w == "\n"]
            others = map(b"".join, map(got.__getitem__, map(slice, [0, *ends], [*ends, len(got)])))
            made = [self.known[c] if p else next(others) for c, p in zip(lower, plain, strict=True)]
            for i in (i for i, c in enumerate(raw or ()) if "<|" in c):
                made[i] = self._special_chunk(raw[i])
            out += made
            for w in (w for w in new if len(w) > MEMORABLE):
                self.known.pop(w, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def chunk_table(path: str) -> ChunkTable:
    """A table for one task.  The vocabulary stays with the worker; what was learned of texts goes with the task."""
    bpe = load(path)
    bpe.known = {}
    return ChunkTable(bpe.encode_chunks, APART)


def encoded(
    docs: DataFrame, path: str, schema: str, rows: Callable[[Bpe, list, Iterator[bytes]], list[list]],
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """mapInArrow over (id, text): `rows(bpe, ids, encodings)` gives the columns of `schema` for a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = load(path), chunk_table(path)
        for b in batches:
            columns = rows(bpe, b.column(0).to_pylist(), table.joined(text_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        bpe.known = {}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, types = arrow.names, arrow.types
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary): the whole encoding of every document."""
    def rows(_: Bpe, ids: list, codes: Iterator[bytes]) -> list[list]:
        return [ids, list(codes)]

    return encoded(docs, path, f"{id_column} long, ids binary", rows, id_column, text_column)


def decode_documents(encodings: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): what the ids of every row stand for; null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(x or b"").decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encodings.select(id_column, ids_column).mapInArrow(run, f"{id_column} long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    def rows(bpe: Bpe, ids: list, codes: Iterator[bytes]) -> list[list]:
        n, sha, back = [], [], []
        for c in codes:
            n.append(len(c) // 4)
            sha.append(hashlib.sha256(c).hexdigest())
            back.append(hashlib.sha256(bpe.decode(c)).hexdigest())
        return [ids, n, sha, back]

    return encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
