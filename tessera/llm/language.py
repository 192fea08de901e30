"""Language identification by nearest centroid.

A text's vector counts its letter n-grams (bytes 1 to 3, of lower-cased letters with runs of anything else as one
space), hashed to DIMS slots, damped by log(1 + n), weighted by inverse document frequency and normalised.  Every
language has several centroids, found by spherical k-means over a bounded, hash-chosen sample of labelled rows.
The nearest centroid by cosine gives the language; a text that is much farther from it than almost any training text
is rejected.  Short texts have few n-grams and so lie farther from any centroid; the limit shrinks with their number.

Null and empty texts and texts without letters get "und", score 0, and are rejected.  Ties go to the language
first in alphabetical order.  Rows without a language never train.  Very long texts are counted whole, in blocks;
repeated rows are judged as rows of their own; an empty table gives no rows (a model without languages gives "und").
Kept columns may have any names; one with the name of an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import in_batches, scored, text_bytes

DIMS = 4096
UNKNOWN = "und"
#: N-grams from which a text's distance is taken at face value.
ENOUGH = 600
BLOCK = 1 << 20


def _table() -> np.ndarray:
    """Byte to byte: lower case for A-Z, bytes of longer characters unchanged, anything else a space."""
    out = np.full(256, 32, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[128:] = np.arange(128, 256)
    return out


LETTERS = _table()


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, a row a text."""
    data = LETTERS[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    after_c3 = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[after_c3] += 0x20  # capital letters of Latin-1
    keep = (data != 32) | np.concatenate([[True], data[:-1] != 32])
    data, row = data[keep], row[keep]
    out = np.zeros(len(texts) * DIMS, np.int64)
    for a in range(0, len(data), BLOCK):  # n-grams that start in a block; the numbers made of them stay small
        for n in (1, 2, 3):
            last = min(len(data) - n + 1, a + BLOCK)
            code = np.zeros(max(0, last - a), np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + data[a + k : last + k]
            slot = (((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            first = row[a:last]
            ok = first == row[a + n - 1 : last + n - 1]
            at = (first.astype(np.int64) * DIMS + slot)[ok]
            if len(at) > len(out) // 8:
                out += np.bincount(at, minlength=len(out))
            else:
                np.add.at(out, at, 1)
    return out.reshape(len(texts), DIMS)


def normalised(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, for each centroid

    def distances(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of every text with every centroid, and the number of n-grams of every text."""
        found = counts(texts)
        return normalised(np.log1p(found.astype(np.float32)) * self.idf) @ self.centroids.T, found.sum(1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosine, grams = self.distances(texts)
        best = cosine.argmax(1)
        top = cosine[np.arange(len(texts)), best]
        letters = [has_letter(t) for t in texts]
        languages = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        scores = [float(s) if ok else 0.0 for s, ok in zip(np.clip(top, 0, 1), letters, strict=True)]
        far = top < self.least[best] * np.minimum(1, np.sqrt(grams / ENOUGH))
        return languages, scores, [bool(f) or not ok for f, ok in zip(far, letters, strict=True)]


def k_means(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from texts at even steps of closeness to the mean; centroids, and each text's."""
    order = (vectors @ vectors.mean(0)).argsort(kind="stable")
    c = vectors[order[((np.arange(min(k, len(vectors))) + 0.5) / min(k, len(vectors)) * len(vectors)).astype(int)]]
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(1)
        c = normalised(np.array([vectors[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, (vectors @ c.T).argmax(1)


def train(
    docs: DataFrame, usable: Column, id_column: str = "doc_id", per_language: int = 800, clusters: int = 3, margin: float = 0.35
) -> Model:
    """A model from about `per_language` rows of each language for which `usable` holds, chosen by a hash of their id.

    The sample's vectors, at most some thousand numbers each, go to the driver; that is the documented bound.
    A text is rejected below `margin` times the cosine that all but one per cent of its language's sample reach.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(7), id_column), F.lit(1 << 20)) < F.try_element_at(rate, "lang") * (1 << 20))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for group in in_batches(zip(ids, langs, text_bytes(b.column(2)), strict=True), lambda x: len(x[2]), 1 << 20, 500):
                dense = counts([t for _, _, t in group])
                slots = [np.flatnonzero(x) for x in dense]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in group], pa.int64()), pa.array([x[1] for x in group], pa.string()),
                        pa.array([s.astype("<u2").tobytes() for s in slots], pa.binary()),
                        pa.array([x[s].astype("<u4").tobytes() for s, x in zip(slots, dense, strict=True)], pa.binary()),
                    ],
                    ["id", "lang", "slots", "n"],
                )

    rows = chosen.select(F.col(id_column).cast("long"), "lang", "text").mapInArrow(vectors, "id long, lang string, slots binary, n binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["id"] is None, r["id"] or 0, r["slots"]))
    dense = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        dense[i, np.frombuffer(r["slots"], "<u2")] = np.frombuffer(r["n"], "<u4")
    idf = (np.log((1 + len(rows)) / (1 + (dense > 0).sum(0))) + 0.1).astype(np.float32)
    dense = normalised(np.log1p(dense) * idf)
    of = np.array([r["lang"] for r in rows])
    languages, centroids, least = [], [], []
    for lang in sorted(share):
        own = dense[of == lang]
        if len(own):
            c, at = k_means(own, clusters)
            limit = margin * float(np.quantile((own * c[at]).sum(1), 0.01))
            for j in range(len(c)):
                if (at == j).any():
                    languages.append(lang)
                    centroids.append(c[j])
                    least.append(limit)
    return Model(languages, np.array(centroids, np.float32), idf, np.array(least))


def identify(docs: DataFrame, model: Model, *keep: str, text_column: str = "text") -> DataFrame:
    """The columns of `keep`, with lang_pred, score and rejected.  Only the text takes part in a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids a language

    def judge() -> Callable[[pa.Array], list]:
        def of(texts: pa.Array) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for group in in_batches(text_bytes(texts), len, 1 << 20, 256):
                for column, values in zip(out, shared.value.predict(group), strict=True):
                    column.extend(values)
            return [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())]

        return of

    return scored(docs, keep, text_column, "lang_pred string, score double, rejected boolean", judge)
