"""Quality by hierarchical empirical Bayes: what a document's classifier says, on the priors of its site and path.

1. A logistic regression over what the text is made of (normalised counts of hashed letter n-grams) and its shape
   (rates of capitals, digits, symbols and marks, line and word statistics), fitted on a bounded, hash-chosen sample of
   labelled rows, gives every document's log likelihood ratio: its logit less the sample's prior logit.  All documents'
   values are stored.
2. Grouped aggregation gives for every site (host) and every path below it the number of documents and the sum of
   their probabilities.  The rate of a site is drawn to the global rate, that of a path to its site's posterior; the
   strength of each prior comes from the groups themselves (method of moments: how far rates differ beyond what
   their sizes explain).  Sparse sites thus stay near the global prior.
3. A document's score is its own evidence on its path's posterior, from which its own share has been taken out.

Null sites and paths are groups of their own.  Null and empty texts have the features of an empty text.  Repeated
rows count as rows of their own.  Without usable labels of both kinds every document has the score 0.5 of its prior.
Very long texts are counted whole; an empty table gives no rows; kept columns may have any names, and one with the name
of an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import counts, normalised
from tessera.llm.shared import durable, in_batches, text_bytes

FEATURES = 13
GRAMS = 1024


def shape(text: Column) -> Column:
    """FEATURES numbers about a text, each between 0 and about 10."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1))
    words = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1))
    lines = F.greatest(F.regexp_count(t, F.lit(r"[^\n]+")), F.lit(1))

    def rate(pattern: str, per: Column) -> Column:
        return F.least(F.lit(10.0), 10 * F.regexp_count(t, F.lit(pattern)) / per)

    return F.array(
        rate(r"\p{Lu}", chars), rate(r"\d", chars), rate(r"[#*$%&<>]", chars), rate(r"\|", words), rate("!", words),
        rate("[.,;:?]", words), rate(r"(\S)\1\1", words), rate(r"\p{Lu}{3,}", words), rate(r"https?:|www\.|@", words),
        F.least(F.lit(10.0), chars / words / 2), F.least(F.lit(10.0), F.log1p(words)), F.least(F.lit(10.0), F.log1p(words / lines)),
        F.least(F.lit(10.0), F.log1p(lines)),
    )


def made_of(texts: list[bytes]) -> np.ndarray:
    """Normalised log counts of letter n-grams, hashed to GRAMS slots, a row a text."""
    folded = counts(texts).reshape(len(texts), -1, GRAMS).sum(1)
    return normalised(np.log1p(folded.astype(np.float32))).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of GRAMS n-grams, then of the FEATURES
    bias: float
    prior: float  # logit of the sample's rate

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio that documents are good, a row of GRAMS + FEATURES numbers each."""
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias - self.prior, -12, 12)


def vectors(shapes: pa.Array, texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of GRAMS + FEATURES numbers for groups of documents of about a megabyte."""
    flat = np.array(shapes.values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, FEATURES)
    at = 0
    for group in in_batches(text_bytes(texts), len, 1 << 20, 256):
        yield np.hstack([made_of(group), flat[at : at + len(group)]])
        at += len(group)


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = 6000, decay: float = 1.0) -> Model | None:
    """A model from about `most` usable labelled rows, chosen by a hash of their id: their vectors (4 KB each) go to the driver."""
    good = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = good.count()
    share = min(1.0, most / max(1, n))
    picked = good.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by `most`
    rows = rows.select(F.col("quality").cast("int").alias("quality"), shape(F.col("text")).alias("x"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for v in vectors(b.column(1), b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(v)), pa.array([r.tobytes() for r in v], pa.binary())], ["quality", "v"])
                at += len(v)

    got = rows.mapInArrow(run, "quality int, v binary").toArrow()
    y = got["quality"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(got["v"].to_pylist()), "<f4").reshape(len(y), -1)
    order = np.lexsort((x[:, -1], x[:, 0], x[:, 1], y))
    x, y = x[order].astype(np.float64), y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    scale[:GRAMS] = np.maximum(scale[:GRAMS], np.median(scale[:GRAMS]) + 1e-6)  # rare n-grams don't grow
    x = (x - mean) / scale
    rate = float(y.mean())
    w, b = np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    dw, db = np.zeros_like(w), 0.0
    step = 4.0 / (float(np.square(x).sum(1).mean()) + decay)
    for _ in range(300):  # gradient descent with momentum
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        dw, db = 0.9 * dw - step * (x.T @ (p - y) / len(y) + decay / len(y) * w), 0.9 * db - step * float((p - y).mean())
        w, b = w + dw, b + db
    return Model(mean, scale, w, b, float(np.log(rate / (1 - rate))))


def strength(groups: DataFrame, parent_rate: str) -> float:
    """Prior strength (in documents) for the rates of groups with columns n and s, by the method of moments.

    Groups of one document say nothing of the spread within; all others count by their size.
    """
    r, m = F.col("s") / F.col("n"), F.col(parent_rate)
    got = groups.where("n > 1").agg(
        F.sum(F.col("n") * (r - m) * (r - m)).alias("between"), F.sum(m * (1 - m)).alias("expected"),
        F.sum("n").alias("n"), F.sum(m * (1 - m) * F.col("n")).alias("spread"), F.count(F.lit(1)).alias("groups"),
    ).first()
    if not got["n"] or not got["spread"]:
        return 100.0
    # a rate's variance is spread / n from sampling and tau from the groups: n (r - m)^2 is spread + n tau on average
    tau = (got["between"] - got["expected"]) / got["n"]
    within = got["spread"] / got["n"]
    return float(min(10_000.0, max(2.0, within / tau - 1))) if tau > 1e-9 else 10_000.0


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, model: Model | None, host: Column, path: Column, *keep: str, text_column: str = "text", threshold: float = 0.5,
) -> DataFrame:
    """The columns of `keep`, evidence, host_prior, path_prior, score (that the document is good) and kept."""
    outputs = ("evidence", "host_prior", "path_prior", "score", "kept")
    keep = tuple(c for c in keep if c not in outputs)  # a kept column of an output's name gives way to it
    base = docs.select(*keep, F.col(text_column).alias("_text"), F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("")).alias("_host"), F.coalesce(F.concat(F.lit("="), path.cast("string")), F.lit("")).alias("_path"))
    if model is None:
        base = base.drop("_text", "_host", "_path")
        half = F.lit(0.5)
        return base.select(*keep, F.lit(0.0).alias("evidence"), half.alias("host_prior"), half.alias("path_prior"), half.alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    sent = base.select(*keep, "_host", "_path", shape(F.col("_text")).alias("_x"), "_text")
    names = [*keep, "_host", "_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.evidence(v) for v in vectors(b.column(len(names)), b.column(len(names) + 1))]
            arrays = [*b.columns[: len(names)], pa.array(np.concatenate(found).astype(float) if found else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "evidence"])

    kinds = dict(sent.dtypes)
    own = sent.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "evidence double"]))
    own = durable(own.withColumn("_p", 1 / (1 + F.exp(-(F.col("evidence") + model.prior)))), "quality")

    paths = durable(own.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")), "quality_paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total["s"] or 0.5) / (total["n"] or 1)
    k_host = strength(hosts.withColumn("m", F.lit(rate)), "m")
    host_post = hosts.select("_host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("m"))
    sited = durable(paths.join(host_post, "_host"), "quality_sites")
    k_path = strength(sited, "m")

    # a document's own probability is taken out of its groups before they speak for it
    host_m = (F.col("host_s") - F.col("_p") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    path_m = (F.col("s") - F.col("_p") + k_path * F.col("host_prior")) / (F.col("n") - 1 + k_path)
    placed = own.join(sited, ["_host", "_path"]).withColumn("host_prior", host_m).withColumn("path_prior", path_m)
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_prior")))))
    return placed.select(*keep, "evidence", "host_prior", "path_prior", score.alias("score")).withColumn("kept", F.col("score") >= threshold)
