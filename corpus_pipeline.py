"""Corpus pipeline: language, toxicity and near-duplicate filters, then packing into training sequences.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.  A row that a filter
rejects is gone for all later stages; the first three return the columns of their input, the last one the places of
all pieces.  Rows with null texts have no letters and leave with the first stage; rows without an id stay as any other.
Texts of any length are read whole; an empty table goes through all stages; columns may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, packing, toxicity
from tessera.llm.catalog import TOKENIZER
from tessera.llm.shared import documents, durable, shared_dir

FEW = 300_000  # keys that are broadcast: about 25 MB
KEY = F.xxhash64


def _filtered(docs: DataFrame, judged: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows of docs for which the condition holds on what `judged` adds; docs may have columns of the same names."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    found = judged(docs.toDF(*own), *own, text_column=own[docs.columns.index("text")]).where(condition)
    return found.select(*own).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of those learned from the rows that name theirs."""
    model = language.train(docs, F.lit(True))
    return _filtered(docs, lambda df, *keep, text_column: language.identify(df, model, *keep, text_column=text_column), "not rejected")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below one half; learned from the labelled rows among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return _filtered(docs, lambda df, *keep, text_column: toxicity.score_documents(df, model, *keep, text_column=text_column), "predicted = 0")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group linked by five-word shingles at 0.8.

    Rows are grouped by a 64-bit hash of their id and text, so rows without an id, and different texts of one id, are
    judged by their own text; of equal rows one stays.  A second hash tells rows apart that share the first: such rows
    all stay, so a clash loses nothing.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*own)
    doc, text = own[docs.columns.index("doc_id")], own[docs.columns.index("text")]
    keyed = named.withColumns({"_key": KEY(doc, text), "_check": F.xxhash64(F.lit(1), text, doc)})
    found = jaccard.join_documents(keyed.select(F.col("_key").alias("doc_id"), F.col(text).alias("text")), words=5, percent=80)
    found = durable(found.select(F.col("doc_id").alias("_key"), "component_id"), "components")
    ids = durable(keyed.groupBy("_key").agg(F.min(doc).alias("_doc"), F.min("_check").alias("low"), F.max("_check").alias("high"), F.count(F.lit(1)).alias("n")), "ids")
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("doc"), F.col("_key").alias("key")))
    kept = found.join(ids.where("low = high").select("_key", "_doc"), "_key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("_key"))
    kept = durable(kept.union(ids.where("low <> high").select("_key")), "kept")
    few = kept.count() <= FEW
    left = keyed.join(F.broadcast(kept) if few else kept, "_key", "left_semi")
    left = left if ids.where("n > 1").isEmpty() else left.dropDuplicates(["_key", "_check"])
    return left.select(*own).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens for all that is left."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models, near-duplicate components and BPE ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
