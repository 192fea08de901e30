"""Queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, jaccard, language, licenses, packing, pii, quality, rules, shards, sql, topk, toxicity, variants
from tessera.llm.shared import crc_mod, documents, shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs, crc_mod("doc_id", 4) != 2)
    return language.identify(docs, model, "doc_id").withColumn("held_out", crc_mod("doc_id", 4) == 2)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.digest(licenses.scan(docs, licenses.train(docs), "doc_id"), "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), TOKENIZER)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    index = shards.materialise(documents(spark, sf_dir), TOKENIZER, out)
    return shards.verified(spark, index, out)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(documents(spark, sf_dir), words=4, percent=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, crc_mod("doc_id", 5) != 0)
    found = quality.classify(docs, model, F.col("source"), F.col("lang"), "doc_id")
    return found.withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 5) != 0)
    return toxicity.score_documents(docs, model, "doc_id").withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(documents(spark, sf_dir), "doc_id"), "doc_id")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language, op2_licenses, op3_bpe, op4_shards, op5_jaccard, op6_quality, op7_rules, op8_packing, op9_toxicity, op10_topk,
        op11_pii, op12_variants, op13_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_rules": sql.rules_sql(), "op10_topk": sql.TOPK_SQL, "op12_variants": sql.VARIANTS_SQL, "op13_collocations": sql.COLLOCATIONS_SQL}
