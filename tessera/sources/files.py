"""CSV and JSON files of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.schemas import require

CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column a string; with `columns` their order is checked against the header."""
    reader = spark.read.options(**CSV)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode(mode).options(header=True, escape='"').csv(path)


def append_csv(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet, the first of each; refuses files with other columns."""
    spark = df.sparkSession
    there = spark.read.options(**CSV).csv(path)
    if there.columns != df.columns:
        raise ValueError(f"columns differ from those of {path}")
    rest = [c for c in df.columns if c != key]
    placed = df.withColumn("_n", F.monotonically_increasing_id()).groupBy(key).agg(F.min_by(F.struct(*rest), "_n").alias("_row"))
    first = placed.select(key, "_row.*") if rest else placed.select(key)
    write_csv(first.join(there.select(key), key, "left_anti").select(*df.columns), path, "append")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a seed file (a JSON array) in the order of the file, which is their priority."""
    schema = "name string, display_name string, identification_patterns array<struct<patterns:array<string>>>, phone_numbers array<string>"
    got = spark.read.schema(schema).json(path, multiLine=True)
    # a seed file is read by one task, so this numbers its rows in order
    return require(got, ["name"]).select(
        F.sha2("name", 256).alias("id"), "name", "display_name", F.lit("regex").alias("pattern_type"), "identification_patterns", "phone_numbers",
        F.lit(True).alias("is_active"), F.monotonically_increasing_id().cast("int").alias("priority"),
    )


def pattern_counts(companies: DataFrame) -> DataFrame:
    n = F.aggregate("identification_patterns", F.lit(0), lambda a, g: a + F.size(g["patterns"]))
    return companies.select("name", F.coalesce(n, F.lit(0)).alias("n_patterns"))


def exploded_messages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(conversation_id, message_id, body, direction, sent_at) of raw conversations: JSON objects with an array `messages`, one a file or (lines) a line."""
    schema = "conversation_id string, messages array<struct<id:string,text:string,direction:string,createdAt:string>>"
    got = spark.read.schema(schema).json(path, multiLine=not lines)
    return got.select("conversation_id", F.explode("messages").alias("m")).select("conversation_id", F.col("m.id").alias("message_id"), F.col("m.text").alias("body"), F.col("m.direction").alias("direction"), F.col("m.createdAt").alias("sent_at"))
