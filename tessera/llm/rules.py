"""Quality rules with thresholds from the corpus: native DataFrame expressions, no Python on the rows.

Counts of every document are computed once and stored.  Mergeable quantile sketches (percentile_approx, combined
from partial sketches of every task) of each measure per language and source give the thresholds: the upper quartile
plus `reach` interquartile ranges plus a slack, and the same downward for word length.  The slack of the rates of
repetition, whose quartiles are zero in most groups, is the way from the upper quartile to the 95th percentile within
the bounds in MEASURES, so junk beyond that percentile can't lift its own fence far.  Groups with fewer than `least`
documents use the thresholds of their language, then those of the whole corpus.  The thresholds, a row a group, are
joined to the counts and decide.

Null texts have no words, so they fail the base rules.  Null languages and sources form groups of their own.  Very long
texts are counted whole; repeated rows count as rows of their own; values at a fence are inside it; an empty table gives
no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import durable

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
#: Measures that the sketches are made of, with the least and most slack that is added to their fences.
MEASURES = {"symbol_rate": (0.1, 0.1), "dup_line_rate": (0.1, 0.3), "repeat_rate": (0.1, 0.3), "word_length": (1.5, 1.5)}
FLOOR = {"word_length": 1.5}
FEW_GROUPS = 100_000  # of language and source, whose limits are broadcast: some MB
SALTS = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def windows(hashes: str) -> Column:
    """A 64-bit hash of every 3-word window, from the column with a hash of every word."""
    h = F.col(hashes)
    return F.when(
        F.size(h) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        ),
    )


def covered(indexed: str) -> Column:
    """Distinct words under windows that occur more than once, from a column of sorted (h, i) of all windows."""
    x = F.col(indexed)
    same = F.filter(
        F.zip_with(
            F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        ),
        lambda pair: pair.isNotNull(),
    )
    at = F.flatten(same)
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of `keep` and the six counts of every whole text.

    Arrays that a later expression reads at several places are columns of their own, so each is made once a row.
    Windows are compared by 64-bit hashes; only texts in which some window repeats are sorted.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    got = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", *keep, words(F.col("text")).alias("w"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    got = got.select(
        "doc_id", *keep, "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    names = ["doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    got = got.select(*names, windows("hashes").alias("windows"))
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    indexed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    got = got.select(*names, F.when(again, indexed).alias("indexed"))
    return got.select(
        *names, F.when(F.col("indexed").isNotNull(), covered("indexed")).otherwise(0).cast("long").alias("n_repeat_words")
    )


def measures(counted: DataFrame) -> DataFrame:
    per = lambda c, n: F.col(c) / F.greatest(n, F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_rate": per("n_symbols", "n_words"),
            "dup_line_rate": per("n_dup_lines", "n_lines"),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "word_length": per("word_chars", "n_words"),
        }
    )


def fences(measured: DataFrame, reach: float = 3.0, least: int = 50, accuracy: int = 10_000) -> DataFrame:
    """One row a language and source: the upper (and lower) limit of each measure."""
    sketch = [F.percentile_approx(m, [0.25, 0.75, 0.95], accuracy).alias(m) for m in MEASURES]
    levels = (
        measured.where(~F.col("base_failed")).withColumn("one", F.lit(1))
        .rollup("one", "lang_key", "source_key").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketch)
    )

    def at(level: int, keys: list[str]) -> DataFrame:
        found = levels.where((F.col("level") == level) & (F.col("n") >= (least if keys else 0)))
        return found.select(*keys, F.struct(*MEASURES).alias(f"q{level}"))

    groups = measured.select("lang_key", "source_key").distinct()
    best = (
        groups.join(at(0, ["lang_key", "source_key"]), ["lang_key", "source_key"], "left")
        .join(at(1, ["lang_key"]), "lang_key", "left")
        .join(at(3, []), F.lit(True), "left")
        .withColumn("q", F.coalesce("q0", "q1", "q3"))
    )
    limits = []
    for m, (small, large) in MEASURES.items():
        low, high, tail = (F.col("q")[m][i] for i in range(3))
        slack = F.least(F.greatest(tail - high, F.lit(small)), F.lit(large))
        limits.append((high + reach * (high - low) + slack).alias(f"{m}_most"))
        if m in FLOOR:
            limits.append((low - reach * (high - low) - slack).alias(f"{m}_least"))
    return best.select("lang_key", "source_key", *limits)


def keyed(df: DataFrame) -> DataFrame:
    """Language and source as keys that are never null and tell null from every text."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return df.withColumns({"lang_key": key("lang"), "source_key": key("source")})


def with_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Joins the limits, a row a group: broadcast where they are few, else dealt SALTS times so that a hot group is split."""
    keys = ["lang_key", "source_key"]
    if limits.count() <= FEW_GROUPS:
        return measured.join(F.broadcast(limits), keys, "left")
    salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    return measured.withColumn("_salt", salt).join(salted, [*keys, "_salt"], "left")


def judge(docs: DataFrame, reach: float = 3.0) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = durable(counts(docs, "lang", "source"), "rule_counts")
    measured = measures(keyed(counted))
    limits = fences(measured, reach)
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_most"), F.lit(True))
    for m in FLOOR:
        inside &= F.coalesce(F.col(m) >= F.col(f"{m}_least"), F.lit(True))
    return with_limits(measured, durable(limits, "rule_limits")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
    )
