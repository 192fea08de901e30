"""Classification of messages into companies' jobs, and resolution of messages into jobs.

Preview: phone, then patterns, then bindings decide the company; a message that isn't a job (no phone or no address)
has none, whatever its sender.  Resolution: a message joins the oldest job within the window that equals it in address
or phone, be it an earlier job or one that an earlier message of the same batch opened.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.contact import is_job_message, normalize_phone, without_chat_marks
from tessera.functions.text import blank
from tessera.operators.components import components
from tessera.operators.joins import first_company_by_pattern, oldest_since
from tessera.operators.messages import companies_by_phone
from tessera.plans.store import shared_folder

DAY = 24 * 3600 * 1_000_000


def preview(messages: DataFrame, companies: DataFrame, bindings: DataFrame) -> DataFrame:
    """id, gate_passed, is_job_likely, matched_company_id, matched_company, match_method and binding_conflict, a row a message.

    Of several bindings of one phone that of the smallest company_id counts.
    """
    own = messages.select("id", "source", "from_number", blank(F.col("content")).alias("empty"), without_chat_marks(F.col("content")).alias("t"))
    own = own.withColumn("gate_passed", ~F.col("empty") & is_job_message(F.col("t")))
    # the gate comes first, so only jobs meet the patterns
    gated = own.where("gate_passed")
    by_phone = companies_by_phone(gated, companies, "id", "from_number").select("id", F.struct("company_id", "company_name").alias("_phone"))
    by_text = first_company_by_pattern(gated, companies, "id", "t").select("id", F.struct("company_id", "company_name").alias("_text"))
    bound = bindings.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
    bound = bound.select(normalize_phone(F.col("phone_e164")).alias("_key"), F.struct("company_id", "company_name").alias("_bound")).groupBy("_key").agg(F.min("_bound").alias("_bound"))
    key = F.when(F.col("source") == "openphone", normalize_phone(F.col("from_number")))
    got = own.withColumn("_key", key).join(by_phone, "id", "left").join(by_text, "id", "left").join(bound, "_key", "left")
    hit = F.coalesce("_phone", "_text", "_bound")
    method = F.when(F.col("_phone").isNotNull(), "phone").when(F.col("_text").isNotNull(), "regex").when(F.col("_bound").isNotNull(), "phone_binding").otherwise("none")
    clash = F.col("_phone").isNull() & F.col("_text").isNotNull() & (F.col("_bound.company_name") != F.col("_text.company_name"))
    passed = F.col("gate_passed")
    return got.select(
        "id", "gate_passed", (passed & hit.isNotNull()).alias("is_job_likely"), F.when(passed, hit["company_id"]).alias("matched_company_id"),
        F.when(passed, hit["company_name"]).alias("matched_company"), F.when(passed, method).otherwise("not_a_job").alias("match_method"),
        F.when(passed & clash, F.concat(F.lit("regex="), F.col("_text.company_name"), F.lit(" binding="), F.col("_bound.company_name"))).alias("binding_conflict"),
    )


def dedup_candidates(messages: DataFrame, jobs: DataFrame, days: int = 14, same_company: bool = False) -> DataFrame:
    """(id, job_id, cross_company): the oldest job within `days` before each message with its address or its phone."""
    keys = [[("street_number", "address_street_number"), ("street_name", "address_street_name")], [("phone", "customer_phone_e164")]]
    if same_company:
        keys = [[*k, ("company_id", "company_id")] for k in keys]
    at = F.unix_micros("at")
    found = oldest_since(messages, jobs, "id", keys, at - days * DAY, at, F.unix_micros("first_message_at"), ["id", "company_id"], ["id"])
    crossed = F.col("company_id").isNotNull() & F.col("match.company_id").isNotNull() & (F.col("company_id") != F.col("match.company_id"))
    return found.join(messages.select("id", "company_id"), "id").select("id", F.col("match.id").alias("job_id"), crossed.alias("cross_company"))


RESOLVED = "id string, at timestamp, company_id string, street string, phone string, job_id string, outcome string"


def _one_by_one(batches: Iterator[pa.RecordBatch], days: int) -> Iterator[pa.RecordBatch]:
    """Messages in order of time, each met with the jobs opened before it; jobs known before stand among them as `opened`.

    Of each street and each phone only the jobs of the last `days` and the last message are kept.
    """
    jobs: tuple[dict, dict] = ({}, {})  # by street and by phone: (micros, place in the order, id, company, round) of each job
    last: tuple[dict, dict] = ({}, {})  # (micros, round) of the last message
    place, kept = 0, 1 << 16
    for batch in batches:
        made = []
        for t, id_, company, street, phone, opened in zip(*[batch.column(c).to_pylist() for c in ("_t", "id", "company_id", "street", "phone", "opened")], strict=True):
            place, low = place + 1, t - days * DAY
            keys = [(i, k) for i, k in enumerate((street, phone)) if k is not None]
            if not opened:
                first, depth = None, -1
                for i, k in keys:
                    queue = jobs[i].get(k)
                    while queue and queue[0][0] < low:
                        queue.popleft()
                    if queue and (first is None or queue[0] < first):
                        first = queue[0]
                    if k in last[i] and last[i][k][0] >= low:
                        depth = max(depth, last[i][k][1])
                crossed = first is not None and None not in (first[3], company) and first[3] != company
                outcome = "new" if first is None else "duplicate" if crossed else "linked"
                number = depth + 1 if first is None else first[4] + 1
                made.append((first[2] if outcome == "linked" else id_, outcome, number))
                for i, k in keys:
                    last[i][k] = (t, number)
            if opened or outcome != "linked":
                for i, k in keys:
                    jobs[i].setdefault(k, deque()).append((t, place, id_, company, -1 if opened else number))
        if sum(map(len, (*jobs, *last))) > kept:  # what is over goes, whether its street or phone comes again or not
            for i in (0, 1):
                for k in [k for k, queue in jobs[i].items() if not queue or queue[-1][0] < low]:
                    del jobs[i][k]
                for k in [k for k, (at, _) in last[i].items() if at < low]:
                    del last[i][k]
            kept = max(1 << 16, 2 * sum(map(len, (*jobs, *last))))
        if made:
            asked = batch.filter(pc.invert(batch.column("opened")))
            ids, outcomes, numbers = zip(*made, strict=True)
            more = [pa.array(ids, pa.string()), pa.array(outcomes, pa.string()), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[asked.column(c) for c in NAMES], *more], names=[*NAMES, "job_id", "outcome", "round"])


NAMES = ["id", "at", "company_id", "street", "phone"]


def resolve(messages: DataFrame, jobs: DataFrame | None = None, days: int = 14, at_once: int = 5_000_000) -> DataFrame:
    """RESOLVED and round: each message is new, linked or duplicate, as if the messages had come one by one.

    messages and jobs (those known before) have id, at, company_id, street (number and name in one, or null) and phone.
    A message joins the oldest job of the last `days` that equals it in street or phone; if that is another company's,
    it opens a job of its own as a duplicate.  round is the length of the chain of messages of its slice on which an
    answer rests: 0 without any before it, else one more than that of its job, or for a new job than the last messages of its keys.

    What one message does may decide the next, so time is walked; messages that no chain of streets and phones joins
    have nothing to do with one another.  So messages are cut into slices of time of about `at_once` rows, each slice
    falls into components, components go to tasks, and a task walks its messages in order and holds no more than `days`
    of their jobs.  A slice meets the jobs of those before it.  However long a chain is, the number of Spark jobs follows
    from the number of slices; a busy phone or a large component takes a task for no longer than a slice.
    """
    spark = messages.sparkSession
    base = f"{shared_folder(spark)}/resolved-{uuid.uuid4().hex}"
    kind = lambda c: F.col(c).cast("timestamp" if c == "at" else "string")
    cast = lambda df: df.select(*[F.nullif(kind(c), F.lit("")).alias(c) if c in ("street", "phone") else kind(c).alias(c) for c in NAMES])
    number = F.unix_micros("at")
    cast(messages).withColumn("_t", number).write.parquet(f"{base}/messages")
    rows = spark.read.parquet(f"{base}/messages")
    pieces = -(-rows.count() // at_once)
    cuts = sorted(set(rows.approxQuantile("_t", [i / pieces for i in range(1, pieces)], 0.1 / pieces))) if pieces > 1 else []
    if cuts:
        rows.withColumn("slice", sum((F.when(F.col("_t") > int(c), 1).otherwise(0) for c in cuts), F.lit(0))).write.partitionBy("slice").parquet(f"{base}/slices")
        rows = spark.read.parquet(f"{base}/slices")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = {c: F.concat(F.lit(f"{c}\x1f"), F.col(c)) for c in ("street", "phone")}
    keyed = F.col("_t").isNotNull() & (F.col("street").isNotNull() | F.col("phone").isNotNull())
    known = None if jobs is None else cast(jobs).withColumn("_t", number).where(keyed)
    done = None
    for i in range(len(cuts) + 1):
        own = rows.where(F.col("slice") == i).drop("slice") if cuts else rows
        placed = own.where(keyed)
        label = components(placed.where("street is not null and phone is not null").select(nodes["street"].alias("a"), nodes["phone"].alias("b")), f"{base}/edges-{i}")
        labelled = lambda df, label=label: df.join(label, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
        placed = labelled(placed.withColumn("node", F.coalesce(nodes["street"], nodes["phone"]))).withColumn("opened", F.lit(False))
        for before in [known, None if done is None else done.where("outcome <> 'linked'").select(*NAMES, number.alias("_t")).where(keyed)]:
            if before is not None:
                near = F.lit(True) if not cuts[:i] else F.col("_t") >= int(cuts[i - 1]) - days * DAY
                # a job joins nothing together: it stands with the messages of its street and with those of its phone
                each = before.where(near).select("*", F.explode(F.array_compact(F.array(nodes["street"], nodes["phone"]))).alias("node"))
                placed = placed.unionByName(labelled(each).distinct().withColumn("opened", F.lit(True)))
        walked = placed.repartition(parts, "node").drop("node").sortWithinPartitions("_t", "id").mapInArrow(partial(_one_by_one, days=days), f"{RESOLVED}, round int")
        alone = own.where(~keyed).select(*NAMES, F.col("id").alias("job_id"), F.lit("new").alias("outcome"), F.lit(0).alias("round"))
        walked.unionByName(alone).write.mode("append").parquet(f"{base}/resolved")
        done = spark.read.schema(f"{RESOLVED}, round int").parquet(f"{base}/resolved")
    return done


def rematch_closings(closings: DataFrame, jobs: DataFrame, days: int = 14) -> DataFrame:
    """(id, job_id): the oldest job of the closing's company with its address or phone; unmatched closings are left out."""
    return dedup_candidates(closings, jobs, days, same_company=True).select("id", "job_id")


def extract(messages: DataFrame, extractor, schema: str, id_column: str = "id", text_column: str = "content") -> DataFrame:
    """(id, fields of schema): extractor(list of texts) -> list of dicts, called once a batch of rows.

    The extractor must be picklable and keep its own limits on rates; it stands for whatever model is used.
    """
    from pyspark.sql.types import StructType

    fields = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = extractor(pdf[text_column].fillna("").tolist())
            yield pd.DataFrame({id_column: pdf[id_column], **{f: [(r or {}).get(f) for r in rows] for f in fields}})

    return messages.select(id_column, text_column).mapInPandas(run, f"{id_column} string, {schema}")


def saved(dispatch: DataFrame, extracted: DataFrame, outcomes: DataFrame, fields: list[str]) -> DataFrame:
    """Dispatch jobs with the extracted fields (and extraction_raw, all of them as JSON), the status, company and job of their outcome.

    extracted: id and fields; outcomes: id, status, company_id, job_id, method, error.  Jobs without an outcome stay.
    """
    new = outcomes.join(extracted.select("id", F.struct(*fields).alias("_x")), "id", "left").select(
        "id", "_x", F.struct(F.col("status").alias("classification_status"), F.col("method").alias("classification_method"), F.col("error").alias("classification_error"), "company_id", "job_id").alias("_o")
    )
    got = dispatch.join(new, "id", "left")
    kinds = dict(dispatch.dtypes)
    hit = F.col("_o").isNotNull()
    change = {c: F.when(hit, F.col(f"_o.{c}").cast(kinds[c])).otherwise(F.col(c)) for c in ("classification_status", "classification_method", "classification_error", "company_id", "job_id")}
    change |= {c: F.when(hit, F.col(f"_x.{c}").cast(kinds[c])).otherwise(F.col(c)) for c in fields}
    change["extraction_raw"] = F.when(hit, F.to_json("_x")).otherwise(F.col("extraction_raw"))
    return got.withColumns(change).select(*dispatch.columns)


def reset(dispatch: DataFrame, condition: Column, keep: tuple[str, ...] = ("id", "incoming_message_id", "created_at")) -> DataFrame:
    """Dispatch jobs for which the condition holds as they were before classification: pending, everything else null."""
    hit = F.coalesce(condition, F.lit(False))
    kinds = dict(dispatch.dtypes)
    blank_ = {c: F.when(~hit, F.col(c)).cast(kinds[c]) for c in dispatch.columns if c not in (*keep, "classification_status")}
    return dispatch.withColumns(blank_ | {"classification_status": F.when(hit, "pending").otherwise(F.col("classification_status"))})
