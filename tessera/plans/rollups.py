"""Daily rollups per job, technician and company, their storage and export.

Each rollup is one or two aggregations over the day's rows; storage overwrites the day's partitions, so a rerun gives
the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.values import minutes_between, parse_money
from tessera.operators.joins import next_within

WEEK = 7 * 24 * 3600


def _between(ts: str, start: Column, end: Column) -> Column:
    return (F.col(ts) >= start) & (F.col(ts) < end)


def per_job(events: DataFrame, jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row a job with events in the day: their sequence, first and last times, minutes to dispatch and completion.

    Times count from the day's first event.  Of closing values and appointments the last non-empty one holds.
    """
    text = lambda k: F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    order = F.struct("created_at", "id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    rows = events.where(_between("created_at", start, end)).withColumns(
        {
            "_appt": F.when(F.col("to_status") == "appt_set", text("appt_iso")), "_total": F.when(F.col("source") == "closing_chat", text("closed_total")),
            "_method": F.when(F.col("source") == "closing_chat", text("closed_payment_method")),
        }
    )
    first_at = lambda s: F.min(F.when(F.col("to_status") == s, F.col("created_at")))
    step = F.struct("created_at", "id", F.col("from_status").alias("from"), F.col("to_status").alias("to"), "source")
    got = rows.groupBy("job_id").agg(
        F.sort_array(F.collect_list(step)).alias("_steps"), F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"),
        first_at("dispatched").alias("_dispatched"), first_at("completed").alias("_completed"),
        F.min_by(text("technician_id"), F.when(F.col("to_status") == "dispatched", order)).alias("technician_id"),
        last("_appt").alias("appt_iso"), last("_total").alias("closed_total"), last("_method").alias("closed_payment_method"),
    )
    got = got.join(jobs.select(F.col("id").alias("job_id"), "company_id"), "job_id")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return got.select(
        "job_id", "company_id", "technician_id",
        F.transform("_steps", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), at(s["created_at"]).alias("at"), s["source"].alias("source"))).alias("from_to_sequence"),
        "first_event_at", "last_event_at", minutes_between(F.col("_dispatched"), F.col("first_event_at")).alias("time_to_dispatch_min"),
        minutes_between(F.col("_completed"), F.col("first_event_at")).alias("time_to_complete_min"), "appt_iso", "closed_total", "closed_payment_method",
    )


def per_tech(events: DataFrame, start: Column, end: Column, dispatch_sources: tuple[str, ...] = ("operator_whatsapp",)) -> DataFrame:
    """A row a technician: dispatches of the day, how many ended, mean minutes to the first reply and to the end.

    Replies are the next event of another source in the chat within a week, whatever its job; ends are the next
    completed, closed or canceled event of the job.  Both are walks over buckets of time, so a busy chat is cut.
    """
    text = lambda k: F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    sent = F.col("source").isin(list(dispatch_sources))
    rows = events.select("job_id", "created_at", "to_status", "source", text("technician_id").alias("technician_id"), text("chat_jid").alias("chat_jid"))
    rows = rows.where(F.col("created_at") >= start)  # all that can answer a dispatch of the day comes later
    ends = F.col("to_status").isin("completed", "closed", "canceled")
    is_dispatch = sent & F.col("technician_id").isNotNull() & _between("created_at", start, end)
    # rows that are neither a dispatch nor an end needn't reach the first walk
    finished = next_within(rows.where(is_dispatch | ends), ["job_id"], "created_at", ends, None, "_end").where(is_dispatch)
    finished = finished.select("technician_id", "chat_jid", "created_at", "_end", F.lit(True).alias("_mine"))
    replies = rows.where(~F.coalesce(sent, F.lit(False)) & F.col("chat_jid").isNotNull() & (F.col("created_at") < end + F.make_dt_interval(secs=F.lit(WEEK)))).select(
        F.lit(None).cast("string").alias("technician_id"), "chat_jid", "created_at", F.lit(None).cast("timestamp").alias("_end"), F.lit(False).alias("_mine")
    )
    whole = next_within(finished.unionByName(replies), ["chat_jid"], "created_at", ~F.col("_mine"), WEEK, "_reply").where("_mine")
    return whole.groupBy("technician_id").agg(
        F.count(F.lit(1)).alias("jobs_dispatched"), F.count("_end").alias("jobs_completed"),
        F.avg(minutes_between(F.col("_reply"), F.col("created_at"))).alias("avg_response_min"),
        F.avg(minutes_between(F.col("_end"), F.col("created_at"))).alias("avg_completion_min"),
    )


def per_company(jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row a company with jobs that arrived or closed in the day; both kinds count as received."""
    closed = F.coalesce(_between("closed_at", start, end), F.lit(False))
    rows = jobs.where(F.col("company_id").isNotNull() & (_between("first_message_at", start, end) | closed))
    return rows.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("jobs_received"), F.count_if(closed).alias("jobs_completed"),
        F.avg(F.when(closed, minutes_between(F.col("closed_at"), F.col("first_message_at")))).alias("avg_total_min"),
        F.sum(F.when(closed, parse_money(F.col("closed_total"))).otherwise(0.0)).alias("total_revenue"),
    )


def snapshot(day, events: DataFrame, jobs: DataFrame, scopes: tuple[str, ...] = ("per_job", "per_tech", "per_company")) -> DataFrame:
    """snapshot_date, scope, scope_id and payload (JSON) of the rollups of one business day."""
    from functools import reduce

    from tessera.functions.values import business_range

    start, end = business_range(day, day)
    made = {
        "per_job": lambda: (per_job(events, jobs, start, end), "job_id"), "per_tech": lambda: (per_tech(events, start, end), "technician_id"),
        "per_company": lambda: (per_company(jobs, start, end), "company_id"),
    }
    parts = []
    for scope in scopes:
        df, key = made[scope]()
        payload = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        parts.append(df.select(F.lit(str(day)).cast("date").alias("snapshot_date"), F.lit(scope).alias("scope"), F.col(key).cast("string").alias("scope_id"), payload.alias("payload")))
    return reduce(DataFrame.unionByName, parts)


def store(snapshots: DataFrame, path: str) -> None:
    """Overwrites the partitions of the days and scopes that the snapshots hold, and no others."""
    snapshots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date", "scope").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots; a folder without any gives no rows."""
    from tessera.schemas import TABLES

    return spark.read.schema(TABLES["daily_stats_snapshots"]).parquet(path)


def listed(snapshots: DataFrame, first, last, scope: str | None = None) -> DataFrame:
    out = snapshots.where(F.col("snapshot_date").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    out = out if scope is None else out.where(F.col("scope") == scope)
    return out.orderBy(F.desc("snapshot_date"), "scope", "scope_id")


def export(snapshots: DataFrame, path: str, form: str = "csv") -> None:
    if form == "csv":
        snapshots.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        snapshots.write.mode("overwrite").json(path)
    else:
        raise ValueError("csv or json")
