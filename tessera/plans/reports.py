"""The company status report: outcome buckets of jobs per company over a range of business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import business_day

BUCKETS = ["closed_completed", "still_open", "scheduled_another_day", "canceled", "rejected"]


def other_day() -> Column:
    return F.col("appt_at").isNotNull() & (business_day(F.col("appt_at")) != business_day(F.col("first_message_at")))


def bucket() -> Column:
    status = F.col("lifecycle_status")
    return (
        F.when(status == "rejected", "rejected").when(status.isin("closed", "completed"), "closed_completed")
        .when((status == "appt_set") & other_day(), "scheduled_another_day").when(status == "canceled", "canceled").otherwise("still_open")
    )


def in_range(start: Column, end: Column, appointments: bool = False) -> Column:
    """Arrived in [start, end); with `appointments` also jobs whose appointment on another day is in it."""
    arrived = (F.col("first_message_at") >= start) & (F.col("first_message_at") < end)
    if not appointments:
        return arrived
    return arrived | ((F.col("appt_at") >= start) & (F.col("appt_at") < end) & other_day())


def status_report(jobs: DataFrame, companies: DataFrame, start: Column, end: Column, appointments: bool = False) -> DataFrame:
    """A row a company: a count of each bucket, the total and the name; the busiest first.

    One aggregation over the jobs; the names join its few rows afterwards.
    """
    rows = jobs.where(F.col("company_id").isNotNull() & in_range(start, end, appointments)).select("company_id", bucket().alias("bucket"))
    counted = rows.groupBy("company_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.count(F.lit(1)).alias("total"))
    return named(counted, companies)


def named(counted: DataFrame, companies: DataFrame) -> DataFrame:
    """Counts of companies with their names, the busiest first."""
    names = companies.select(F.col("id").alias("company_id"), F.coalesce("display_name", "name").alias("company_name"))
    known = counted.join(names, "company_id", "left").withColumn("company_name", F.coalesce("company_name", F.lit("Unknown")))
    return known.select("company_id", "company_name", *BUCKETS, "total").orderBy(F.desc("total"), "company_id")


def grand_total(report: DataFrame) -> DataFrame:
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*BUCKETS, "total"]])


def status_jobs(
    jobs: DataFrame, origins: DataFrame, companies: DataFrame, start: Column, end: Column, company_id=None, wanted: str | None = None,
    appointments: bool = False, limit: int = 500,
) -> DataFrame:
    """The jobs behind a cell, in order of arrival, with their first message; origins: job_id, content, from_number, created_at."""
    rows = jobs.where(F.col("company_id").isNotNull() & in_range(start, end, appointments)).withColumn("bucket", bucket())
    if company_id is not None:
        rows = rows.where(F.col("company_id") == company_id)
    if wanted is not None:
        rows = rows.where(F.col("bucket") == wanted)
    arrived = (F.col("first_message_at") >= start) & (F.col("first_message_at") < end)
    top = rows.withColumn("matched_by", F.when(arrived, "arrival").otherwise("appointment")).orderBy("first_message_at", "id").limit(limit)
    return summaries(top, origins, companies).orderBy("first_message_at", "id")


def summaries(jobs: DataFrame, origins: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with company name, address line and a preview of their earliest message."""
    # few jobs are asked for, so only their messages are aggregated
    asked = origins.join(jobs.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_semi")
    first = asked.groupBy(F.col("job_id").alias("id")).agg(F.min_by(F.struct("content", "from_number"), "created_at").alias("_m"))
    names = companies.select(F.col("id").alias("company_id"), F.coalesce("display_name", "name").alias("company_name"))
    out = jobs.join(names, "company_id", "left").join(first, "id", "left")
    address = F.nullif(F.concat_ws(" ", "address_street_number", "address_street_name", "address_city", "address_state", "address_zip"), F.lit(""))
    return out.select(
        *jobs.columns, "company_name", address.alias("address"), F.substring("_m.content", 1, 200).alias("message_preview"),
        F.coalesce("customer_phone_e164", "_m.from_number").alias("contact"),
    )
