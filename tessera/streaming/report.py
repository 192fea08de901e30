"""The status report kept up to date by changes: a change takes a job out of its old cell and puts it into its new one.

Cells are sums per company, day of arrival, day of appointment and bucket, far fewer than jobs; a report adds up the
cells of its days.  Changes are whole job rows with the time of the change.  Each batch looks up the rows that it
replaces, adds the differences to the cells that it touches, and commits these before the rows; both stores know the
number of their last batch, so a batch that dies in between is finished by its replay and none counts twice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import business_day
from tessera.operators.upsert import in_batch
from tessera.plans.reports import BUCKETS, bucket, named, other_day
from tessera.streaming.store import RunStore

JOBS = "id string, company_id string, first_message_at timestamp, appt_at timestamp, lifecycle_status string, changed_at timestamp"
CELL = ["company_id", "arrived", "appointed", "bucket"]


def cells(jobs: DataFrame, sign: int) -> DataFrame:
    """CELL and n of jobs of a company; without an appointment on another day `appointed` is the day of arrival."""
    arrived = business_day(F.col("first_message_at"))
    appointed = F.when(other_day(), business_day(F.col("appt_at"))).otherwise(arrived)
    rows = jobs.where("company_id is not null and first_message_at is not null").select("company_id", arrived.alias("arrived"), appointed.alias("appointed"), bucket().alias("bucket"))
    return rows.groupBy(*CELL).agg((sign * F.count(F.lit(1))).alias("n"))


class ReportStore:
    """Job rows and the cells of the report under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.jobs = RunStore(spark, f"{path}/jobs", JOBS, ["id"], "changed_at")
        self.sums = RunStore(spark, f"{path}/cells", "company_id string, arrived date, appointed date, bucket string, n long, at timestamp", CELL, "at")

    def apply(self, changes: DataFrame, number: int) -> None:
        """Changes of jobs; an older one than the store holds counts for nothing, of equally new ones the later batch's does."""
        if number > self.sums.version():
            rows = self.jobs.columns(changes)
            new = in_batch(rows.withColumn("_position", F.monotonically_increasing_id()), ["id"], "changed_at", "_position").drop("_position")
            old = self.jobs.look_up(new)
            newer = new.join(old.select("id", F.col("changed_at").alias("_was")), "id", "left").where("_was is null or changed_at >= _was").drop("_was")
            gone = old.join(newer.select("id"), "id", "left_semi")
            delta = cells(newer, 1).unionByName(cells(gone, -1)).groupBy(*CELL).agg(F.sum("n").alias("delta")).where("delta <> 0")
            total = delta.join(self.sums.look_up(delta).select(*CELL, "n"), CELL, "left")
            # the time of a sum is the number of its batch, so the latest one counts
            self.sums.apply(total.select(*CELL, (F.coalesce("n", F.lit(0)) + F.col("delta")).alias("n"), F.timestamp_seconds(F.lit(number)).alias("at")), number)
        self.jobs.apply(changes, number)

    def report(self, companies: DataFrame, first: date | str, last: date | str, appointments: bool = False) -> DataFrame:
        """What `reports.status_report` gives for all jobs so far and the business days from first to last."""
        inside = lambda c: F.col(c).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        rows = self.sums.read().where(inside("arrived") | inside("appointed") if appointments else inside("arrived"))
        counted = rows.groupBy("company_id").agg(*[F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b) for b in BUCKETS], F.sum("n").alias("total"))
        return named(counted.where("total > 0"), companies.withColumn("id", F.col("id").cast("string")))
