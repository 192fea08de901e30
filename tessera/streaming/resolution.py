"""Messages resolved into jobs as they come: the state is the jobs that messages of the last days have opened.

Every micro-batch meets the jobs that earlier ones opened within `days` before its first message, and its results are
one more run of the store that holds them, so a batch that is replayed adds nothing and a restart goes on where the
last commit stood.  Files of the store keep the smallest and largest time of their rows, so what a batch reads of it is
bounded by `days` of messages.  A message that comes again is left out.  However messages in order of time are cut into batches, the result is that of one batch;
a message that comes after later ones have been settled joins jobs before it, and does not change theirs.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.classify import RESOLVED, resolve
from tessera.streaming.store import RunStore


class Resolution:
    """The store of resolved messages under `path`."""

    def __init__(self, spark: SparkSession, path: str, days: int = 14):
        self.days, self.store = days, RunStore(spark, path, RESOLVED, ["id"], "at")

    def read(self) -> DataFrame:
        return self.store.read()

    def open_jobs(self, since) -> DataFrame:
        """Jobs opened at `since` or later."""
        return self.store.read_where(F.col("at") >= F.lit(since)).where("outcome <> 'linked'").drop("job_id", "outcome")

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.version():
            return
        new = batch.join(self.store.look_up(batch).select("id"), "id", "left_anti").dropDuplicates(["id"])
        first = new.agg(F.min("at")).first()[0]
        known = None if first is None else self.open_jobs(first - timedelta(days=self.days))
        self.store.apply(resolve(new, known, self.days).drop("round"), number)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
