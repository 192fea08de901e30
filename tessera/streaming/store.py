"""An upsert store: every batch appends one run, readers merge runs, runs of like size are merged now and then.

A run is a folder of Parquet files with one row a key (the newest of its batch) and the number of the batch under
`_batch`.  A manifest names the runs of a version, oldest first, and the last batch in them; it is written beside the
others and renamed into place, so a version is there whole or not at all, and a batch that is replayed finds its number
done.  Reading takes, of each key, the row of the newest time, of equal times that of the latest batch: by partial
aggregation, whatever the number of runs.  Once FAN neighbouring runs at the end are of one size class they become one,
so a row is written again about once for every factor FAN by which the table grows, and a batch costs what it holds.

Every row needs a time: one without is an error.  Null keys are equal to one another.  One writer at a time: of two that
write one version, the second fails and can try again.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.perkey import latest
from tessera.operators.upsert import in_batch

FAN = 4
SMALLEST = 1 << 20  # runs below so many bytes are of one class


@dataclass(frozen=True)
class Run:
    folder: str
    bytes: int
    rows: int

    @property
    def level(self) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / SMALLEST, FAN)) + 1) if self.bytes >= SMALLEST else 0


@dataclass(frozen=True)
class Manifest:
    version: int
    batch: int  # the last one in its runs
    runs: tuple[Run, ...]


class RunStore:
    """A table of one row a key under `path`, with the columns of `schema` (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], ts: str = "timestamp"):
        self.spark, self.path, self.schema, self.keys, self.ts = spark, path.rstrip("/"), schema, keys, ts
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._of(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def columns(self, df: DataFrame, *more: Column) -> DataFrame:
        """The store's columns of df, of their types."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema], *more)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one named."""
        known = self.versions()
        if not known and version is None:
            return Manifest(0, -1, ())
        stream = self._fs.open(self._of(f"{self.path}/manifest/{known[-1] if version is None else version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(text)
        return Manifest(x["version"], x["batch"], tuple(Run(**r) for r in x["runs"]))

    def version(self) -> int:
        """The last batch that was committed; -1 if there is none."""
        return self.manifest().batch

    def _written(self, rows: DataFrame) -> Run:
        """Rows, one a key, as a run that no manifest names yet."""
        folder = f"run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{folder}")
        size = self._fs.getContentSummary(self._of(f"{self.path}/{folder}")).getLength()
        return Run(folder, size, self._scan([Run(folder, 0, 0)]).count())

    def _commit(self, now: Manifest) -> None:
        temp, final = (self._of(f"{self.path}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"{now.version}.json"))
        out = self._fs.create(temp, False)
        out.write(json.dumps({"version": now.version, "batch": now.batch, "runs": [asdict(r) for r in now.runs]}).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {now.version} of {self.path} was written by somebody else")

    def _scan(self, runs: list[Run] | tuple[Run, ...]) -> DataFrame:
        schema = f"{self.schema}, _batch long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{r.folder}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """One row a key, as the store stood at a version (the newest by default) that `tidy` has left."""
        return latest(self._scan(self.manifest(version).runs), self.keys, [self.ts, "_batch"]).drop("_batch")

    def read_where(self, condition: Column) -> DataFrame:
        """`read` of rows for which a condition holds, for conditions that all versions of a row share: it reaches the files."""
        return latest(self._scan(self.manifest().runs).where(condition), self.keys, [self.ts, "_batch"]).drop("_batch")

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys are among those of `wanted`; only these meet in the merge."""
        found = self._scan(self.manifest().runs).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")
        return latest(found, self.keys, [self.ts, "_batch"]).drop("_batch")

    def apply(self, batch: DataFrame, number: int, position: str | None = None) -> None:
        """Append a batch; numbers that are not above the last one are done already.

        Of rows of one key and time the first by `position` counts (without one, the first as they come).
        """
        now = self.manifest()
        if number <= now.batch:
            return
        placed = batch if position else batch.withColumn("_position", F.monotonically_increasing_id())
        one = in_batch(placed, self.keys, self.ts, position or "_position")
        timed = F.when(F.col(self.ts).isNull(), F.raise_error(F.lit(f"a row without {self.ts}"))).otherwise(F.lit(number))
        run = self._written(self.columns(one, timed.cast("long").alias("_batch")))
        runs = (*now.runs, run) if run.rows else now.runs
        self._commit(Manifest(now.version + 1, number, runs))
        self._compact()

    def _compact(self) -> None:
        """Merge neighbouring runs at the end while FAN of them are of one size class or below it."""
        while True:
            now = self.manifest()
            for n in range(len(now.runs), FAN - 1, -1):  # the longest end of which no run is much larger than the rest
                end = now.runs[-n:]
                if max(r.level for r in end) <= sorted(r.level for r in end)[-FAN]:
                    break
            else:
                return
            run = self._written(latest(self._scan(end), self.keys, [self.ts, "_batch"]))
            self._commit(Manifest(now.version + 1, now.batch, (*now.runs[:-n], run)))

    def tidy(self, keep: int = 2) -> None:
        """Remove versions but the last `keep`, and folders that none of them names, such as those of batches that failed."""
        known = self.versions()
        used = {r.folder for v in known[-keep:] for r in self.manifest(v).runs}
        for v in known[:-keep]:
            self._fs.delete(self._of(f"{self.path}/manifest/{v}.json"), False)
        for n in self._names(""):
            if n.startswith("run-") and n not in used:
                self._fs.delete(self._of(f"{self.path}/{n}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, position: str | None = None) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n, position)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
