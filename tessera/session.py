"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    name: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """A session in UTC with adaptive execution, ANSI arithmetic and dynamic partition overwrite.

    On a cluster leave master unset and size shuffle_partitions by the largest shuffle (adaptive execution merges small
    partitions, so too many is the safer choice); `extra` overrides anything.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(name).config(map=conf | (extra or {}))
    return (builder.master(master) if master else builder).getOrCreate()
