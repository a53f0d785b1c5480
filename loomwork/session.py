"""Session settings that all queries assume, and a report of what ran when a session is stopped."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, app: str = "loomwork") -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. On a cluster leave ``master`` and ``partitions`` to its own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


@dataclass(frozen=True)
class StopReport:
    """Whether running jobs were cancelled, and how many stages the session had active."""

    cancelled: bool
    active_stages: int


def stop(spark: SparkSession, tag: str | None = None) -> StopReport:
    """Cancel the jobs under ``tag`` (all without one), then stop the session."""
    active = len(spark.sparkContext.statusTracker().getActiveStageIds())
    if tag:
        spark.interruptTag(tag)
    else:
        spark.sparkContext.cancelAllJobs()
    spark.stop()
    return StopReport(active > 0, active)


def info(spark: SparkSession) -> dict[str, str]:
    """What an inspector asks for: version, master, parallelism and the settings that shape plans."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")
    return {"version": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism), **{n: spark.conf.get(n) for n in names}}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, set as checkpoint folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
