"""An alert log as a table that a stream appends to, batch by batch, each once.

The log is a folder with a folder for each batch. A batch is numbered after, and looked at against, the batches before it
alone and replaces its own folder, so one that is run again after a failure changes nothing. compacted()
puts all batches up to one into a base folder; a base counts once it is wholly written, and from then on the
folders it stands for don't, so a failure in between loses and doubles nothing either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.operators import correction
from skygauge.plans.scratch import stored


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders of a log."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def _parts(spark: SparkSession, path: str, before: int | None) -> tuple[int, list[str]]:
    """The last batch of the newest base (-1: none), and the folders that make up the log, or what of it comes before a batch."""
    names = _folders(spark, path)
    numbers = lambda kind: sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))
    bases = [n for n in numbers("base") if before is None or n < before]
    base = bases[-1] if bases else -1
    return base, [f"base-{base}"] * bool(bases) + [f"batch-{n}" for n in numbers("batch") if n > base and (before is None or n < before)]


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The log, or what of it comes before a batch; None if there is nothing."""
    parts = _parts(spark, path, before)[1]
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/{p}") for p in parts)) if parts else None


def append_alerts(path: str, hours: int = 72) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of alerts (station_id, row_id, ts, anomaly_type, sensors and any other columns) goes into the log with alert_seq,
    alert_id, earlier and historical_context. Batches come in order of time. Only the log's last `hours` before the batch are looked at; numbers go on from all of it.

    A batch without alerts leaves no folder. Alerts without a time count as a station's first of their batch and have none before them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, found = batch.sparkSession, stored(batch)
        if found.isEmpty():
            return
        log = read_log(spark, path, number)
        numbered = stored(correction.number_alerts(found, log))
        since = found.agg(F.min("ts")).first()[0]
        recent = None if log is None or since is None else log.where(F.col("ts") >= F.lit(since) - F.expr(f"INTERVAL {hours} HOURS"))
        correction.recurrence(numbered, hours, recent).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return run


def compacted(spark: SparkSession, path: str, upto: int) -> None:
    """Put the batches up to a number into one base, and drop the folders it stands for. Not to be run while one of these batches may still be run again."""
    base, parts = _parts(spark, path, upto + 1)
    if not parts or parts == [f"base-{upto}"]:
        return
    last = max([base, *(int(p.partition("-")[2]) for p in parts)])
    reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/{p}") for p in parts)).write.mode("overwrite").parquet(f"{path}/base-{last}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in parts:
        if p != f"base-{last}":
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{p}"), True)
