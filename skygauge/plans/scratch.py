"""Tables that a plan reads more than once, written between in the folder all executors share.

Tables go to a subfolder of that folder of their own for each run of the driver, which is
removed when the driver's process ends, or at once by release(). What is stored inside a temporary() block goes at its end:
a long session that writes its results inside such blocks holds nothing in between.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_RUN = f"skygauge-{uuid.uuid4().hex}"
_used: dict[str, SparkSession] = {}
#: Tables stored by the temporary() blocks that are open, the innermost last.
_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """A folder of this run in spark.checkpoint.dir. Where that is unset, a temporary folder on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(found or os.path.join(tempfile.gettempdir(), 'skygauge-scratch')).rstrip('/')}/{_RUN}"
    if not _used:
        atexit.register(release)
    _used[path] = spark
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration() if spark._jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (OSError, Py4JError, AttributeError, TypeError):  # the JVM has ended already: nothing can reach the folder from here
        pass


def release() -> None:
    """Remove all tables that this run has stored; frames that read them can't be used afterwards."""
    while _used:
        path, spark = _used.popitem()
        _remove(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was stored inside; frames made inside are written there too, as they can't be used afterwards."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """df, computed once: what reads it later doesn't repeat the work below, and a lost executor costs a file read. rows_a_file: at most so many."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.options(compression="zstd", maxRecordsPerFile=rows_a_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables as stored() gave them, once all that reads them has been stored itself."""
    for table in tables:
        _remove(table.sparkSession, table._stored_at)
