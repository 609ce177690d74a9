"""What the corpus operators share: text encoding, exact ids and batch limits."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.plans.scratch import discard
from skygauge.plans.scratch import stored as materialize

__all__ = ["TEXT_ROWS", "WORD", "discard", "exact_id", "give_back", "materialize", "parts_and_tasks", "schema", "table", "text_batches", "utf8", "word_count"]

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that carries texts; keeps a Python worker's memory small.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches, unless the session asks for fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def parts_and_tasks(docs: DataFrame, text_col: str, part_bytes: int, task_bytes: int) -> tuple[int, int]:
    """How many groups and how many tasks the bytes of all texts ask for, so that neither grows with the table; tasks are no fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(1, -(-size // part_bytes)), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


def exact_id(id_col: str) -> list[Column]:
    """An integer id as two columns without nulls, id and no_id: pandas would round large ids beside a null."""
    known = F.col(id_col).cast("long")
    return [F.coalesce(known, F.lit(0)).alias("id"), known.isNull().alias("no_id")]


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text, empty for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def schema(columns: str) -> T.StructType:
    """The type of "name type, name type[]"; unlike a parsed string it needs no session, as on workers."""
    fields = []
    for name, kind in (x.split() for x in columns.split(", ")):
        fields.append(T.StructField(name, T.ArrayType(_TYPES[kind[:-2]]) if kind.endswith("[]") else _TYPES[kind]))
    return T.StructType(fields)


def give_back() -> None:
    """At a Python task's end: return freed memory to the system, as idle workers stay for later tasks."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc keeps what it keeps
        pass
