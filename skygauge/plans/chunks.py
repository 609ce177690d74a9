"""Row windows over stations of any length.

partitionBy(station) would put a station's whole history into one task. Here rows get their
number within the station from counts by day, and windows run over chunks of consecutive
rows that each bring `halo` rows of their neighbours along. A frame that reaches no further
than the halo gives the same result as over the whole history. What has to be carried
further (the last valid value before a gap, running sums) goes by one summary row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skygauge.plans.scratch import stored

CHUNK_ROWS = 8192
#: Chunks that a task has on average, at most.
TASK_CHUNKS = 16
DAY = 86_400_000_000


def numbered(df: DataFrame, station: str = "station_id", order: tuple[str, ...] = ("ts", "row_id"), name: str = "rn", total: str | None = None) -> DataFrame:
    """df with the row's number in its station, from 1, in the given order; the first column of which is a timestamp. total: a column for how many rows the station has.

    A df that has the columns already is taken as numbered. Counts by day are stored, so that Spark knows how small they are when it
    plans their join; else it may shuffle the rows by station for it.
    """
    if name in df.columns and (total is None or total in df.columns):
        return df
    df = df.drop(name)
    day = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / DAY)
    rows = df.withColumn("_day", day).withColumn("_at", F.row_number().over(Window.partitionBy(station, "_day").orderBy(*order)))
    counts = df.groupBy(F.col(station).alias("_s"), day.alias("_d")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *([] if total is None else [F.sum("_n").over(Window.partitionBy("_s")).alias(total)]))
    offsets = stored(offsets.coalesce(1))
    joined = rows.join(offsets, F.col(station).eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")))
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_day", "_at", "_s", "_d", "_before")


def chunked(df: DataFrame, halo: int, rows: int = CHUNK_ROWS, rn: str = "rn") -> DataFrame:
    """Rows by chunk, with copies of those within halo of an edge; `core` tells the rows from the copies."""
    if halo > rows:
        raise ValueError("a chunk must be as long as its halo")
    own = F.floor((F.col(rn) - 1) / rows).cast("long")
    at = F.pmod(F.col(rn) - 1, F.lit(rows))
    near = F.filter(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= rows - halo, own + 1)), lambda x: x.isNotNull())
    return df.withColumn("_own", own).withColumn("chunk", F.explode(near)).withColumn("core", F.col("chunk") == F.col("_own")).drop("_own")


def cores(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core")


def by_row(rn: str = "rn", station: str = "station_id") -> WindowSpec:
    return Window.partitionBy(station, "chunk").orderBy(rn)


def spread(df: DataFrame, n: int, station: str = "station_id") -> DataFrame:
    """df, of n chunks, in partitions by chunk that windows over chunks need no other shuffle for. Spark's own would be as large as their
    compressed size allows, and rows of flags are many times as large when they are sorted."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_CHUNKS)), station, "chunk")


def with_neighbours(df: DataFrame, columns: dict[str, Column], station: str = "station_id", rn: str = "rn") -> DataFrame:
    """For each name the nearest non-null values, however far, as structs (rn, x): {name}_prev at or before
    the row, {name}_prior before it, {name}_next at or after it. df is by chunk, without copies."""
    marked = df.withColumns({f"_{k}": F.when(v.isNotNull(), F.struct(F.col(rn).alias("rn"), v.alias("x"))) for k, v in columns.items()})
    ends = marked.groupBy(F.col(station).alias("_s"), F.col("chunk").alias("_c")).agg(
        *(F.max(f"_{k}").alias(f"_{k}_last") for k in columns), *(F.min(f"_{k}").alias(f"_{k}_first") for k in columns))
    # Looking ahead is looking back in the reverse order: frames that only grow take linear time, those that shrink don't.
    earlier = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_s").orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(ends.select("_s", "_c", *(F.last(f"_{k}_last", True).over(earlier).alias(f"_{k}_before") for k in columns), *(F.last(f"_{k}_first", True).over(later).alias(f"_{k}_after") for k in columns)))
    joined = spread(marked, carried.count(), station).join(carried, F.col(station).eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")), "left")
    w = by_row(rn, station)
    ahead = Window.partitionBy(station, "chunk").orderBy(F.col(rn).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for k in columns:
        for name, end in (("prev", 0), ("prior", -1)):
            out[f"{k}_{name}"] = F.coalesce(F.last(f"_{k}", True).over(w.rowsBetween(Window.unboundedPreceding, end)), F.col(f"_{k}_before"))
        out[f"{k}_next"] = F.coalesce(F.last(f"_{k}", True).over(ahead), F.col(f"_{k}_after"))
    return joined.withColumns(out).drop("_s", "_c", *(f"_{k}{x}" for k in columns for x in ("", "_before", "_after")))


def running_sums(df: DataFrame, values: dict[str, Column], station: str = "station_id", rn: str = "rn") -> DataFrame:
    """df with the sum of each value over all rows up to each. df is by chunk, without copies."""
    valued = df.withColumns({f"_{k}": v for k, v in values.items()})
    totals = valued.groupBy(F.col(station).alias("_s"), F.col("chunk").alias("_c")).agg(*(F.sum(f"_{k}").alias(f"_{k}_t") for k in values))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_s", "_c", *(F.sum(f"_{k}_t").over(before).alias(f"_{k}_b") for k in values))
    joined = valued.join(earlier, F.col(station).eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")), "left")
    here = by_row(rn, station).rowsBetween(Window.unboundedPreceding, 0)
    sums = {k: F.coalesce(F.sum(f"_{k}").over(here), F.lit(0)) + F.coalesce(f"_{k}_b", F.lit(0)) for k in values}
    return joined.withColumns(sums).drop("_s", "_c", *(f"_{k}{x}" for k in values for x in ("", "_b")))


def in_chunks(df: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """df with rn and chunk, without copies."""
    return numbered(df).withColumn("chunk", F.floor((F.col("rn") - 1) / rows).cast("long"))
