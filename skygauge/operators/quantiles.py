"""Exact quantiles of many groups and columns at once, in bounded memory.

A sorted group, or a map of its distinct values, grows with the history. Here each wanted rank of each group and
column is a row that says between which two values it lies, and how many values lie before them. While more than CELL
values do, the range is cut into BINS, values are counted by bin, and the rank moves to the bin that holds it,
whose ends are its own least and greatest value. All ranks of all groups move in one pass over the values. What is left, CELL
values for a rank at most or one value many times, is numbered in order. Counts are the only thing that groups share, so
skew does no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygauge.plans.scratch import stored

BINS = 1024
CELL = 1 << 15


def _meet(values: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Values with the ranges of their group and column that they lie in; ranks are few rows a group."""
    named = ranks.withColumnsRenamed({k: f"_{k}" for k in [*by, "name"]})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by), F.col("name") == F.col("_name"))
    return values.join(named, same & F.col("x").between(F.col("low"), F.col("high"))).drop(*(f"_{k}" for k in [*by, "name"]))


def _narrowed(values: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Ranges (low, high, before, held) with the ranks in them, each moved to a bin."""
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width))
    key = [*by, "name", "low", "high"]
    counts = _meet(values, ranges.drop("ranks"), by).groupBy(*key, "before", place.alias("bin")).agg(F.count("*").alias("held"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(upto), F.lit(0)))
    old = ranges.select(*(F.col(k).alias(f"_{k}") for k in key), "ranks")
    own = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    inside = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))
    moved = counts.join(old, own).select(*by, "name", F.col("least").alias("low"), F.col("most").alias("high"), "before", "held", inside.alias("ranks"))
    return moved.where(F.size("ranks") > 0)


def exact(df: DataFrame, by: list[str], values: dict[str, Column], shares: tuple[float, ...], cell: int = CELL, bins: int = BINS) -> DataFrame:
    """by and, for each name, an array of the quantiles of its non-null values at the shares, linear between neighbours; null where a group has no value.

    NaN isn't a value that can be ordered here: callers leave it out.
    """
    names = list(values)
    kept = stored(df.select(*by, *(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values()))))
    cells = kept.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"v{i}").alias("x")) for i, n in enumerate(names))))).where("x IS NOT NULL")
    place = lambda q: (F.col("held") - 1) * F.lit(q)
    wanted = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares)))))
    ranges = cells.groupBy(*by, "name").agg(F.count("*").alias("held"), F.min("x").alias("low"), F.max("x").alias("high"))
    ranges = stored(ranges.select(*by, "name", "low", "high", F.lit(0).cast("long").alias("before"), "held", wanted.alias("ranks")))
    sizes, wide = ranges.select(*by, "name", F.col("held").alias("n")), (F.col("held") > cell) & (F.col("low") < F.col("high"))
    while not ranges.where(wide).isEmpty():
        ranges = stored(ranges.where(~wide).unionByName(_narrowed(cells, ranges.where(wide), by, bins)))
    one = F.col("low") == F.col("high")
    known = ranges.where(one).select(*by, "name", F.explode("ranks").alias("rank"), F.col("low").alias("x"))
    own = Window.partitionBy(*by, "name", "low", "high").orderBy("x")
    counted = _meet(cells, ranges.where(~one), by).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    found = known.unionByName(counted.where(F.array_contains("ranks", F.col("rank"))).select(*by, "name", "rank", "x"))
    at = found.groupBy(*by, "name").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two entries a share
    at = at.withColumnsRenamed({k: f"_{k}" for k in [*by, "name"]})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by), F.col("name") == F.col("_name"))

    def between(q: float) -> Column:
        h = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(h), F.ceil(h)
        return F.when(low == high, F.col("at")[low]).otherwise((high - h) * F.col("at")[low] + (h - low) * F.col("at")[high])

    lines = sizes.join(at, same).select(*by, "name", F.array(*map(between, shares)).alias("q"))
    whole = lines.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in names))
    groups = kept.select(*(F.col(k).alias(f"_{k}") for k in by)).distinct()
    none = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by))
    return groups.join(whole, none, "left").select(*(F.col(f"_{k}").alias(k) for k in by), *names)
