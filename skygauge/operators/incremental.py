"""Reports from partial results by day, so that a new day doesn't read the history again.

A part is a row for a station, day and sensor: counts, and means with sums of squares and products about them, which add up
exactly by the shift of their means (Chan, Golub and LeVeque), without differences of large sums. What depends on
order goes by day too: a bias's place among the known ones is an offset plus its place in the day, and the step from the last reading
of a day to the first of the next is made when parts are merged. Merging takes a row a day and sensor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygauge.operators import health, report
from skygauge.operators.statistical import KINDS

COUNTS = ("missing", "physics", *KINDS[1:5])


def channel_parts(flagged: DataFrame) -> DataFrame:
    """Parts of report.channel_summary(): the readings and faults of each station, day and sensor."""
    cells = report.channel_cells(flagged.withColumn("day", F.to_date("ts")), ("station_id", "day"))
    return cells.groupBy("station_id", "day", "sensor").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *(F.count_if(x).alias(x) for x in COUNTS))


def channel_summary(parts: DataFrame) -> DataFrame:
    """report.channel_summary() of all days that parts has."""
    total = lambda x: F.sum(x).cast("long")
    names = {"missing": "missing", "physics": "physics_violations", "iqr_outlier": "iqr_outliers", "zscore_outlier": "zscore_outliers", "spike": "spikes", "stuck": "stuck"}
    return parts.groupBy("station_id", "sensor").agg(F.round(100.0 * total(F.col("n") - F.col("bad")) / total("n"), 4).alias("valid_percent"), *(total(k).alias(v) for k, v in names.items()))


def _moments(x: str) -> list[Column]:
    """Number, mean, and sum of squares about it."""
    return [F.count(x).alias(f"{x}_n"), F.avg(x).alias(f"{x}_mean"), (F.var_pop(x) * F.count(x)).alias(f"{x}_m2")]


def health_parts(df: DataFrame) -> DataFrame:
    """Parts of health.measures(), from the same columns."""
    rows = health.cells(df.withColumn("_at", F.struct("ts", "row_id")), "_at").withColumn("day", F.to_date("_at.ts"))
    by_day = Window.partitionBy("station_id", "day", "sensor").orderBy("_at")
    known = F.col("b").isNotNull()
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.when(known, F.count("b").over(upto).cast("double")), "d": F.when(F.col("x").isNotNull(), F.col("x") - F.last("x", True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)))})
    n = F.count("b")
    return rows.groupBy("station_id", "day", "ordinal", "sensor").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if("f").alias("incidents"),
        n.alias("b_n"), F.avg("b").alias("b_mean"), F.avg("k").alias("k_mean"), (F.regr_sxx("b", "k")).alias("kk"), (F.regr_sxy("b", "k")).alias("kb"), F.max_by("b", F.when(known, F.col("_at"))).alias("last_b"),
        *_moments("e"), *_moments("d"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("_at"))).alias("first_x"), F.max_by("x", F.when(F.col("x").isNotNull(), F.col("_at"))).alias("last_x"))


def health_measures(parts: DataFrame, step_minutes: float = 5.0) -> DataFrame:
    """health.measures() of all days that parts has."""
    whole = Window.partitionBy("station_id", "sensor")
    earlier = whole.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # The step from one day to the next is a part of its own, of one difference.
    step = F.col("first_x") - F.last("last_x", True).over(earlier)
    parts = parts.withColumns({"k_mean": F.col("k_mean") + F.coalesce(F.sum("b_n").over(earlier), F.lit(0)), "step": step})
    mean = lambda n, x: F.try_divide(F.sum(F.col(n) * F.col(x)).over(whole), F.sum(n).over(whole))
    steps = F.when(F.col("step").isNotNull(), 1).otherwise(0)
    d_sum = F.coalesce(F.col("d_n") * F.col("d_mean"), F.lit(0.0)) + F.coalesce("step", F.lit(0.0))
    parts = parts.withColumns({"k_all": mean("b_n", "k_mean"), "b_all": mean("b_n", "b_mean"), "e_all": mean("e_n", "e_mean"), "d_all": F.try_divide(F.sum(d_sum).over(whole), F.sum(F.col("d_n") + steps).over(whole))})
    off = lambda x: F.col(f"{x}_mean") - F.col(f"{x}_all")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    found = parts.groupBy("station_id", "ordinal", "sensor").agg(
        F.sum("total").alias("total_expected"), F.sum("ok").alias("total_received"), F.sum("incidents").alias("anomaly_incidents"), F.max_by("last_b", F.when(F.col("b_n") > 0, F.struct("day"))).alias("last_bias"), F.sum("b_n").alias("n_bias"),
        F.try_divide(F.sum(zero(F.col("kb") + F.col("b_n") * off("k") * off("b"))), F.sum(zero(F.col("kk") + F.col("b_n") * off("k") * off("k")))).alias("per_row"),
        F.try_divide(F.sum(zero(F.col("e_m2") + F.col("e_n") * off("e") * off("e"))), F.sum("e_n") - 1).alias("e_var"), F.sum("e_n").alias("n_e"),
        F.try_divide(F.sum(zero(F.col("d_m2") + F.col("d_n") * off("d") * off("d")) + zero((F.col("step") - F.col("d_all")) * (F.col("step") - F.col("d_all")))), F.sum(F.col("d_n") + steps) - 1).alias("d_var"))
    return health.measured(found.withColumns({"e_std": F.sqrt("e_var"), "d_std": F.sqrt("d_var")}), step_minutes)

