"""What a dashboard asks for: live buffers, history, station overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS
from skygauge.functions.rounding import half_even


def live_buffer(df: DataFrame, step: Column, before: int = 60, rn: str = "rn") -> DataFrame:
    """Each station's row at its step (counted from 0) and the rows before it."""
    return df.where(F.col(rn).between(step + 1 - before, step + 1))


def history(df: DataFrame, rows: int = 300, rn: str = "rn") -> DataFrame:
    """The first rows of each station: the limit is what this is for."""
    return df.where(F.col(rn) <= rows)


def overview(stations: DataFrame, df: DataFrame, health: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Every station with its latest readings, number of readings, average health and active alerts."""
    latest = df.groupBy(F.col("station_id").alias("_s")).agg(F.count("*").alias("readings"), F.max_by(F.struct("row_id", *CHANNELS), F.struct("ts", "row_id")).alias("_l"))
    out = stations.join(latest, F.col("station_id") == F.col("_s"), "left").select(*stations.columns, F.coalesce("readings", F.lit(0)).alias("readings"), "_l.*")
    if health is not None:
        out = out.join(health.groupBy("station_id").agg(half_even(F.avg("health_score"), 1).alias("average_health")), "station_id", "left")
    if alerts is not None:
        active = alerts.groupBy("station_id").agg(F.count_if(F.col("severity").isin("CRITICAL", "WARNING")).alias("active_alerts"))
        out = out.join(active, "station_id", "left").withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))
    return out


def agreement(df: DataFrame, flag: str, width: str = "1 hour") -> DataFrame:
    """By window of time, how many stations report and what share of them has a flagged reading."""
    by_station = df.groupBy(F.window("ts", width).alias("w"), "station_id").agg(F.max(F.col(flag).cast("int")).alias("hit"))
    return by_station.groupBy(F.col("w.start").alias("window_start")).agg(F.count("*").alias("stations"), F.round(F.avg("hit"), 4).alias("agreement"))


def metrics(df: DataFrame, seconds: float, tracked: bool = True, forest: object = None, network: object = None) -> DataFrame:
    """One row: how many readings were processed in the seconds, how fast, from how many stations, and which models are ready."""
    ready = lambda model: F.lit("READY" if model is not None else "NOT_TRAINED")
    n = F.col("total_inferences")
    found = df.agg(F.count("*").alias("total_inferences"), F.count_distinct("station_id").alias("active_stations"))
    return found.select(F.lit(round(seconds, 1)).alias("uptime_seconds"), "total_inferences", half_even(n / seconds, 1).alias("throughput_rps"), half_even(F.try_divide(F.lit(1000.0 * seconds), n), 3).alias("avg_latency_ms"),
        F.lit("CONVERGED" if tracked else "IDLE").alias("kalman_filter_state"), ready(network).alias("lstm_model_status"), ready(forest).alias("iforest_model_status"), "active_stations")


#: Scores from which a dashboard shows a sensor as good or fair, and the bias above which it is highlighted.
GOOD, FAIR, NOTABLE_BIAS = 85.0, 60.0, 0.5


def shaded(health: DataFrame) -> DataFrame:
    """Health metrics with how a dashboard shows them: shade (good, fair, poor) and bias_highlighted."""
    score = F.col("health_score")
    return health.withColumns({"shade": F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor"), "bias_highlighted": F.abs("current_bias") > NOTABLE_BIAS})
