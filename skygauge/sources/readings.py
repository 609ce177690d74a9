"""Station readings: from files, from frames with other column names, and from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, PROFILES

#: The stations of the network.
STATIONS = (
    ("AWS-01-ISRIKA1-Bheemili", "ISRIKA1-Bheemili Meteorological Station", 17.8900, 83.4520, 10.0, "OPERATIONAL", 100),
    ("AWS-02-Pataparadesipalem Station", "Pataparadesipalem Station Observatory", 17.7900, 83.3000, 20.0, "DEGRADED_SENSORS", 150),
    ("AWS-03-Visakhapatnam", "Visakhapatnam Station (VOVZ)", 17.6868, 83.2185, 5.0, "OPERATIONAL", 80),
    ("AWS-04-IVISAK16", "Auto Nagar Station", 17.6868, 83.2500, 15.0, "CALIBRATION_DUE", 120),
)


def normalise(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Readings with canonical names and types.

    names maps canonical to actual names, where they differ. ts is read as a timestamp
    where it isn't one; NaN becomes null, so that comparisons are false as they should be,
    while infinities stay until the missing flag is set. A missing row_id or station_id is
    added; row_id is then the place in the input, station_id 0.
    """
    names = {x: x for x in ("station_id", "row_id", "ts", *CHANNELS)} | (names or {})
    has = set(df.columns)
    kind = dict(df.dtypes).get(names["ts"], "")
    ts = F.col(names["ts"]) if kind == "timestamp" else F.col(names["ts"]).cast("timestamp") if kind.startswith(("timestamp", "date")) else F.try_to_timestamp(F.col(names["ts"]).cast("string"))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.select(
        (F.col(names["station_id"]) if names["station_id"] in has else F.lit(0)).alias("station_id"),
        (F.col(names["row_id"]).cast("long") if names["row_id"] in has else F.monotonically_increasing_id()).alias("row_id"),
        ts.alias("ts"), *((number(names[c]) if names[c] in has else F.lit(None).cast("double")).alias(c) for c in CHANNELS))


def read(spark: SparkSession, path: str, kind: str = "parquet", names: dict[str, str] | None = None) -> DataFrame:
    """Readings from parquet, CSV with a header, JSON lines or ORC."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return normalise(reader.load(path), names)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of four stations, derived from the event table: a daily cycle with faults injected."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    e = e.select("event_id", ts.alias("ts"), F.pmod("user_id", F.lit(4)).cast("int").alias("station_id"), "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.hour(ts) + F.minute(ts) / F.lit(60.0)).alias("h"), F.dayofmonth(ts).alias("d"))
    k, h, pi = F.col("k"), F.col("h"), F.pi()
    spread = lambda m, scale, shift=50: (F.pmod(k * m, F.lit(100)) - shift) * F.lit(scale)
    base = e.select("*",
        F.round(22.0 + 8.0 * F.cos((h - 14.0) * 2.0 * pi / 24.0) + (k - 50) * 0.02, 4).alias("t0"),
        F.round(1013.25 + 1.2 * F.sin(4.0 * pi * (h - 9.0) / 24.0) + spread(7, 0.01), 4).alias("p0"),
        F.round(55.0 - 20.0 * F.cos((h - 14.0) * 2.0 * pi / 24.0) + spread(13, 0.04), 4).alias("r0"),
        F.round(4.0 + 2.0 * F.greatest(F.lit(0.0), F.sin((h - 8.0) * pi / 12.0)) + spread(17, 0.03, 0), 4).alias("w0"))
    is_ = lambda kind, n: (F.col("event_type") == kind) & (k == n)
    null = F.lit(None).cast("double")
    return base.select("station_id", F.col("event_id").alias("row_id"), "ts",
        F.when(is_("error", 7), -999.0).when(is_("signup", 3), null).when(is_("error", 11), 78.5).when(is_("click", 13), F.col("t0") + 14.0).when((F.col("d") == 20) & (h < 6), 18.0).otherwise(F.col("t0")).alias("temperature"),
        F.when(is_("view", 5), null).when(is_("error", 17), 720.0).when(is_("click", 19), F.col("p0") + 9.5).otherwise(F.col("p0")).alias("pressure"),
        F.when(is_("error", 23), 118.5).when(is_("error", 29), -12.0).otherwise(F.col("r0")).alias("humidity"),
        F.when(is_("error", 31), -4.5).when(is_("error", 37), 108.0).otherwise(F.col("w0")).alias("wind_speed"))


def stations(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(STATIONS)]
    return spark.createDataFrame(rows, "station_id int, code string, name string, latitude double, longitude double, elevation double, status string, step_index int")


def profiles(spark: SparkSession) -> DataFrame:
    """The sensor dimension: one row a sensor, with its place in the station."""
    rows = [(i, *vars(p).values()) for i, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "ordinal int, sensor_name string, instrument_model string, unit string, last_calibration_date string, calibration_interval_days int, "
        "max_allowable_bias double, max_allowable_noise_std double, min_completeness_threshold double, degradation_score_threshold double").withColumn("last_calibration_date", F.to_date("last_calibration_date"))
