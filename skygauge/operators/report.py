"""Quality summaries and the incident log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS
from skygauge.operators.physics import DERIVED, FLAGS, any_of
from skygauge.operators.statistical import KINDS, flag

#: What counts as a channel's physics violations, and what also makes its readings not valid here.
COUNTED = {
    "temperature": ("flag_temp_out_of_bounds",),
    "pressure": ("flag_pressure_out_of_bounds",),
    "humidity": ("flag_rh_out_of_bounds", "flag_dew_point_exceeds_temp"),
    "wind_speed": ("flag_wind_negative", "flag_wind_exceeds_extreme"),
}
INVALID = COUNTED | {"wind_speed": ("flag_wind_physics_violation",)}
#: Names of the report's counts.
PHYSICS_COUNTS = {
    "T-P-RH Thermodynamic Violations": "flag_t_p_rh_physics_violation",
    "Dew Point > Dry Bulb Temperature": "flag_dew_point_exceeds_temp",
    "Relative Humidity Out of Bounds": "flag_rh_out_of_bounds",
    "Vapor Pressure > Atmospheric": "flag_vapor_exceeds_pressure",
    "Negative Wind Speed": "flag_wind_negative",
    "Wind Speed Exceeds Typical Range": "flag_wind_exceeds_typical",
    "Temperature Climatological Breach": "flag_temp_out_of_bounds",
    "Pressure Climatological Breach": "flag_pressure_out_of_bounds",
}
STATISTICAL_COUNTS = {
    "Rate-of-Change Spikes": "spike",
    "Rolling Z-Score Outliers": "zscore_outlier",
    "IQR Boxplot Outliers": "iqr_outlier",
    "Stuck / Frozen Sensor Readings": "stuck",
    "Missing / Sentinel Readings": "missing",
}


def _long(df: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame:
    """keys and (name, count) of already aggregated columns."""
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("n")) for n, c in rows))))


def channel_cells(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """keys, sensor, and whether each reading of a channel is bad, and by which kind of fault."""
    parts = []
    for c in CHANNELS:
        bad = any_of([F.col(flag(c, "missing")), F.col(flag(c, "stat_anomaly")), *(F.col(x) for x in INVALID[c])])
        parts.append(F.struct(F.lit(c).alias("sensor"), bad.alias("bad"), F.col(flag(c, "missing")).alias("missing"), any_of([F.col(x) for x in COUNTED[c]]).alias("physics"),
            *(F.col(flag(c, k)).alias(k) for k in KINDS[1:5])))
    return df.select(*keys, F.inline(F.array(*parts)))


def channel_summary(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """For each station and sensor: share of valid readings in per cent, and counts by kind of fault."""
    return channel_cells(df, keys).groupBy(*keys, "sensor").agg(
        F.round(100.0 * F.avg((~F.col("bad")).cast("int")), 4).alias("valid_percent"), F.count_if("missing").alias("missing"), F.count_if("physics").alias("physics_violations"),
        F.count_if("iqr_outlier").alias("iqr_outliers"), F.count_if("zscore_outlier").alias("zscore_outliers"), F.count_if("spike").alias("spikes"), F.count_if("stuck").alias("stuck"))


def physics_counts(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    counted = df.groupBy(*keys).agg(*(F.count_if(c).alias(c) for c in PHYSICS_COUNTS.values()))
    return _long(counted, list(keys), list(PHYSICS_COUNTS.items()))


def statistical_counts(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    of = lambda k: sum((F.count_if(flag(c, k)) for c in CHANNELS), F.lit(0)).alias(k)
    counted = df.groupBy(*keys).agg(*(of(k) for k in STATISTICAL_COUNTS.values()))
    return _long(counted, list(keys), list(STATISTICAL_COUNTS.items()))


def overall(df: DataFrame, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """Records, first and last time, and per cent of rows that are clean, have a missing value, have an anomaly."""
    gaps = any_of([F.col(flag(c, "missing")) for c in CHANNELS])
    odd = any_of([*(F.col(x) for x in FLAGS), *(F.col(flag(c, k)) for c in CHANNELS for k in KINDS[1:])])
    rate = lambda x: F.round(100.0 * F.avg(x.cast("int")), 4)
    place = F.struct("ts", "row_id")
    return df.groupBy(*keys).agg(F.count("*").alias("total_records"), F.min_by("ts", place).alias("time_start"), F.max_by("ts", place).alias("time_end"),
        rate(~odd & ~gaps).alias("valid_percent"), rate(gaps).alias("missing_percent"), rate(odd).alias("anomaly_percent"))


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("nan"))


def incidents(df: DataFrame) -> DataFrame:
    """The incident log: every row's faults in the order of their kinds, in one pass over the rows.

    Sort by ts and seq for the log's order; seq is the kind's place. observed is text, as
    some kinds have two readings.
    """
    kinds: list[tuple[Column, Column, Column, Column, Column, Column]] = []
    lit = F.lit

    def add(condition: str, sensor: str, observed: Column, category: Column, rule: str, text: Column) -> None:
        kinds.append((F.col(condition), lit(sensor), observed, category, lit(rule), text))

    t, p, rh, ws = (F.col(c) for c in CHANNELS)
    for c in CHANNELS:
        add(flag(c, "missing"), c, _number(F.col(c)), lit("MISSING"), f"{c}_missing_or_sentinel", lit(f"Missing reading or sentinel value detected in {c}"))
    violation = lit("PHYSICS_VIOLATION")
    add("flag_dew_point_exceeds_temp", "temperature+humidity", F.concat(lit("T="), _number(t), lit("°C, RH="), _number(rh), lit("%")), violation, "dew_point_le_temp",
        F.concat(lit("Thermodynamic violation: Dew Point ("), F.format_string("%.2f", DERIVED[2]), lit("°C) exceeds Dry Bulb Temperature ("), _number(t), lit("°C)")))
    add("flag_vapor_exceeds_pressure", "pressure+humidity", _number(p), violation, "vapor_pressure_le_ambient", lit("Water vapor pressure exceeds total atmospheric ambient pressure"))
    add("flag_rh_out_of_bounds", "humidity", _number(rh), violation, "rh_physical_bounds", F.concat(lit("Relative Humidity ("), _number(rh), lit("%) out of physical bounds [0%, 102%]")))
    add("flag_wind_negative", "wind_speed", _number(ws), violation, "wind_speed_non_negative", F.concat(lit("Physically impossible negative wind speed ("), _number(ws), lit(" m/s)")))
    add("flag_wind_exceeds_typical", "wind_speed", _number(ws), F.when(ws <= 90.0, "PHYSICS_WARNING").otherwise("PHYSICS_VIOLATION"), "wind_speed_max_bounds",
        F.concat(lit("Wind speed ("), _number(ws), lit(" m/s) exceeds typical 50 m/s bound")))
    for c in CHANNELS:
        add(flag(c, "spike"), c, _number(F.col(c)), lit("SPIKE"), f"{c}_rate_of_change_spike", F.concat(lit(f"Unphysical abrupt step change / transient spike in {c} ("), _number(F.col(c)), lit(")")))
        add(flag(c, "stuck"), c, _number(F.col(c)), lit("STUCK"), f"{c}_sensor_flatline", F.concat(lit(f"Frozen / stuck sensor: zero variance in {c} over time window ("), _number(F.col(c)), lit(")")))
    found = F.array(*(F.when(k[0], F.struct(lit(i).alias("seq"), k[1].alias("sensor"), k[2].alias("observed"), k[3].alias("category"), k[4].alias("rule"), k[5].alias("description"))) for i, k in enumerate(kinds)))
    return df.select("station_id", "row_id", "ts", F.inline(F.filter(found, lambda x: x.isNotNull())))


def top_incidents(log: DataFrame, n: int = 25) -> DataFrame:
    """The first n incidents: a limit is what this is for."""
    return log.orderBy("ts", "row_id", "seq").limit(n)


def roll_up(df: DataFrame) -> DataFrame:
    """Readings and faults by station and sensor, by station, and in all: level says which (0, 1, 3 as in grouping_id), keys that were rolled up are null."""
    parts = [F.struct(F.lit(c).alias("sensor"), F.col(flag(c, "missing")).alias("missing"), any_of([F.col(x) for x in COUNTED[c]]).alias("physics"), F.col(flag(c, "stat_anomaly")).alias("statistical")) for c in CHANNELS]
    cells = df.select("station_id", F.inline(F.array(*parts)))
    return cells.rollup("station_id", "sensor").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("readings"), F.count_if("missing").alias("missing"), F.count_if("physics").alias("physics"), F.count_if("statistical").alias("statistical"))
