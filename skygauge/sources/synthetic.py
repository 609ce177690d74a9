"""Synthetic weather with injected faults, and drift experiments, at any length and for any number of stations.

A series runs along an axis: even steps (axis()), or the readings of a table (axis_of()), whose times, numbers and
lengths it then has; an experiment can take those readings themselves for the truth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions import thermo
from skygauge.functions.config import CHANNELS
from skygauge.plans import chunks
from skygauge.plans.scratch import stored


@dataclass(frozen=True)
class WeatherConfig:
    """noise: a factor of all noise; at 0 the wind stays at its median and series are the same for any seed."""

    start: str = "2026-01-01 00:00:00"
    days: float = 7.0
    minutes: int = 5
    mean_temperature: float = 22.0
    daily_amplitude: float = 8.0
    mean_pressure: float = 1013.25
    synoptic_amplitude: float = 12.0
    mean_dew_point: float = 14.0
    wind_shape: float = 2.0
    wind_scale: float = 5.5
    inject: bool = True
    seed: int = 42
    stations: int = 1
    noise: float = 1.0
    #: Minutes of the hour of noon in which there are references.
    noon_minutes: int = 1

    @property
    def steps(self) -> int:
        return int(self.days * 1440 / self.minutes)


#: Injected faults, as (place in the series, rows, channel, value, added to the reading, kind, description). None: no reading. "held": the first reading goes on.
FAULTS = (
    (0.08, 3, "temperature", -999.0, False, "MISSING", "Sentinel -999.0"),
    (0.25, 5, "pressure", None, False, "MISSING", "Sensor dropout NaN gap"),
    (0.15, 1, "humidity", 118.5, False, "PHYSICS_VIOLATION", "RH exceeds 100% (118.5%)"),
    (0.45, 1, "humidity", -12.0, False, "PHYSICS_VIOLATION", "Negative RH (-12%)"),
    (0.35, 1, "wind_speed", -4.5, False, "PHYSICS_VIOLATION", "Negative wind speed (-4.5 m/s)"),
    (0.65, 1, "wind_speed", 108.0, False, "PHYSICS_VIOLATION", "Extreme unphysical wind speed (108 m/s)"),
    (0.72, 1, "temperature", 78.5, False, "PHYSICS_VIOLATION", "Climatological high temperature (78.5°C)"),
    (0.88, 1, "pressure", 720.0, False, "PHYSICS_VIOLATION", "Pressure below physical surface limits (720 hPa)"),
    (0.52, 1, "temperature", 14.0, True, "SPIKE", "Transient +14°C spike"),
    (0.60, 1, "pressure", 9.5, True, "SPIKE", "Step spike in pressure (+9.5 hPa)"),
    (0.80, 17, "temperature", "held", False, "STUCK", "Frozen temperature sensor for 16 intervals"),
)


def _normal(seed: int, salt: int, sigma: float) -> Column:
    """Normal noise that depends on the row alone, whatever the partitions (Box and Muller)."""
    even = lambda k: (F.xxhash64(F.lit(seed), F.lit(salt), F.lit(k), "station_id", "row_id").bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    return sigma * F.sqrt(-2.0 * F.ln(even(0))) * F.cos(2.0 * F.pi() * even(1))


def _even(seed: int, salt: int, noise: float) -> Column:
    return 0.5 + noise * (_uniform(seed, salt) - 0.5)


def _uniform(seed: int, salt: int) -> Column:
    return (F.xxhash64(F.lit(seed), F.lit(salt), "station_id", "row_id").bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float((1 << 52) + 2)


def axis(spark: SparkSession, config: WeatherConfig) -> DataFrame:
    n = config.steps
    ids = spark.range(n * config.stations).select(F.floor(F.col("id") / n).cast("int").alias("station_id"), (F.col("id") % n).alias("row_id"))
    timed = ids.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(config.start)) + F.col("row_id") * config.minutes * 60))
    return timed.withColumns({"place": F.col("row_id"), "steps": F.lit(n)})


def axis_of(readings: DataFrame) -> DataFrame:
    """readings with place, the row's number in its station from 0, and steps, how many rows the station has."""
    return chunks.numbered(readings, total="steps").withColumn("place", F.col("rn") - 1).drop("rn")


AXIS = ("place", "steps")


def weather(spark: SparkSession, config: WeatherConfig | None = None, on: DataFrame | None = None) -> DataFrame:
    """Readings with daily and synoptic cycles, on an axis of their own or a given one; with faults if they are to be injected, in stations of more than 200 steps."""
    return _weather(axis(spark, config or WeatherConfig()) if on is None else on.select("station_id", "row_id", "ts", *AXIS), config or WeatherConfig()).drop(*AXIS)


def _weather(df: DataFrame, config: WeatherConfig) -> DataFrame:
    days = (F.unix_micros("ts") - F.unix_micros(F.lit(config.start).cast("timestamp"))) / 86_400e6
    h, d, pi, s = F.hour("ts") + F.minute("ts") / 60.0, days, F.pi(), config.seed
    t = config.mean_temperature + config.daily_amplitude * F.cos((h - 14.0) * 2.0 * pi / 24.0) + 3.0 * F.sin(2.0 * pi * d / 3.5) + _normal(s, 1, 0.4 * config.noise)
    p = config.mean_pressure + config.synoptic_amplitude * F.cos(2.0 * pi * d / 4.0) + 1.2 * F.sin(4.0 * pi * (h - 9.0) / 24.0) + _normal(s, 2, 0.15 * config.noise)
    df = df.withColumns({"temperature": t, "pressure": p})
    td = F.least(config.mean_dew_point + 2.0 * F.sin(2.0 * pi * d / 2.0) + _normal(s, 3, 0.3 * config.noise), F.col("temperature") - 1.5)
    rh = 100.0 * thermo.saturation_vapor_pressure(td) / thermo.saturation_vapor_pressure(F.col("temperature")) + _normal(s, 4, 0.5 * config.noise)
    wind = config.wind_scale * F.pow(-F.ln(1.0 - _even(s, 5, config.noise)), F.lit(1.0 / config.wind_shape)) * (1.0 + 0.4 * F.greatest(F.lit(0.0), F.sin((h - 8.0) * pi / 12.0)))
    df = df.withColumns({"humidity": thermo.clamp(rh, 10.0, 98.0), "wind_speed": thermo.clamp(wind, 0.0, 35.0)})
    return inject_faults(df) if config.inject else df


def inject_faults(df: DataFrame) -> DataFrame:
    """df (with place and steps) with FAULTS at their places, in stations of more than 200 steps. A held reading joins back by station: one row each, stored, so that Spark knows how few they are.

    A row's fault is looked up in an array and not by a condition for each: all of those in one expression make a method that is too long to be compiled.
    """
    hits, out = {}, {}
    for c in CHANNELS:
        spans = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(rows).alias("rows"), F.lit(None if value == "held" else value).cast("double").alias("value"), F.lit(added).alias("added"), F.lit(value == "held").alias("held"))
            for part, rows, channel, value, added, *_ in FAULTS if channel == c))
        at = lambda f: F.floor(F.col("steps") * f["part"])
        here = F.filter(spans, lambda f: (F.col("steps") > 200) & F.col("place").between(at(f), at(f) + f["rows"] - 1))  # noqa: B023
        hits[f"_{c}_hit"] = F.get(here, F.size(here) - 1)
        hit = F.col(f"_{c}_hit")
        out[c] = F.when(hit.isNull(), F.col(c)).when(hit["held"], F.col(f"_{c}_held")).when(hit["added"], F.col(c) + hit["value"]).otherwise(hit["value"])
        part = next((part for part, _, channel, value, *_ in FAULTS if channel == c and value == "held"), None)
        if part is None:
            df = df.withColumn(f"_{c}_held", F.lit(None).cast("double"))
        else:
            first = stored(df.where((F.col("steps") > 200) & (F.col("place") == F.floor(F.col("steps") * F.lit(part)))).select(F.col("station_id").alias("_s"), F.col(c).alias(f"_{c}_held")).coalesce(1))
            df = df.join(first, F.col("station_id").eqNullSafe(F.col("_s")), "left").drop("_s")
    return df.withColumns(hits).withColumns(out).drop(*hits, *(f"_{c}_held" for c in CHANNELS))


def faults(spark: SparkSession, config: WeatherConfig | None = None) -> DataFrame:
    """The injected faults: idx, sensor, type, desc."""
    return faults_on(axis(spark, config or WeatherConfig()).where("station_id = 0")).drop("station_id")


def faults_on(df: DataFrame) -> DataFrame:
    """The faults of each station of an axis: station_id, idx, sensor, type, desc."""
    stations = df.groupBy("station_id").agg(F.max("steps").alias("steps")).where("steps > 200")
    rows = (F.struct(F.floor(F.col("steps") * F.lit(part)).cast("int").alias("idx"), F.lit(channel).alias("sensor"), F.lit(kind).alias("type"), F.lit(text).alias("desc")) for part, _, channel, _, _, kind, text in FAULTS)
    return stations.select("station_id", F.inline(F.array(*rows)))


#: Bias a day of a ramp, bias after a step and where it is, deviation a step of a random walk.
RAMP = {"temperature": 0.25, "pressure": -0.40, "humidity": 0.80, "wind_speed": 0.15}
STEP = {"temperature": 2.2, "pressure": -3.0, "humidity": 6.5, "wind_speed": 0.0}
WALK = {"temperature": 0.015, "pressure": 0.012, "humidity": 0.035, "wind_speed": 0.010}
NOISE = {"temperature": 0.2, "pressure": 0.15, "humidity": 0.8, "wind_speed": 0.3}
SCENARIOS = ("linear_ramp", "step_jump", "brownian_drift", "multi_fault")


def ramp(config: WeatherConfig) -> Column:
    """Days, from 0 in the first row to the whole duration in the last."""
    return F.col("place") * (config.days / F.greatest(F.lit(1), F.col("steps") - 1))


def biases(df: DataFrame, scenario: str, config: WeatherConfig) -> DataFrame:
    """df with {channel}_true_bias of a scenario; for one that isn't known no bias at all."""
    after = lambda share, x: F.when(F.col("place") >= F.floor(F.col("steps") * F.lit(share)), F.lit(x)).otherwise(0.0)
    none = {c: F.lit(0.0) for c in CHANNELS}
    walks: dict[str, float] = {}
    if scenario == "linear_ramp":
        found = {c: RAMP[c] * ramp(config) for c in CHANNELS}
    elif scenario == "step_jump":
        found = {c: after(0.42, STEP[c]) for c in CHANNELS}
    elif scenario == "brownian_drift":
        found, walks = none, WALK
    elif scenario == "multi_fault":
        found, walks = none | {"temperature": 0.3 * ramp(config), "pressure": after(0.5, -2.5)}, {"humidity": 0.03}
    else:
        found = none
    if walks:
        steps = {f"_{c}_walk": _normal(config.seed, 20 + i, walks[c] * config.noise) for i, c in enumerate(CHANNELS) if c in walks}
        df = chunks.running_sums(chunks.in_chunks(df), steps).drop("rn", "chunk")
        found = found | {c: F.col(f"_{c}_walk") for c in walks}
    return df.withColumns({f"{c}_true_bias": found[c].cast("double") for c in CHANNELS}).drop(*(f"_{c}_walk" for c in walks))


def drift(spark: SparkSession, scenario: str = "linear_ramp", config: WeatherConfig | None = None) -> dict[str, DataFrame]:
    """true, observed (truth, bias and noise), biases and references (the truth at noon, else null) of an experiment."""
    config = config or WeatherConfig(inject=False)
    return experiment(_weather(axis(spark, config), config), scenario, config)


def experiment(truth: DataFrame, scenario: str, config: WeatherConfig) -> dict[str, DataFrame]:
    """drift() with readings (with place and steps) for the truth."""
    whole = biases(truth, scenario, config)
    seen = {c: F.col(c) + F.col(f"{c}_true_bias") + _normal(config.seed, 10 + i, NOISE[c] * config.noise) for i, c in enumerate(CHANNELS)}
    seen |= {"humidity": thermo.clamp(seen["humidity"], 0.0, 100.0), "wind_speed": thermo.at_least(seen["wind_speed"], 0.0)}
    keys, noon = ("station_id", "row_id", "ts"), (F.hour("ts") == 12) & (F.minute("ts") < config.noon_minutes)
    return {"true": truth.drop(*AXIS), "observed": whole.select(*keys, *(seen[c].alias(c) for c in CHANNELS)), "biases": whole.select(*keys, *(f"{c}_true_bias" for c in CHANNELS)),
        "references": truth.select(*keys, *(F.when(noon, F.col(c)).alias(c) for c in CHANNELS))}
