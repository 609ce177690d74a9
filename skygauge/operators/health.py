"""Health score, remaining life and maintenance alerts of each sensor of each station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, EVALUATION_DATE
from skygauge.functions.rounding import half_even
from skygauge.operators.physics import any_of
from skygauge.operators.statistical import KINDS, flag
from skygauge.plans import chunks

WEIGHTS = {"completeness": 0.25, "drift": 0.35, "noise": 0.25, "calibration": 0.15}
#: The physics flags that count as incidents of a sensor.
INCIDENTS = {"temperature": (), "pressure": ("flag_pressure_out_of_bounds", "flag_vapor_exceeds_pressure"), "humidity": (), "wind_speed": ()}


def received(x: Column) -> Column:
    """Not null and no far-off sentinel; -99 and 999 pass here."""
    return F.coalesce((x > -900) & (x < 9000), F.lit(False))


def _choice(df: DataFrame, channel: str, suffixes: tuple[str, ...]) -> Column:
    return next((F.col(f"{channel}_{s}") for s in suffixes if f"{channel}_{s}" in df.columns), F.lit(None).cast("double"))


def measures(df: DataFrame, step_minutes: float = 5.0) -> DataFrame:
    """What scores are made of, by station and sensor.

    df: readings, and if known {channel}_bias (or _true_bias), {channel}_post_fit_residual (or
    _innovation) and the flags. Drift is the bias's slope over the place among known biases.
    Noise without residuals is the deviation of differences of successive received readings over sqrt(2).
    """
    rows = _given(df, *(["rn"] if "rn" in df.columns else []), "row_id", "ts")
    rows = chunks.in_chunks(rows)
    rows = chunks.with_neighbours(rows, {f"{c}_r": F.when(received(F.col(c)), F.col(c)) for c in CHANNELS})
    rows = chunks.running_sums(rows, {f"{c}_k": F.when(F.col(f"{c}_b").isNotNull(), 1).otherwise(0) for c in CHANNELS})
    more = {c: (F.col(f"{c}_k").alias("k"), F.when(received(F.col(c)), F.col(c) - F.col(f"{c}_r_prior")["x"]).alias("d")) for c in CHANNELS}
    long_ = _cells(rows, more, "rn")
    known = F.col("b").isNotNull()
    found = long_.groupBy("station_id", "ordinal", "sensor").agg(
        F.count("*").alias("total_expected"), F.count_if("ok").alias("total_received"), F.count_if("f").alias("anomaly_incidents"),
        F.max_by("b", F.when(known, F.col("rn"))).alias("last_bias"), F.count("b").alias("n_bias"), F.regr_slope("b", F.when(known, F.col("k").cast("double"))).alias("per_row"),
        F.stddev_samp("e").alias("e_std"), F.var_samp("e").alias("e_var"), F.count("e").alias("n_e"), F.stddev_samp("d").alias("d_std"))
    return measured(found, step_minutes)


def _given(df: DataFrame, *keys: str) -> DataFrame:
    """station_id, keys, readings, and of each channel bias _b, residual _e and incident _f, as far as df has them."""
    bias = {c: _choice(df, c, ("bias", "true_bias")) for c in CHANNELS}
    rest = {c: _choice(df, c, ("post_fit_residual", "innovation")) for c in CHANNELS}
    flags = {c: any_of([F.col(x) for x in (*(flag(c, k) for k in KINDS), *INCIDENTS[c]) if x in df.columns]) for c in CHANNELS}
    return df.select("station_id", *keys, *CHANNELS, *(bias[c].alias(f"{c}_b") for c in CHANNELS), *(rest[c].alias(f"{c}_e") for c in CHANNELS), *(flags[c].alias(f"{c}_f") for c in CHANNELS))


def _cells(rows: DataFrame, more: dict[str, tuple[Column, ...]], *keys: str) -> DataFrame:
    """A row for each reading and channel: station_id, keys, ordinal, sensor, ok, bias b, residual e, incident f and more."""
    parts = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("sensor"), received(F.col(c)).alias("ok"), F.col(f"{c}_b").alias("b"), F.col(f"{c}_e").alias("e"), F.col(f"{c}_f").alias("f"), *more[c]) for i, c in enumerate(CHANNELS)]
    return rows.select("station_id", *keys, F.inline(F.array(*parts)))


def cells(df: DataFrame, *keys: str) -> DataFrame:
    """_cells() of readings with x, the reading if it was received."""
    return _cells(_given(df, *keys), {c: (F.when(received(F.col(c)), F.col(c)).alias("x"),) for c in CHANNELS}, *keys)


def measured(found: DataFrame, step_minutes: float) -> DataFrame:
    """measures() from sums over each station and sensor."""
    span = F.col("n_bias") * step_minutes / 1440.0
    slope = F.when(F.col("n_bias") > 10, F.try_divide(F.col("per_row"), F.try_divide(span, F.col("n_bias") - 1)))
    noise = F.when(F.col("n_e") > 0, F.col("e_std")).otherwise(F.coalesce(F.col("d_std") / F.sqrt(F.lit(2.0)), F.lit(0.0)))
    return found.select("station_id", "ordinal", "sensor", "total_expected", "total_received", "anomaly_incidents", (100.0 * F.col("total_received") / F.col("total_expected")).alias("completeness"),
        F.coalesce("last_bias", F.lit(0.0)).alias("bias"), F.coalesce(slope, F.lit(0.0)).alias("drift"), noise.alias("noise"), F.when(F.col("n_e") > 0, F.col("e_var")).otherwise(noise * noise).alias("variance"))


def score(found: DataFrame, profiles: DataFrame, current_date: str = EVALUATION_DATE) -> DataFrame:
    """Health metrics from measures() and the sensor dimension. Sensors without a profile get the default one's limits."""
    p = profiles.withColumnRenamed("ordinal", "_o")
    df = found.join(p, found["sensor"] == p["sensor_name"], "left")
    defaults = {"instrument_model": F.lit("Standard AWS Sensor"), "unit": F.lit(""), "last_calibration_date": F.to_date(F.lit("2026-01-01")), "calibration_interval_days": F.lit(365),
        "max_allowable_bias": F.lit(0.8), "max_allowable_noise_std": F.lit(0.5), "min_completeness_threshold": F.lit(95.0), "degradation_score_threshold": F.lit(60.0)}
    df = df.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})
    at_least_0 = lambda x: F.greatest(F.lit(0.0), x)
    bias, limit, least = F.abs("bias"), F.col("calibration_interval_days").cast("double"), F.col("min_completeness_threshold")
    days = at_least_0(F.datediff(F.to_date(F.lit(current_date)), "last_calibration_date").cast("double"))
    df = df.withColumn("days", days)
    days, c = F.col("days"), F.col("completeness")
    ratio = days / (limit + 1e-6)
    df = df.withColumns({
        "calibration_status": F.when(days > limit, "EXPIRED").when(days > 0.85 * limit, "DUE_SOON").when(bias > F.col("max_allowable_bias"), "OUT_OF_SPEC").otherwise("OPTIMAL"),
        "s_completeness": F.when(c >= least, 90.0 + 10.0 * ((c - least) / (100.0 - least + 1e-6))).otherwise(at_least_0(c / least * 90.0)),
        "s_drift": at_least_0(100.0 * (1.0 - F.least(F.lit(2.0), bias / (F.col("max_allowable_bias") + 1e-6)) / 1.5)),
        "s_noise": at_least_0(100.0 * (1.0 - F.least(F.lit(2.0), F.col("noise") / (F.col("max_allowable_noise_std") + 1e-6)) / 1.6)),
        "s_calibration": F.when(ratio <= 1.0, 100.0 * (1.0 - 0.4 * ratio)).otherwise(at_least_0(60.0 - 40.0 * (ratio - 1.0))),
    })
    raw = sum((w * F.col(f"s_{k}") for k, w in WEIGHTS.items()), F.lit(0.0)) - F.least(F.lit(20.0), 1.5 * F.col("anomaly_incidents"))
    df = df.withColumn("score", F.least(F.lit(100.0), at_least_0(raw)))
    margin = F.when(F.abs("drift") > 1e-4, F.try_divide(at_least_0(F.col("max_allowable_bias") - bias), F.abs("drift"))).otherwise(365.0)
    df = df.withColumn("life", F.least(margin, at_least_0(limit - days)))
    s, life = F.col("score"), F.col("life")
    degraded = s < F.col("degradation_score_threshold")
    status = (F.when((s < 40.0) | (bias >= F.col("max_allowable_bias")) | (life <= 7.0), "URGENT_ACTION_REQUIRED")
        .when(degraded | (life <= 30.0) | (F.col("calibration_status") == "EXPIRED"), "MAINTENANCE_DUE")
        .when((F.col("calibration_status") == "DUE_SOON") | (s < 75.0), "CALIBRATION_RECOMMENDED").otherwise("NORMAL"))
    df = df.withColumn("maintenance_status", status)
    is_ = lambda x: F.col("maintenance_status") == x
    action = (F.when(is_("URGENT_ACTION_REQUIRED"), F.concat(F.lit("URGENT: Immediate field inspection & sensor replacement / full recalibration required for "), F.col("sensor"), F.lit(".")))
        .when(is_("MAINTENANCE_DUE"), F.concat(F.lit("Schedule maintenance within "), F.floor("life").cast("string"), F.lit(" days: Recalibrate zero/span and clean sensor aperture.")))
        .when(is_("CALIBRATION_RECOMMENDED"), F.format_string("Calibration inspection recommended: Monitor drift trend (%+.3f %s/day).", "drift", "unit"))
        .otherwise("Sensor operating within optimal specifications. Continue routine monitoring."))
    return df.select("station_id", "ordinal", "sensor", "instrument_model", "total_expected", "total_received", half_even("completeness", 2).alias("completeness_pct"), half_even("bias", 3).alias("current_bias"),
        half_even("drift", 4).alias("drift_rate_per_day"), half_even("noise", 3).alias("noise_std"), half_even("variance", 4).alias("noise_variance"), half_even("days", 1).alias("days_since_calibration"), "calibration_status", "anomaly_incidents",
        *(half_even(f"s_{k}", 1).alias(f"{k}_subscore") for k in WEIGHTS), half_even("score", 1).alias("health_score"),
        F.when(s >= 90.0, "EXCELLENT").when(s >= 75.0, "GOOD").when(s >= 60.0, "FAIR").when(s >= 40.0, "DEGRADED").otherwise("CRITICAL").alias("health_grade"),
        degraded.alias("is_degraded"), half_even("life", 1).alias("predicted_rul_days"), "maintenance_status", action.alias("recommended_action"))


def maintenance_alerts(metrics: DataFrame) -> DataFrame:
    """What needs doing, by urgency: sort by urgency_rank and ordinal."""
    is_ = lambda x: F.col("maintenance_status") == x
    urgency = F.when(is_("URGENT_ACTION_REQUIRED"), "URGENT").when(is_("MAINTENANCE_DUE"), "HIGH").when(is_("CALIBRATION_RECOMMENDED"), "MEDIUM")
    shown = lambda x: F.col(x).cast("string")
    reason = (F.when(is_("URGENT_ACTION_REQUIRED"), F.concat(F.lit("Health Score Critical ("), shown("health_score"), F.lit("%) | Bias ("), F.format_string("%+.2f", "current_bias"), F.lit(") exceeds limits | RUL: "), shown("predicted_rul_days"), F.lit(" days")))
        .when(is_("MAINTENANCE_DUE"), F.concat(F.lit("Sensor Degraded ("), shown("health_score"), F.lit("%) | RUL: "), shown("predicted_rul_days"), F.lit(" days | Drift: "), F.format_string("%+.3f", "drift_rate_per_day"), F.lit("/day")))
        .otherwise(F.concat(F.lit("Calibration interval expiring ("), shown("days_since_calibration"), F.lit(" days elapsed) | Status: "), F.col("calibration_status"))))
    rank = F.when(urgency == "URGENT", 1).when(urgency == "HIGH", 2).otherwise(3)
    return metrics.where("maintenance_status <> 'NORMAL'").select("station_id", "ordinal", "sensor", "instrument_model", urgency.alias("urgency"), rank.alias("urgency_rank"), reason.alias("trigger_reason"),
        F.col("health_score").alias("current_health_score"), "predicted_rul_days", F.col("recommended_action").alias("action_instructions"))


def station_average(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("station_id").agg(half_even(F.avg("health_score"), 1).alias("average_health"))
