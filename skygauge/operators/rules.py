"""Rules on single readings, as an array of violations in each row, and their fusion with detectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions import thermo
from skygauge.functions.config import CHANNELS, RuleLimits
from skygauge.functions.rounding import fixed, half_even
from skygauge.operators.physics import sure
from skygauge.operators.statistical import flag

#: Each rule's texts, by severity.
RULE_NAMES = {
    "THERMO_TD_EXCEEDS_T": "Dew Point Exceeds Temperature",
    "THERMO_VAPOR_EXCEEDS_PRESSURE": "Vapor Pressure Exceeds Ambient Pressure",
    "THERMO_RH_OUT_OF_BOUNDS": "Unphysical Relative Humidity",
    "SPEC_WIND_NEGATIVE": "Negative Wind Speed",
    "SPEC_WIND_EXCEEDS_RANGE": "Wind Speed Exceeds Typical Specification",
    "SPEC_TEMP_EXCEEDS_RANGE": "Temperature Outside Operating Limits",
    "SPEC_PRESSURE_EXCEEDS_RANGE": "Pressure Outside Operating Limits",
}
ACTIONS = {
    "THERMO_TD_EXCEEDS_T": "Emergency calibration required: Inspect hygrometer sensing element and aspirator fan",
    "THERMO_VAPOR_EXCEEDS_PRESSURE": "Isolate barometer and RH sensor channels; check for sensor chamber flooding",
    "THERMO_RH_OUT_OF_BOUNDS": "Recalibrate or replace capacitive humidity sensor element; inspect for condensation or saline coating",
    "SPEC_WIND_NEGATIVE": "Inspect anemometer wiring, zero-offset calibration, and ADC voltage reference",
    "SPEC_WIND_EXCEEDS_RANGE": "Verify severe weather event / gust recording; inspect anemometer bearing for mechanical damage",
    "SPEC_TEMP_EXCEEDS_RANGE": "Inspect radiation shield ventilation and RTD/thermistor wiring integrity",
    "SPEC_PRESSURE_EXCEEDS_RANGE": "Inspect barometric pressure port for insect blockage or static port leakage",
}
#: For kinds of statistical flags their rule, name, alert level, confidence, description and action.
STATISTICAL = (
    ("spike", "STAT_SPIKE_", "Transient Rate-of-Change Spike", "INFO", 0.75, "Rapid rate-of-change spike detected in {}", "Apply median smoothing filter; monitor channel for recurring transient spikes"),
    ("stuck", "STAT_FLATLINE_", "Sensor Output Flatline", "WARNING", 0.82, "Frozen sensor: reading remained constant with zero variance", "Check sensor power line and communication bus (SDI-12 / Modbus / RS-485)"),
    ("outlier", "STAT_OUTLIER_", "Statistical Distribution Outlier", "INFO", 0.68, "Reading is an excursion beyond normal statistical distribution", "Flag for automated quality control review; cross-check with nearby weather stations"),
)
LEVEL = {"HIGH": "CRITICAL", "MEDIUM": "WARNING"}


def _violation(rule: str, name: str, severity: str, level: str, sensors: list[str], confidence: float, description: Column, action: str) -> Column:
    lit = F.lit
    return F.struct(lit(rule).alias("rule_id"), lit(name).alias("rule_name"), lit(severity).alias("severity"), lit(level).alias("alert_level"),
        F.array(*map(lit, sensors)).alias("affected_sensors"), lit(confidence).alias("confidence"), description.alias("description"), lit(action).alias("recommended_action"))


def violations(df: DataFrame, limits: RuleLimits | None = None, statistical: bool = True) -> DataFrame:
    """df with `violations`, in the order of the rules. statistical: also the flags that df has."""
    limits = limits or RuleLimits()
    t, p, rh, ws = (F.col(c) for c in CHANNELS)
    e, td = thermo.vapor_pressure(t, rh), thermo.dew_point(t, rh)

    def text(pattern: str, *numbers: Column) -> Column:
        """pattern with the numbers in place of its %.1f or %.2f."""
        kinds = re.findall(r"%\.(\d)f", pattern)
        return F.format_string(re.sub(r"%\.\df", "%s", pattern), *(fixed(x, int(n)) for n, x in zip(kinds, numbers, strict=True)))

    found: list[Column] = []

    def rule(name: str, severity: str, sensors: list[str], confidence: float, condition: Column, description: Column) -> None:
        found.append(F.when(condition, _violation(name, RULE_NAMES[name], severity, LEVEL[severity], sensors, confidence, description, ACTIONS[name])))

    rule("THERMO_TD_EXCEEDS_T", "HIGH", ["temperature", "humidity"], 0.98, td > t + limits.dew_point_tolerance,
        text("Thermodynamic violation: Calculated Dew Point (%.1f°C) exceeds Dry Bulb Temp (%.1f°C)", td, t))
    rule("THERMO_VAPOR_EXCEEDS_PRESSURE", "HIGH", ["pressure", "humidity"], 0.99, e >= p,
        text("Thermodynamic violation: Water vapor pressure (%.1f hPa) exceeds ambient barometric pressure (%.1f hPa)", e, p))
    rule("THERMO_RH_OUT_OF_BOUNDS", "HIGH", ["humidity"], 0.97, t.isNotNull() & ((rh < 0.0) | (rh > limits.rh_max)),
        text("Relative Humidity (%.1f%%) is outside physical limits [0%%, 105%%]", rh))
    rule("SPEC_WIND_NEGATIVE", "MEDIUM", ["wind_speed"], 0.95, ws < 0.0, text("Negative wind speed measured (%.2f m/s)", ws))
    rule("SPEC_WIND_EXCEEDS_RANGE", "MEDIUM", ["wind_speed"], 0.88, ws > limits.wind_max, text("Wind speed (%.1f m/s) exceeds typical 50 m/s sensor specification", ws))
    rule("SPEC_TEMP_EXCEEDS_RANGE", "MEDIUM", ["temperature"], 0.92, (t < limits.temperature_min) | (t > limits.temperature_max),
        text(f"Temperature (%.1f°C) exceeds operating specifications [{limits.temperature_min}°C, {limits.temperature_max}°C]", t))
    rule("SPEC_PRESSURE_EXCEEDS_RANGE", "MEDIUM", ["pressure"], 0.92, (p < limits.pressure_min) | (p > limits.pressure_max),
        text(f"Pressure (%.1f hPa) exceeds station operating specifications [{limits.pressure_min} hPa, {limits.pressure_max} hPa]", p))
    if statistical:
        for c in CHANNELS:
            for kind in ("iqr_outlier", "zscore_outlier", "spike", "stuck"):
                column = flag(c, kind)
                if column in df.columns:
                    end, prefix, name, level, confidence, description, action = next(s for s in STATISTICAL if kind.endswith(s[0]))
                    sensor = column.removeprefix("flag_").removesuffix(f"_{end}")
                    found.append(F.when(F.col(column), _violation(prefix + column.upper(), name, "LOW", level, [sensor], confidence, F.lit(description.format(column)), action)))
    return df.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))


def exploded(df: DataFrame) -> DataFrame:
    """A row for each violation, seq from 0 in a row's order."""
    return df.select("station_id", "row_id", "ts", F.posexplode("violations").alias("seq", "v")).select("station_id", "row_id", "ts", "seq", "v.*")


def _first(severity: str) -> Column:
    return F.get(F.filter("violations", lambda v: v["severity"] == severity), F.lit(0))


def fuse(df: DataFrame) -> DataFrame:
    """df with one event a row, of the first cause that applies.

    df has violations, and of the detectors iforest_flag, iforest_conf, lstm_flag, lstm_conf
    and lstm_errors (by channel); columns that are absent count as quiet.
    """
    quiet = {"iforest_flag": F.lit(False), "iforest_conf": F.lit(0.0), "lstm_flag": F.lit(False), "lstm_conf": F.lit(0.0), "lstm_errors": F.array(*(F.lit(0.0) for _ in CHANNELS))}
    df = df.withColumns({k: v for k, v in quiet.items() if k not in df.columns})
    lit = F.lit
    # Columns of their own, so that a row's violations are looked through once for each and not for each field of its event.
    levels = ("HIGH", "MEDIUM", "LOW")
    first = {level: F.col(f"_first_{level}") for level in levels}
    df = df.withColumns({f"_first_{level}": _first(level) for level in levels})
    i, ic, s, sc = (F.col(x) for x in ("iforest_flag", "iforest_conf", "lstm_flag", "lstm_conf"))
    worst = F.array_max(F.array(*(F.struct(F.get("lstm_errors", lit(n)).alias("e"), lit(-n).alias("o"), lit(c).alias("name")) for n, c in enumerate(CHANNELS))))["name"]

    def event(kind: Column, severity: str, confidence: Column, sensors: Column, action: Column, description: Column) -> Column:
        return F.struct(kind.alias("anomaly_type"), lit(severity).alias("severity"), half_even(confidence, 3).alias("confidence"),
            sensors.alias("sensors"), action.alias("recommended_action"), description.alias("description"))

    def by_rule(severity: str, label: str, level: str, least: float) -> Column:
        v = first[severity]
        return event(F.concat(lit(f"{label} ("), v["rule_id"], lit(")")), level, F.greatest(v["confidence"], lit(least)), v["affected_sensors"], v["recommended_action"], v["description"])

    everything = F.array(*map(lit, CHANNELS))
    chosen = (
        F.when(first["HIGH"].isNotNull(), by_rule("HIGH", "THERMODYNAMIC_VIOLATION", "CRITICAL", 0.95))
        .when(first["MEDIUM"].isNotNull(), by_rule("MEDIUM", "SENSOR_SPEC_BREACH", "WARNING", 0.88))
        .when(i & s, event(lit("TEMPORAL_MULTIVARIATE_ANOMALY"), "WARNING", (ic + sc) / 2, F.array(worst),
            F.concat(lit("Deep inspection required: Temporal pattern and multi-sensor correlation deviation in "), worst),
            lit("Dual ML model consensus: Temporal sequence reconstruction error (LSTM) and multi-variate feature isolation (IForest) flagged anomalous pattern")))
        .when(s & (sc >= 0.70), event(lit("TEMPORAL_SEQUENCE_DISTORTION"), "WARNING", sc, F.array(worst),
            F.concat(lit("Inspect time-series trajectory of "), worst, lit("; check for sudden rate-of-change distortion or sensor drift")), lit("LSTM Autoencoder reconstruction error exceeded 3-sigma baseline")))
        .when(i & (ic >= 0.70), event(lit("MULTIVARIATE_OUTLIER"), "WARNING", ic, everything,
            lit("Inspect multi-sensor correlation matrix; check for abnormal atmospheric coupling"), lit("Isolation Forest identified rare multi-dimensional feature combination")))
        .when(first["LOW"].isNotNull(), by_rule("LOW", "STATISTICAL_OUTLIER", "INFO", 0.0))
        .otherwise(event(lit("NORMAL"), "NORMAL", 1.0 - F.greatest(ic, sc), F.array().cast("array<string>"), lit("Normal operational routine"), lit("Nominal sensor operation within physical and statistical bounds"))))
    # Apart from the event: where rows are chosen by it, Spark puts its whole expression in place of its name.
    some = sure(F.exists("violations", lambda v: v["severity"].isin(*levels))) | sure(i & s) | sure(s & (sc >= 0.70)) | sure(i & (ic >= 0.70))
    df = df.withColumns({"is_anomaly": some, "_e": chosen}).select("*", "_e.*").drop("_e", *(f"_first_{level}" for level in levels))
    return df.withColumns({"iforest_conf": half_even("iforest_conf", 3), "lstm_conf": half_even("lstm_conf", 3),
        "affected_sensors": F.when(F.size("sensors") > 0, F.array_join("sensors", ", ")).otherwise("None")})


def severity_rank(x: Column) -> Column:
    """1 for INFO and what isn't known, 2 for WARNING, 3 for CRITICAL."""
    return F.when(x == "CRITICAL", 3).when(x == "WARNING", 2).otherwise(1)


def alerts(fused: DataFrame, at_least: str = "INFO") -> DataFrame:
    """The anomalous events of that severity or a higher one."""
    return fused.where(F.col("is_anomaly") & (severity_rank(F.col("severity")) >= severity_rank(F.lit(at_least.upper()))))
