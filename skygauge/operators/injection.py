"""Faults injected into a corrected series at a row, as projections, and the alert each raises."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Injection:
    channel: str
    value: float
    added: bool
    rows: int
    corrected: bool
    severity: str
    kind: str
    unit: str
    confidence: float
    action: str
    context: str


#: The four faults.
INJECTIONS = {
    "temp_spike": Injection("temperature", 15.0, True, 1, True, "WARNING", "TRANSIENT_SPIKE (TEMP_JUMP)", "°C", 0.95,
        "Inspect temperature sensor for transient measurement spike and verify against nearby observations.", "Interactive sandbox injection: temperature increased by +15°C."),
    "rh_violation": Injection("humidity", 122.0, False, 1, True, "CRITICAL", "THERMODYNAMIC_VIOLATION (Td > T)", "%", 0.99,
        "Immediately inspect humidity sensor. Relative humidity above 100% indicates a physical consistency violation.", "Interactive sandbox injection: relative humidity forced to 122%."),
    "wind_negative": Injection("wind_speed", -6.5, False, 1, True, "WARNING", "SENSOR_SPEC_BREACH (SPEC_WIND_NEGATIVE)", "m/s", 0.99,
        "Inspect wind-speed sensor and communication channel. Negative wind speed is outside the sensor specification.", "Interactive sandbox injection: wind speed forced to -6.5 m/s."),
    "bias_jump": Injection("pressure", 8.0, True, 21, False, "CRITICAL", "CALIBRATION_STEP_SHIFT (BAROMETER_JUMP)", "hPa", 0.97,
        "Inspect barometric sensor calibration. A persistent pressure offset suggests a calibration step shift.", "Interactive sandbox injection: +8.0 hPa pressure bias applied for {} samples."),
}


def known(kind: str) -> Injection:
    if kind not in INJECTIONS:
        raise ValueError(f"Unknown anomaly type: {kind}")
    return INJECTIONS[kind]


def inject(df: DataFrame, kind: str, at: Column | int, rn: str = "rn") -> DataFrame:
    """df, with {channel}_raw and _corrected and a row number, with a fault from row `at` on (a number, or a column of each station's row)."""
    x = known(kind)
    here = F.col(rn).between(at, (F.lit(at) if isinstance(at, int) else at) + (x.rows - 1))
    raw = F.col(f"{x.channel}_raw")
    new = raw + x.value if x.added else F.lit(x.value)
    out = {f"{x.channel}_raw": F.when(here, new).otherwise(raw)}
    if x.corrected:
        out[f"{x.channel}_corrected"] = F.when(here, new).otherwise(F.col(f"{x.channel}_corrected"))
    marks = {"is_anomaly": F.lit(True), "anomaly_severity": F.lit(x.severity), "anomaly_type": F.lit(x.kind)}
    return df.withColumns(out | {k: F.when(here, v).otherwise(F.col(k)) for k, v in marks.items()})


def next_alert_id(alerts: DataFrame) -> DataFrame:
    """For each station ALERT- and the number after the largest among its alerts' ids, by all digits of an id."""
    digits = F.regexp_replace("alert_id", "[^0-9]", "")
    return alerts.groupBy("station_id").agg(F.format_string("ALERT-%04d", F.coalesce(F.max(F.when(digits != "", digits.cast("long"))), F.lit(0)) + 1).alias("alert_id"))


def alert(injected: DataFrame, kind: str, at: int, ids: DataFrame, rn: str = "rn") -> DataFrame:
    """The alert of an injection, one a station."""
    x = known(kind)
    last = injected.groupBy("station_id").agg((F.count_if(F.col(rn).between(at, at + x.rows - 1))).alias("samples"))
    row = injected.where(F.col(rn) == at).join(last, "station_id").join(ids, "station_id", "left")
    shown = F.concat(F.format_string("%.2f", f"{x.channel}_raw"), F.lit(f" {x.unit}"))
    before, _, after = x.context.partition("{}")
    context = F.concat(F.lit(before), F.col("samples").cast("string"), F.lit(after)) if after else F.lit(x.context)
    return row.select("station_id", F.coalesce("alert_id", F.lit("ALERT-0001")).alias("alert_id"), "ts", F.lit(x.kind).alias("anomaly_type"), F.lit(x.severity).alias("severity"), F.array(F.lit(x.channel)).alias("affected_parameters"),
        shown.alias("raw_reading"), shown.alias("corrected_estimate"), F.lit(x.confidence).alias("confidence_score"), F.lit(x.action).alias("recommended_action"), context.alias("historical_context"))
