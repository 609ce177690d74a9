"""Reports as Markdown or plain text, from small results: a row a sensor, or the first few alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bar(score: float, width: int = 10) -> str:
    """A progress bar of a score out of 100."""
    full = max(0, min(width, round(score / 100.0 * width)))
    return "█" * full + "░" * (width - full)


def capitalised(x: str) -> str:
    return x[:1].upper() + x[1:].lower()


def markdown_table(rows: list, columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])


def quality_report(overall: DataFrame, channels: DataFrame, physics: DataFrame, statistical: DataFrame, log: DataFrame, station: int, top: int = 25, text: bool = False) -> str:
    """One station's quality report, with its first `top` incidents."""
    of = lambda df: df.where(F.col("station_id") == station)
    o = of(overall).first()
    if o is None:
        return "No records."
    rows = [r.asDict() | {"sensor": capitalised(r["sensor"])} for r in of(channels).orderBy("sensor").collect()]
    counts = [*of(physics).collect(), *of(statistical).collect()]
    first = of(log).orderBy("ts", "row_id", "seq").limit(top).collect()
    head = [f"Total records: {o['total_records']:,}", f"Time range: {o['time_start']} to {o['time_end']}", f"Clean yield: {o['valid_percent']:.2f}%", f"Missing rate: {o['missing_percent']:.2f}%", f"Anomaly rate: {o['anomaly_percent']:.2f}%"]
    if text:
        return "\n".join(["DATA QUALITY REPORT", *head, *(f"  {r['name']}: {r['n']}" for r in counts), *(f"  [{r['ts']}] {r['sensor']} {r['category']}: {r['description']}" for r in first)])
    names = [c for c in channels.columns if c != "station_id"]
    return "\n\n".join(["# Data quality report", "\n".join(f"- {x}" for x in head), "## Channels", markdown_table(rows, names), "## Counts", markdown_table(counts, ["name", "n"]),
        f"## First {len(first)} incidents", markdown_table(first, ["ts", "sensor", "observed", "category", "rule", "description"])])


def health_dashboard(metrics: DataFrame, station: int, text: bool = False) -> str:
    rows = [r.asDict() for r in metrics.where(F.col("station_id") == station).orderBy("ordinal").collect()]
    shown = [r | {"sensor": capitalised(r["sensor"]), "bar": bar(r["health_score"])} for r in rows]
    if text:
        return "\n".join(["SENSOR HEALTH", *(f"{r['sensor']:<12}{r['bar']} {r['health_score']:5.1f} {r['health_grade']:<10}bias {r['current_bias']:+.3f}  noise {r['noise_std']:.3f}  life {r['predicted_rul_days']:.1f} days  {r['maintenance_status']}" for r in shown),
            *(f"  {r['sensor']}: {r['recommended_action']}" for r in shown if r["maintenance_status"] != "NORMAL")])
    table = markdown_table(shown, ["sensor", "instrument_model", "health_score", "bar", "health_grade", "completeness_pct", "current_bias", "noise_std", "calibration_status", "predicted_rul_days", "maintenance_status"])
    return "\n\n".join(["# Sensor health", table, *(f"- **{r['sensor']}**: {r['recommended_action']}" for r in shown)])


def alert_dashboard(alerts: DataFrame, metrics: DataFrame, station: int, text: bool = False) -> str:
    """Counts by severity, the first 20 alerts (6 as plain text) and the sensors' health."""
    own = alerts.where(F.col("station_id") == station)
    counts = {r["severity"]: r["count"] for r in own.groupBy("severity").count().collect()}
    first = own.orderBy("alert_seq").limit(6 if text else 20).collect()
    health = metrics.where(F.col("station_id") == station).orderBy("ordinal").collect()
    head = ", ".join(f"{k}: {counts.get(k, 0)}" for k in ("CRITICAL", "WARNING", "INFO"))
    if text:
        return "\n".join(["REAL-TIME ALERTS", head, *(f"{r['sensor']}: {bar(r['health_score'])} {r['health_score']}" for r in health), *(f"[{r['severity']}] {r['alert_id']} {r['anomaly_type']}: {r['recommended_action']}" for r in first)])
    rows = [r.asDict() | {"affected_parameters": ", ".join(r["affected_parameters"])} for r in first]
    return "\n\n".join(["# Real-time alerts", head, markdown_table(rows, ["alert_id", "ts", "severity", "anomaly_type", "affected_parameters", "raw_reading", "corrected_estimate", "confidence_score", "historical_context"]),
        "## Sensors", markdown_table([r.asDict() | {"bar": bar(r["health_score"])} for r in health], ["sensor", "health_score", "bar", "health_grade"])])
