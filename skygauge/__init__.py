"""Weather-station telemetry on Spark; see README.md. Names are loaded when they are first used."""

from __future__ import annotations

import importlib

#: What users call, by task: where each name lives.
_NAMES = {
    # readings in
    "read": "sources.readings", "normalise": "sources.readings", "stations": "sources.readings", "profiles": "sources.readings", "weather": "sources.synthetic", "drift": "sources.synthetic", "WeatherConfig": "sources.synthetic",
    # thresholds
    "PhysicsThresholds": "functions.config", "StatisticalThresholds": "functions.config", "CleaningConfig": "functions.config", "KalmanConfig": "functions.config", "RuleLimits": "functions.config", "SensorProfile": "functions.config",
    # quality control and its reports
    "QualityConfig": "plans.telemetry", "flagged": "plans.telemetry", "quality_control": "plans.telemetry", "unified": "operators.clean", "channel_summary": "operators.report", "physics_counts": "operators.report",
    "statistical_counts": "operators.report", "overall": "operators.report", "incidents": "operators.report", "roll_up": "operators.report", "channel_parts": "operators.incremental", "health_parts": "operators.incremental", "health_measures": "operators.incremental", "top_incidents": "operators.report",
    # tracking
    "track": "operators.kalman", "intervals": "operators.kalman", "views": "operators.kalman", "evaluation": "operators.kalman",
    # detection, correction, alerts
    "violations": "operators.rules", "fuse": "operators.rules", "alerts": "operators.rules", "point_features": "operators.features", "ForestConfig": "operators.iforest", "SequenceConfig": "operators.sequence", "detect": "plans.telemetry",
    "correct_and_alert": "plans.telemetry", "recurrence": "operators.correction", "search": "operators.correction", "inject": "operators.injection",
    # health
    "measures": "operators.health", "score": "operators.health", "maintenance_alerts": "operators.health", "station_average": "operators.health",
    # dashboards
    "live_buffer": "operators.serving", "history": "operators.serving", "overview": "operators.serving", "metrics": "operators.serving", "shaded": "operators.serving", "agreement": "operators.serving",
    # streams
    "read_stream": "streaming.live", "track_stream": "streaming.live", "recurrence_stream": "streaming.live", "windowed_counts": "streaming.live", "with_references": "streaming.live", "latest": "streaming.live", "buffer_stream": "streaming.live",
    "released": "streaming.lookahead", "flag_batches": "streaming.lookahead", "filled": "streaming.lookahead", "append_alerts": "streaming.alertlog", "read_log": "streaming.alertlog", "compacted": "streaming.alertlog",
    # results out
    "to_csv": "sources.sinks", "to_json": "sources.sinks", "to_json_array": "sources.sinks", "to_parquet": "sources.sinks", "exports": "sources.sinks", "tracking_table": "sources.sinks", "quality_report": "render", "health_dashboard": "render", "alert_dashboard": "render",
    # storage between steps
    "stored": "plans.scratch", "release": "plans.scratch", "temporary": "plans.scratch",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str) -> object:
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), name)


def __dir__() -> list[str]:
    return [*globals(), *__all__]
