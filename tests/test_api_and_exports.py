"""The public names, exports and renderers."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import skygauge
from skygauge import render
from skygauge.operators import health, kalman
from skygauge.plans import scratch
from skygauge.sources import readings, sinks, synthetic


def test_every_public_name_is_there():
    assert len(skygauge.__all__) >= 42 and all(getattr(skygauge, name) is not None for name in skygauge.__all__) and set(skygauge.__all__) <= set(dir(skygauge))
    with pytest.raises(AttributeError):
        skygauge.nothing


def test_the_public_names_make_a_whole_run(spark, tmp_path):
    config = skygauge.WeatherConfig(days=1, minutes=10)
    df = skygauge.weather(spark, config)
    controlled = skygauge.stored(skygauge.quality_control(df))
    frames = sinks.quality_exports(controlled)
    assert set(frames) == {"raw", "cleaned", "flags", "full", "incident_log"}
    paths = skygauge.exports(frames, str(tmp_path / "quality"))
    counts = [spark.read.option("header", True).csv(p).count() for p in paths]
    assert counts[:4] == [144] * 4 and counts[4] == skygauge.incidents(controlled).count()
    events = skygauge.detect(df, detectors=False)
    found = sinks.detection_exports(events)
    assert found["hybrid_results"].count() == 144
    skygauge.exports(found, str(tmp_path / "hybrid"), "json")
    assert spark.read.json(f"{tmp_path}/hybrid/hybrid_results").count() == 144
    scores = skygauge.score(skygauge.measures(df), skygauge.profiles(spark))
    skygauge.exports(sinks.health_exports(scores), str(tmp_path / "health"), "parquet")
    assert spark.read.parquet(f"{tmp_path}/health/health_metrics").count() == 4
    for text in (True, False):
        shown = render.health_dashboard(scores, 0, text)
        assert all(name in shown for name in ("Temperature", "Pressure", "Humidity", "Wind_speed")) and shown.count("█") > 4


def test_what_is_stored_in_a_block_goes_with_it(spark, tmp_path):
    import os

    outside = scratch.stored(spark.range(5))
    with skygauge.temporary(spark):
        inside = scratch.stored(spark.range(7))
        with skygauge.temporary(spark):
            nested = scratch.stored(inside)
            nested.write.parquet(str(tmp_path / "kept"))
        assert inside.count() == 7 and not os.path.exists(nested.inputFiles()[0].removeprefix("file://"))
    assert not os.path.exists(inside.inputFiles()[0].removeprefix("file://")) and outside.count() == 5 and spark.read.parquet(str(tmp_path / "kept")).count() == 7


def test_tracking_table(spark):
    made = synthetic.drift(spark, "linear_ramp", synthetic.WeatherConfig(days=0.5, inject=False))
    out = sinks.tracking_table(kalman.track(made["observed"], made["references"]), made)
    assert len(out.columns) == 2 + 31 and out.count() == 144
    row = out.where("row_id = 7").first()
    truth, seen = made["true"].where("row_id = 7").first(), made["observed"].where("row_id = 7").first()
    assert row.rh_true_ground_truth == truth.humidity and row.wind_observed_drifted == seen.wind_speed and row.temp_true_ci95_lower < row.temp_true_estimated < row.temp_true_ci95_upper


def test_scenarios(spark):
    """Normal weather, drift, several faults at once, gaps and extremes, through the whole correction plan."""
    calm = synthetic.WeatherConfig(days=1, minutes=10, inject=False)
    base = synthetic.weather(spark, calm)
    changes = {
        "normal": {}, "drift": {"temperature": F.col("temperature") + F.col("row_id") * 0.02}, "several": {"humidity": F.when(F.col("row_id").between(50, 60), 140.0).otherwise(F.col("humidity")), "wind_speed": F.when(F.col("row_id").between(55, 65), -3.0).otherwise(F.col("wind_speed"))},
        "gaps": {"pressure": F.when(F.col("row_id").between(30, 90), None).otherwise(F.col("pressure"))}, "extreme": {"temperature": F.lit(59.5), "wind_speed": F.lit(70.0)}}
    frames = [base.withColumns(change | {"station_id": F.lit(i)}) for i, change in enumerate(changes.values())]
    out = skygauge.correct_and_alert(reduce(DataFrame.unionByName, frames), detectors=False)
    corrected, alerts = out["corrected"].collect(), out["alerts"].collect()
    for i, name in enumerate(changes):
        own, raised = [r for r in corrected if r.station_id == i], [r for r in alerts if r.station_id == i]
        assert len(own) == 144
        if name in ("normal", "drift", "gaps"):
            assert not raised
        if name == "several":
            assert {r.anomaly_type.partition(" ")[0] for r in raised} == {"THERMODYNAMIC_VIOLATION", "SENSOR_SPEC_BREACH"} and len(raised) == 16
        if name == "gaps":
            assert sum(r.pressure_corrected is None for r in own) == 61
        if name == "extreme":
            assert len(raised) == 144 and {r.severity for r in raised} <= {"WARNING", "CRITICAL"}


def test_stored_tables_go_when_they_are_released(spark, tmp_path):
    import os

    df = scratch.stored(spark.range(10))
    assert df.count() == 10
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    scratch.release()
    assert not os.path.exists(path)
    assert scratch.stored(spark.range(3)).count() == 3
    assert health.station_average(health.score(health.measures(synthetic.weather(spark, synthetic.WeatherConfig(days=0.5))), readings.profiles(spark))).count() == 1
