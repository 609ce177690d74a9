"""Reports from parts by day against those of the whole history; the alert log against one numbering of all."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS
from skygauge.operators import correction, health, incremental, report
from skygauge.plans import telemetry
from skygauge.sources import synthetic
from skygauge.streaming import alertlog


@pytest.fixture(scope="module")
def history(spark):
    """Two stations, five days, with a day without humidity, sentinels, biases and residuals that come and go."""
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=5, minutes=30, stations=2))
    n = F.col("row_id")
    df = df.withColumns({"humidity": F.when(~n.between(48, 95), F.col("humidity")), "pressure": F.when(n % 17 == 3, -999.0).otherwise(F.col("pressure"))})
    df = df.withColumns({f"{c}_bias": F.when(n % 5 != i, 0.1 * i + 0.01 * n + 1000.0 * (i == 1)) for i, c in enumerate(CHANNELS)})
    df = df.withColumns({f"{c}_post_fit_residual": F.when((n % 3 != 0) & (F.lit(i) < 2), F.sin(n * (i + 1.0)) + 1e6) for i, c in enumerate(CHANNELS)})
    return spark.createDataFrame(df.collect(), df.schema)


def near(a, b):
    return a == b or a is not None and b is not None and abs(a - b) <= 1e-6 * max(1.0, abs(a))


def test_health_measures_of_days_are_those_of_the_whole(spark, history):
    expected = {(r.station_id, r.sensor): r for r in health.measures(history).collect()}
    days = [F.to_date("ts") == F.lit(datetime.date(2026, 1, 1 + k)) for k in range(5)]
    parts = incremental.health_parts(history.where(days[0]))
    for day in days[1:]:
        parts = parts.union(incremental.health_parts(history.where(day)))
    got = {(r.station_id, r.sensor): r for r in incremental.health_measures(parts).collect()}
    assert set(got) == set(expected) and len(got) == 8
    for k, r in expected.items():
        assert all(near(r[c], got[k][c]) if isinstance(r[c], float) else r[c] == got[k][c] for c in expected[k].__fields__), (k, r, got[k])


def test_noise_without_residuals_takes_the_steps_between_days(spark, history):
    bare = history.select("station_id", "row_id", "ts", *CHANNELS)
    expected = {(r.station_id, r.sensor): r.noise for r in health.measures(bare).collect()}
    got = {(r.station_id, r.sensor): r.noise for r in incremental.health_measures(incremental.health_parts(bare)).collect()}
    assert all(near(v, got[k]) for k, v in expected.items()) and min(expected.values()) > 0
    assert incremental.health_measures(incremental.health_parts(bare.where("false"))).count() == 0


def test_channel_summary_of_days(spark, history):
    flagged = telemetry.flagged(history)
    parts = [incremental.channel_parts(flagged.where(f"row_id % 240 {x} 100")) for x in ("<", ">=")]  # a day may come in two parts
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(incremental.channel_summary(parts[0].union(parts[1]))) == key(report.channel_summary(flagged))


def alerts_of(spark, n):
    rng, at, rows = random.Random(n), datetime.datetime(2026, 3, 1), []
    for i in range(n):
        at += datetime.timedelta(minutes=rng.randrange(600))
        rows.append((rng.choice([0, 1, None]), i, at, rng.choice(["A", "B"]), rng.choice([["t"], ["p", "t"], []])))
    return spark.createDataFrame(rows, "station_id int, row_id long, ts timestamp, anomaly_type string, sensors array<string>")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    alerts, at = alerts_of(spark, 120), str(tmp_path / "log")
    expected = sorted(map(repr, correction.recurrence(correction.number_alerts(alerts)).select("station_id", "row_id", "alert_id", "earlier", "historical_context").collect()))
    put = alertlog.append_alerts(at)
    shown = lambda: sorted(map(repr, alertlog.read_log(spark, at).select("station_id", "row_id", "alert_id", "earlier", "historical_context").collect()))
    assert alertlog.read_log(spark, at) is None
    batches = [alerts.where(f"row_id BETWEEN {a} AND {b}") for a, b in ((0, 29), (30, 69), (200, 300), (70, 119))]
    for n, batch in enumerate(batches):
        put(batch, n)
        put(batch, n)
        if n == 1:
            alertlog.compacted(spark, at, 1)
            alertlog.compacted(spark, at, 1)
            put(batches[2], 2)
    assert shown() == expected and sorted(x for x in os.listdir(at) if not x.startswith(".")) == ["base-1", "batch-3"]
    os.makedirs(f"{at}/base-3")  # a compaction that failed before its end
    assert shown() == expected
    alertlog.compacted(spark, at, 3)
    assert shown() == expected and sorted(x for x in os.listdir(at) if not x.startswith(".")) == ["base-3"]
