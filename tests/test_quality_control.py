"""Physics and statistical flags, cleaning, reports: literal cases, and pandas as a second opinion."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.functions import thermo
from skygauge.functions.config import CHANNELS, CleaningConfig, StatisticalThresholds
from skygauge.operators import clean, physics, report, statistical
from skygauge.plans import chunks, telemetry
from skygauge.sources import readings, sinks, synthetic

START = datetime(2026, 1, 1)
SCHEMA = "station_id int, row_id long, ts timestamp, temperature double, pressure double, humidity double, wind_speed double"


def frame(spark, temperature, pressure=None, humidity=None, wind_speed=None, station=0):
    n = len(temperature)
    rows = zip(temperature, pressure or [1013.25] * n, humidity or [50.0] * n, wind_speed or [5.0] * n)
    return spark.createDataFrame([(station, i, START + timedelta(minutes=5 * i), *x) for i, x in enumerate(rows)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


def grid(n=400, seed=12):
    """Random readings well inside, at and far outside every limit, some of them missing."""
    rng = np.random.default_rng(seed)
    pick = lambda low, high, edges: [None if rng.random() < 0.06 else float(rng.choice(edges)) if rng.random() < 0.2 else float(rng.uniform(low, high)) for _ in range(n)]
    return pick(-70, 80, [-50.0, -50.1, 60.0, 60.1, 0.0]), pick(5, 1200, [800.0, 799.9, 1090.0, 1090.1]), pick(-20, 140, [0.0, -0.1, 102.0, 102.1, 100.0]), pick(-10, 120, [0.0, -0.1, 50.0, 50.1, 90.0, 90.1])


def magnus(t, rh):
    """es, e and dew point in plain Python; None where an input is."""
    es = None if t is None else 6.112 * np.exp(17.67 * t / (t + 243.5))
    if t is None or rh is None:
        return es, None, None
    gamma = 17.67 * t / (243.5 + t) + np.log(min(max(rh / 100, 1e-4), 1.5))
    return es, es * max(rh, 0.0) / 100, 243.5 * gamma / (17.67 - gamma)


def test_thermodynamics_on_a_grid(spark):
    t, _, rh, _ = grid()
    df = spark.createDataFrame(list(zip(t, rh)), "t double, rh double")
    out = df.select("t", "rh", thermo.saturation_vapor_pressure(F.col("t")).alias("es"), thermo.vapor_pressure(F.col("t"), F.col("rh")).alias("e"), thermo.dew_point(F.col("t"), F.col("rh")).alias("td")).collect()
    for r in out:
        for found, expected in zip((r.es, r.e, r.td), magnus(r.t, r.rh)):
            assert (found is None) == (expected is None) and (found is None or found == pytest.approx(expected, rel=1e-9, abs=1e-9))
        if r.t is not None and r.rh is not None and 1 <= r.rh <= 100:
            assert r.td <= r.t + 1e-9 and 0 <= r.e <= r.es * (1 + 1e-12)  # air that isn't saturated has its dew point below it


def test_physics_flags_on_a_grid(spark):
    t, p, rh, ws = grid()
    out = physics.check(frame(spark, t, p, rh, ws)).orderBy("row_id").collect()
    less, more = lambda x, y: x is not None and y is not None and x < y, lambda x, y: x is not None and y is not None and x > y
    seen = set()
    for r, (a, b, c, d) in zip(out, zip(t, p, rh, ws)):
        _, e, td = magnus(a, c)
        ah = None if e is None else 216.7 * e / (a + 273.15)
        expected = {
            "flag_rh_out_of_bounds": less(c, 0) or more(c, 102), "flag_dew_point_exceeds_temp": a is not None and more(td, a + 0.5), "flag_vapor_exceeds_pressure": e is not None and b is not None and e >= b,
            "flag_ah_unphysical": less(ah, 0) or more(ah, 60), "flag_temp_out_of_bounds": less(a, -50) or more(a, 60), "flag_pressure_out_of_bounds": less(b, 800) or more(b, 1090),
            "flag_wind_negative": less(d, 0), "flag_wind_exceeds_typical": more(d, 50), "flag_wind_exceeds_extreme": more(d, 90)}
        expected |= {"flag_t_p_rh_physics_violation": any(list(expected.values())[:6]), "flag_wind_physics_violation": less(d, 0) or more(d, 90)}
        assert {k: r[k] for k in expected} == expected
        seen |= {(k, v) for k, v in expected.items()}
    assert len(seen) == 22  # every flag was up and down


def test_what_counts_as_missing(spark):
    limits = StatisticalThresholds()
    rng = np.random.default_rng(5)
    values = [None, float("inf"), float("-inf"), float("nan"), *limits.sentinels, *(s + 0.5 for s in limits.sentinels), *rng.normal(0, 500, 50).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, x double")
    found = column(df.withColumn("m", statistical.missing(F.col("x"), limits.sentinels)), "m")
    assert found == [v is None or not np.isfinite(v) or v in limits.sentinels for v in values] and sum(found) == 4 + len(limits.sentinels)


def test_spikes_and_flatlines_on_random_walks(spark):
    """Against loops over rows: steps from the neighbours, and windows without variance."""
    rng = np.random.default_rng(21)
    x = np.cumsum(rng.normal(0, 2.2, 300)).round(1)
    for at in (40, 41, 120, 200):
        x[at] += rng.choice([-1, 1]) * rng.uniform(4, 14)
    for at, n in ((60, 7), (150, 9), (240, 30)):
        x[at : at + n] = x[at]
    values = [None if rng.random() < 0.03 else float(v) for v in x]
    limits = StatisticalThresholds(stuck_window=8)
    out = statistical.check(frame(spark, values), limits)
    step = limits.max_step["temperature"]
    spike, stuck = [], [False] * 300
    for i, v in enumerate(values):
        gap = lambda j: None if v is None or not 0 <= j < 300 or values[j] is None else abs(v - values[j])  # noqa: B023, E731
        back, forth = gap(i - 1), gap(i + 1)
        spike.append(back is not None and (back > 1.75 * step or (forth is not None and back > step and forth > step)))
        window = values[max(0, i - 7) : i + 1]
        if len(window) == 8 and None not in window and np.var(window, ddof=1) <= 1e-6:
            stuck[i - 7 : i + 1] = [True] * 8
    assert column(out, "flag_temperature_spike") == spike and column(out, "flag_temperature_stuck") == stuck
    assert sum(spike) >= 2 and sum(stuck) >= 20


def noisy(n, seed=0):
    rng = np.random.default_rng(seed)
    x = 20 + np.cumsum(rng.normal(0, 0.3, n)).round(2)
    x[rng.choice(n, n // 20, replace=False)] = -999.0
    x[rng.choice(n, n // 30, replace=False)] += 12
    x[n // 2 : n // 2 + 30] = x[n // 2]
    x = [None if rng.random() < 0.05 else float(v) for v in x]
    return x


def pandas_flags(x):
    s = pd.Series([np.nan if v is None else v for v in x])
    s = s.mask(s.isin([-999, -9999, 999, 9999, -99]))
    middle = s.rolling(24, center=True, min_periods=6).median()
    dev = (s - middle).abs()
    scale = (1.4826 * dev.rolling(24, center=True, min_periods=6).median()).replace(0.0, np.nan)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    still = s.rolling(12, min_periods=12).var() <= 1e-6
    return {
        "zscore_outlier": (dev / scale > 3.5), "iqr_outlier": (s < q1 - 2 * (q3 - q1)) | (s > q3 + 2 * (q3 - q1)),
        "stuck": still[::-1].rolling(12, min_periods=1).max()[::-1].astype(bool),
    }


@pytest.mark.parametrize("rows", [64, 100_000])
def test_row_flags_match_pandas_in_chunks_of_any_size(spark, rows):
    x = noisy(700)
    out = statistical.check(frame(spark, x), chunk_rows=rows)
    for kind, expected in pandas_flags(x).items():
        assert column(out, f"flag_temperature_{kind}") == expected.tolist(), kind
    assert out.count() == 700


@pytest.mark.parametrize("strategy,limit", [("interpolate", 3), ("interpolate", 6), ("ffill", 4), ("bfill", 2), ("none", 6), ("other", 3)])
def test_imputation_matches_pandas(spark, strategy, limit):
    rng = np.random.default_rng(limit)
    x = [None if (i // 13) % 3 == 1 or rng.random() < 0.3 else float(round(rng.normal(), 3)) for i in range(120)]
    df = frame(spark, x)
    df = chunks.numbered(df).withColumn("chunk", F.floor((F.col("rn") - 1) / 16).cast("long"))
    out = clean.imputed({"temperature": F.col("temperature")}, df, CleaningConfig(strategy, limit))
    s = pd.Series([np.nan if v is None else v for v in x])
    expected = {"interpolate": lambda: s.interpolate(method="linear", limit=limit, limit_direction="both"), "ffill": lambda: s.ffill(limit=limit), "bfill": lambda: s.bfill(limit=limit), "none": lambda: s}.get(strategy, lambda: s.interpolate(method="linear", limit=limit))()
    found = column(out, "temperature_filled")
    assert [v is None for v in found] == expected.isna().tolist()
    assert np.allclose([v for v in found if v is not None], expected.dropna())


def test_running_sums_and_numbers(spark):
    df = frame(spark, [float(i) for i in range(50)]).union(frame(spark, [1.0] * 7, station=1))
    df = chunks.numbered(df).withColumn("chunk", F.floor((F.col("rn") - 1) / 8).cast("long"))
    out = chunks.running_sums(df, {"total": F.col("temperature")}).orderBy("station_id", "rn").collect()
    assert [r.rn for r in out] == [*range(1, 51), *range(1, 8)]
    assert [r.total for r in out] == [*np.cumsum(range(50)), *range(1, 8)]


def test_whole_plan_and_report(spark):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=3))
    out = telemetry.quality_control(df).cache()
    assert out.count() == 864
    overall = report.overall(out).first()
    assert 80 < overall.valid_percent < 100 and overall.total_records == 864
    found = {(r.sensor, r.category) for r in report.incidents(out).collect()}
    assert {("temperature", "MISSING"), ("pressure", "MISSING"), ("humidity", "PHYSICS_VIOLATION"), ("wind_speed", "PHYSICS_VIOLATION"), ("temperature", "STUCK"), ("temperature", "SPIKE")} <= found
    valid = out.where("is_valid_temperature").select("temperature", "temperature_cleaned").collect()
    assert all(abs(r.temperature - r.temperature_cleaned) <= 0.0051 for r in valid)
    assert len(clean.unified(out).columns) == 3 + 8 + 4 + 11 + 24 + 5
    summary = {r.sensor: r for r in report.channel_summary(out).collect()}
    assert set(summary) == set(CHANNELS) and summary["temperature"].missing == 3 and summary["pressure"].missing == 5
    from skygauge import render

    text = render.quality_report(report.overall(out), report.channel_summary(out), report.physics_counts(out), report.statistical_counts(out), report.incidents(out), 0)
    assert "Wind_speed" in text and "incidents" in text
    out.unpersist()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = telemetry.quality_control(empty)
    assert out.count() == 0 and report.overall(out).count() == 0 and report.incidents(out).count() == 0


def test_normalise_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01 00:00:00", 1.5, float("nan")), ("bad", None, 3.0)], "time string, t double, rh double")
    out = readings.normalise(df, {"ts": "time", "temperature": "t", "humidity": "rh"}).orderBy("row_id").collect()
    assert out[0].ts == datetime(2026, 1, 1) and out[0].humidity is None and out[1].ts is None and out[0].pressure is None
    wide = spark.createDataFrame([(1, ["a", "b"], START)], "id int, names array<string>, ts timestamp")
    sinks.to_csv(wide, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().names == "a, b"
    sinks.to_json(wide, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().id == 1 and '"names"' in sinks.json_array(wide)
    sinks.to_parquet(frame(spark, [1.0, 2.0]), str(tmp_path / "p"), by=("station_id",))
    assert readings.read(spark, str(tmp_path / "p")).count() == 2


def test_numbers_in_texts_are_rounded_by_their_exact_value(spark):
    from skygauge.functions.rounding import fixed

    numbers = [24.65, -24.65, 0.25, -0.04, -0.0, 0.95, 99.995, 2.675, 0.125, -0.049999999999999996, 2.0**52 + 0.5, -999.0, None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fixed("x", 1).alias("one"), fixed("x", 2).alias("two")).collect()
    assert [(r.one, r.two) for r in rows] == [(None, None) if r.x is None else (f"{r.x:.1f}", f"{r.x:.2f}") for r in rows]


def test_violations_name_the_exact_reading(spark):
    from skygauge.operators import rules

    df = spark.createDataFrame([(0, 1, 24.65, 1013.0, 118.5, 2.0)], "station_id int, row_id long, temperature double, pressure double, humidity double, wind_speed double")
    found = rules.violations(df, statistical=False).first().violations
    assert found[0].description == "Thermodynamic violation: Calculated Dew Point (27.5°C) exceeds Dry Bulb Temp (24.6°C)"
