"""Tracking, rules, fusion, detectors, correction, health, alerts, injection."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge import render
from skygauge.functions.config import CHANNELS, KalmanConfig
from skygauge.functions.rounding import half_even
from skygauge.operators import correction, features, health, iforest, injection, kalman, rules, sequence, serving
from skygauge.plans import chunks, telemetry
from skygauge.plans.scratch import stored
from skygauge.sources import readings, synthetic
from tests.test_quality_control import START, column, frame


def joint_filter(z, ref, dt):
    """All channels in one filter with matrices: the textbook form, as a second opinion."""
    c, n = KalmanConfig(), len(CHANNELS)
    x, p = np.zeros(3 * n), np.zeros((3 * n, 3 * n))
    for i, ch in enumerate(CHANNELS):
        x[3 * i] = 0.0 if np.isnan(z[0, i]) else z[0, i]
        p[3 * i, 3 * i], p[3 * i + 1, 3 * i + 1], p[3 * i + 2, 3 * i + 2] = c.initial_value[ch] ** 2, c.initial_rate**2, c.initial_bias**2
    out = []
    for k in range(len(z)):
        f, q = np.eye(3 * n), np.zeros((3 * n, 3 * n))
        for i, ch in enumerate(CHANNELS):
            a, w, b = 3 * i, c.weather_noise[ch] ** 2, c.bias_noise[ch] ** 2
            f[a, a + 1] = dt[k]
            q[a : a + 2, a : a + 2] = w * np.array([[dt[k] ** 3 / 3, dt[k] ** 2 / 2], [dt[k] ** 2 / 2, dt[k]]])
            q[a + 2, a + 2] = b * dt[k]
        x, p = f @ x, f @ p @ f.T + q
        h, r, y = [], [], []
        for i, ch in enumerate(CHANNELS):
            for value, bias, noise in ((z[k, i], 1.0, c.sensor_noise[ch] ** 2), (ref[k, i], 0.0, c.reference_noise**2)):
                if not np.isnan(value):
                    row = np.zeros(3 * n)
                    row[3 * i], row[3 * i + 2] = 1.0, bias
                    h.append(row), r.append(noise), y.append(value)
        nis = np.nan
        if h:
            h, r, y = np.array(h), np.diag(r), np.array(y) - np.array(h) @ x
            s = h @ p @ h.T + r
            g = p @ h.T @ np.linalg.inv(s)
            x, p, nis = x + g @ y, p - g @ s @ g.T, y @ np.linalg.inv(s) @ y
        out.append((*x, nis))
    return np.array(out)


@pytest.mark.parametrize("chunk_rows", [1024, 16, 1])
def test_kalman_equals_the_joint_filter(spark, chunk_rows):
    rng = np.random.default_rng(1)
    n = 120
    z = np.array([20.0, 1010.0, 60.0, 5.0]) + np.cumsum(rng.normal(0, 0.2, (n, 4)), axis=0)
    z[rng.random((n, 4)) < 0.1] = np.nan
    ref = np.where(rng.random((n, 4)) < 0.05, z + 0.3, np.nan)
    clean = lambda m: [[None if np.isnan(v) else float(v) for v in row] for row in m]
    df = spark.createDataFrame([(3, i, START + timedelta(minutes=5 * i), *row) for i, row in enumerate(clean(z))], frame(spark, [1.0]).schema)
    checks = spark.createDataFrame([(3, i, *row) for i, row in enumerate(clean(ref))], "station_id int, row_id long, temperature double, pressure double, humidity double, wind_speed double")
    got = kalman.track(df, checks, chunk_rows=chunk_rows).orderBy("rn").toPandas()
    expected = joint_filter(z, ref, np.full(n, 5.0))
    for i, c in enumerate(CHANNELS):
        for k, name in enumerate(("true", "rate", "bias")):
            assert np.allclose(got[f"{c}_{name}"], expected[:, 3 * i + k], atol=1e-9)
    assert np.allclose(got["nis"].astype(float), expected[:, -1], equal_nan=True)
    assert set(kalman.views(kalman.track(df))) == {"state", "bias", "residuals", "uncertainty"}


def test_tracking_keeps_large_ids_and_stations_without_one(spark):
    n, big = 60, (1 << 60) + 1
    rows = [(s, big + i, START + timedelta(minutes=5 * i), 20.0 + i % 7, 1000.0, 50.0, 3.0) for s in (0, None) for i in range(n)]
    df = spark.createDataFrame(rows, frame(spark, [1.0]).schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # chunks that span batches
    out = kalman.track(df, chunk_rows=16).select("station_id", "row_id", "temperature_true").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {(r.station_id, r.row_id): r.temperature_true for r in out}
    assert set(by) == {(s, big + i) for s in (0, None) for i in range(n)} and all(by[0, big + i] == by[None, big + i] for i in range(n))


def test_kalman_separates_bias_with_references(spark):
    config = synthetic.WeatherConfig(days=5, inject=False)
    made = synthetic.drift(spark, "step_jump", config)
    out = kalman.evaluation(kalman.track(made["observed"], made["references"]), made["true"], made["biases"]).collect()
    by = {r.sensor: r for r in out}
    assert by["temperature"].filtered_rmse < by["temperature"].raw_rmse and by["pressure"].filtered_rmse < by["pressure"].raw_rmse
    assert by["temperature"].true_final_bias == pytest.approx(2.2) and by["temperature"].estimated_final_bias > 0.8


def test_rules_on_random_readings(spark):
    rng = np.random.default_rng(17)
    n = 300
    t, p, rh, ws = ([None if rng.random() < 0.05 else float(rng.uniform(*span)) for _ in range(n)] for span in ((-60, 70), (5, 1150), (-20, 130), (-10, 70)))
    rows = list(zip(t, p, rh, ws))
    df = spark.createDataFrame([(0, i, START + timedelta(minutes=5 * i), *x) for i, x in enumerate(rows)], frame(spark, [1.0]).schema)
    seen = set()
    for r in rules.violations(df, statistical=False).collect():
        a, b, c, d = rows[r.row_id]
        es = None if a is None else 6.112 * np.exp(17.67 * a / (a + 243.5))
        both = a is not None and c is not None
        gamma = 17.67 * a / (243.5 + a) + np.log(min(max(c / 100, 1e-4), 1.5)) if both else None
        expected = [("THERMO_TD_EXCEEDS_T", both and 243.5 * gamma / (17.67 - gamma) > a + 0.5), ("THERMO_VAPOR_EXCEEDS_PRESSURE", both and b is not None and es * max(c, 0) / 100 >= b),
            ("THERMO_RH_OUT_OF_BOUNDS", both and (c < 0 or c > 105)), ("SPEC_WIND_NEGATIVE", d is not None and d < 0), ("SPEC_WIND_EXCEEDS_RANGE", d is not None and d > 50),
            ("SPEC_TEMP_EXCEEDS_RANGE", a is not None and not -45 <= a <= 55), ("SPEC_PRESSURE_EXCEEDS_RANGE", b is not None and not 850 <= b <= 1080)]
        assert [v.rule_id for v in r.violations] == [k for k, hit in expected if hit]
        seen |= {k for k, hit in expected if hit}
    assert len(seen) == 7


def test_fusion_priorities(spark):
    base = rules.violations(frame(spark, [20.0] * 6, humidity=[120.0, *[50.0] * 5], wind_speed=[5.0, -1.0, 5.0, 5.0, 5.0, 5.0]))
    marks = spark.createDataFrame([(0, True, 0.9, True, 0.9, [0.0, 0.0, 0.0, 1.0]), (1, True, 0.9, True, 0.9, [0.0] * 4), (2, True, 0.6, True, 0.8, [0.1, 0.5, 0.5, 0.2]), (3, False, 0.2, True, 0.75, [0.9, 0.0, 0.0, 0.0]), (4, True, 0.71, False, 0.1, [0.0] * 4), (5, True, 0.6, False, 0.3, [0.0] * 4)],
        "row_id long, iforest_flag boolean, iforest_conf double, lstm_flag boolean, lstm_conf double, lstm_errors array<double>")
    out = rules.fuse(base.join(marks, "row_id")).orderBy("row_id").collect()
    assert [r.severity for r in out] == ["CRITICAL", "WARNING", "WARNING", "WARNING", "WARNING", "NORMAL"]
    assert [r.anomaly_type for r in out[2:]] == ["TEMPORAL_MULTIVARIATE_ANOMALY", "TEMPORAL_SEQUENCE_DISTORTION", "MULTIVARIATE_OUTLIER", "NORMAL"]
    assert out[2].affected_sensors == "pressure" and out[2].confidence == pytest.approx(0.7) and out[4].affected_sensors == ", ".join(CHANNELS)
    assert out[5].confidence == pytest.approx(0.4) and out[5].affected_sensors == "None"
    assert rules.alerts(rules.fuse(base), "critical").count() == 1


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    t = [float(x) for x in 20 + rng.normal(0, 0.5, 400)]
    t[200] = 60.0
    df = frame(spark, t, humidity=[float(x) for x in 50 + rng.normal(0, 1, 400)])
    points = features.point_features(df)
    out = {r.row_id: r for r in iforest.predict(points, iforest.fit(points)).collect()}
    assert out[200].iforest_flag and out[200].iforest_conf > 0.7
    assert 0.005 < np.mean([r.iforest_flag for r in out.values()]) < 0.08
    assert iforest.fit(points.where("false")) is None


def test_autoencoder_gradients_and_detection(spark):
    model = sequence.Autoencoder(config=sequence.SequenceConfig(hidden=3, latent=2))
    model.start(4)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x = np.random.default_rng(0).normal(size=(5, 6, 4))
    y, s = model.forward(x)
    grads = model.gradients(x, y, s)
    for name in ("e1.w", "e2.u", "d1.b", "d2.w", "latent.w", "expand.b", "out.w"):
        index = tuple(0 for _ in model.params[name].shape)
        old, h, loss = model.params[name][index], 1e-2, []
        for shift in (h, -h):
            model.params[name][index] = old + shift
            loss.append(((model.forward(x)[0] - x) ** 2).mean())
        model.params[name][index] = old
        assert grads[name][index] == pytest.approx((loss[0] - loss[1]) / (2 * h), abs=2e-3)
    t = [float(20 + 5 * np.sin(i / 10)) for i in range(400)]
    t[300] = 45.0
    df = frame(spark, t)
    fitted = sequence.fit(df, sequence.SequenceConfig(epochs=4))
    out = {r.row_id: r for r in sequence.predict(df, fitted).collect()}
    assert len(out) == 400 and out[300].lstm_flag and out[300].lstm_conf > 0.7 and not out[5].lstm_flag
    assert out[3].lstm_error == pytest.approx(fitted.base_mean)
    assert sequence.fit(frame(spark, [1.0] * 5)) is None


def test_autoencoder_baseline_is_of_all_sequences(spark):
    t = [float(20 + 5 * np.sin(i / 10)) for i in range(400)]
    t[300] = 45.0
    df = frame(spark, t)
    fitted = sequence.fit(df, sequence.SequenceConfig(epochs=2))
    errors = [r.lstm_error for r in sequence.predict(df, fitted).collect() if r.row_id >= 11]
    assert len(errors) == 389 and fitted.base_mean == pytest.approx(np.mean(errors)) and fitted.base_std == pytest.approx(np.std(errors))


def test_shards_are_averaged_whatever_the_split(spark):
    """Weights are those of a plain loop over shards; the loss over all sequences falls as that of one shard with all of them."""
    rng = np.random.default_rng(2)
    df = frame(spark, [float(20 + 5 * np.sin(i / 10) + rng.normal(0, 0.1)) for i in range(700)])
    config = sequence.SequenceConfig(hidden=6, latent=3, epochs=6, rounds=3, shard_rows=200)
    windows = sequence._windows(df, config)
    one, many = (sequence._trained(df, windows.repartition(n), config) for n in (1, 5))
    assert np.array_equal(one.numbers(), many.numbers())
    rows = [(r.place % 4, r.place, tuple(r.window)) for r in windows.where("window IS NOT NULL").collect()]
    plain = sequence.Autoencoder(mean=one.mean, scale=one.scale, config=config)
    plain.start(4)
    x = plain.scaled([w for *_, w in rows])
    loss = lambda m: float(m.errors(x).mean())
    before = loss(plain)
    for done in (0, 32, 64):
        found = []
        for shard in range(4):
            own = sequence.Autoencoder(dict(plain.params), one.mean, one.scale, config=config)
            own.steps(own.scaled([w for s, _, w in sorted(rows) if s == shard]), done, done + 32, np.random.default_rng([config.seed, done, shard]))
            found.append(own.numbers())
        plain.take(sum(found) / 4)
    assert len(rows) == 689 and np.array_equal(plain.numbers(), one.numbers())
    longer = {"hidden": 6, "latent": 3, "epochs": 30, "rate": 0.01}
    shared, alone = (sequence._trained(df, windows, sequence.SequenceConfig(**longer, **x)) for x in ({"rounds": 6, "shard_rows": 200}, {"rounds": 1}))
    assert loss(shared) < 0.5 * before and loss(shared) < 2 * loss(alone), (before, loss(shared), loss(alone))


def test_an_epoch_goes_through_all_sequences_of_a_shard(spark):
    """Of shards with more batches than an epoch has steps at least: the weights are those of a plain loop that goes through each shard once an epoch."""
    rng = np.random.default_rng(4)
    df = frame(spark, [float(20 + 5 * np.sin(i / 10) + rng.normal(0, 0.1)) for i in range(700)])
    config = sequence.SequenceConfig(hidden=4, latent=2, epochs=4, rounds=2, shard_rows=400, batch=16)
    windows = sequence._windows(df, config)
    fitted = sequence._trained(df, windows, config)
    rows = sorted((r.place % 2, r.place, tuple(r.window)) for r in windows.where("window IS NOT NULL").collect())
    plain, seen = sequence.Autoencoder(mean=fitted.mean, scale=fitted.scale, config=config), {}
    plain.start(4)
    for number in range(2):
        found = []
        for shard in range(2):
            own = sequence.Autoencoder(dict(plain.params), fitted.mean, fitted.scale, config=config)
            x, forward = own.scaled([w for s, _, w in rows if s == shard]), own.forward
            own.forward = lambda b, r=None, f=forward, s=shard: [seen.update({(s, v.tobytes()): seen.get((s, v.tobytes()), 0) + 1}) for v in b] and f(b, r)
            steps = -(-len(x) // 16)
            assert steps > sequence.EPOCH_STEPS
            own.steps(x, 2 * number * steps, 2 * (number + 1) * steps, np.random.default_rng([config.seed, 2 * number * steps, shard]))
            found.append(own.numbers())
        plain.take(sum(found) / 2)
    assert len(seen) == len(rows) == 689 and set(seen.values()) == {config.epochs}
    assert np.array_equal(plain.numbers(), fitted.numbers())


def test_scores_of_missing_and_broken_sequences(spark):
    """Rows without a whole sequence have no errors, and take none of their neighbours'."""
    rng = np.random.default_rng(5)
    whole = [[float(x) for x in rng.normal(size=48)] for _ in range(40)]
    rows = [(i % 2, i, None if i % 7 == 0 else [None, *w[1:]] if i % 5 == 0 else [*w[:-1], float("nan")] if i % 3 == 0 else w) for i, w in enumerate(whole)]
    model = sequence.Autoencoder(mean=np.zeros(4), scale=np.ones(4))
    model.start(4)
    out = {r.row_id: r for r in sequence._scored(spark.createDataFrame(rows, "station_id int, row_id long, window array<double>"), model).collect()}
    for station, i, w in rows:
        assert (out[i].station_id, out[i].short) == (station, w is None)
        expected = None if any(i % k == 0 for k in (7, 5, 3)) else model.errors(model.scaled([w]))[0]
        assert out[i].lstm_errors is None if expected is None else np.allclose(out[i].lstm_errors, expected, atol=1e-5)


def test_corrected_columns_of_random_readings(spark):
    rng = np.random.default_rng(31)
    n = 200
    some = lambda low, high: [None if rng.random() < 0.1 else float(rng.uniform(low, high)) for _ in range(n)]
    data = {c: (some(*span), some(-8, 8), some(0.05, 3)) for c, span in (("temperature", (-55, 65)), ("pressure", (790, 1110)), ("humidity", (-5, 108)), ("wind_speed", (-3, 60)))}
    df = spark.createDataFrame([(i, *(data[c][k][i] for c in CHANNELS for k in range(3))) for i in range(n)], "row_id long, " + ", ".join(f"{c} double, {c}_b double, {c}_s double" for c in CHANNELS))
    out = df
    for c in CHANNELS:
        out = out.withColumns(correction.corrected_columns(c, F.col(c), F.col(f"{c}_b"), F.col(f"{c}_s")))
    held = {"temperature": (-50, 60), "pressure": (800, 1100), "humidity": (0, 100), "wind_speed": (0, np.inf)}
    for r in out.orderBy("row_id").collect():
        for c in CHANNELS:
            raw, bias, sigma = (data[c][k][r.row_id] for k in range(3))
            bias, sigma = 0.0 if bias is None else bias, 0.1 if sigma is None else sigma
            value = None if raw is None else min(max(raw - bias, held[c][0]), held[c][1])
            band = lambda x: min(max(x, held[c][0]), held[c][1]) if c in ("humidity", "wind_speed") else x  # noqa: B023, E731
            expected = [None if value is None else np.round(x, 2) for x in ((value,) if value is None else (value, band(value - 1.96 * sigma), band(value + 1.96 * sigma), band(value - 2.576 * sigma), band(value + 2.576 * sigma)))]
            found = [r[f"{c}_{k}"] for k in ("corrected", "ci95_lower", "ci95_upper", "ci99_lower", "ci99_upper")]
            assert found == (expected if raw is not None else [None] * 5)
            assert r[f"{c}_bias_est"] == np.round(bias, 3) and r[f"{c}_uncertainty_std"] == np.round(sigma, 3)


def test_ties_go_to_the_even_neighbour(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 0.125, 0.375, 2.675, None, -0.001]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, x double").withColumns({"none": half_even("x", 0), "two": half_even("x", 2)})
    for digits, name in ((0, "none"), (2, "two")):
        found = column(out, name)
        assert found == [None if v is None else float(np.round(v, digits)) for v in values] and not any(str(v).startswith("-0.0") for v in found if v == 0)


def brute_recurrence(rows, hours, log=()):
    """rows and log: (station, row_id, ts, type, sensors); how many alike alerts came before each, and the last one's time."""
    order = lambda r: (r[2], r[1])
    out = {}
    for r in rows:
        timed = sorted((x for x in rows if x[2]), key=order)
        before = [x for x in timed if x[0] == r[0] and order(x) < order(r)] if r[2] else []
        before = [x for x in log if x[0] == r[0] and r[2] and x[2] <= r[2]] + before
        alike = [x for x in before if x[2] >= r[2] - timedelta(hours=hours) and ((x[3] is not None and x[3] == r[3]) or set(x[4] or ()) & set(r[4] or ()))]
        out[r[0], r[1]] = (len(alike), max((x[2] for x in alike), default=None))
    return out


@pytest.mark.parametrize("hours", [5, 72])
def test_recurrence_against_brute_force(spark, hours):
    rng = np.random.default_rng(hours)
    day, kinds, names = datetime(2026, 5, 4), ["drift", "jump", "gap", None], [*CHANNELS]
    make = lambda i, at: (int(rng.integers(0, 2)), i, at, kinds[rng.integers(4)], None if rng.random() < 0.05 else [str(x) for x in rng.choice(names, rng.integers(0, 3), replace=False)])
    rows = [make(i, day + timedelta(minutes=int(rng.integers(0, 60 * 200)) // 7 * 7)) for i in range(150)] + [make(900, None), make(901, None)]
    log = [make(1000 + i, day - timedelta(hours=int(rng.integers(1, 90)))) for i in range(40)]
    schema = "station_id int, row_id long, ts timestamp, anomaly_type string, sensors array<string>"
    known = stored(correction.number_alerts(spark.createDataFrame(log, schema)))
    for history in (None, known):
        numbered = stored(correction.number_alerts(spark.createDataFrame(rows, schema), history))
        out = correction.recurrence(numbered, hours, history).collect()
        expected = brute_recurrence(rows, hours, log if history is not None else ())
        assert len(out) == len(rows)
        for r in out:
            n, last = expected[r.station_id, r.row_id]
            text = correction.FIRST_TEXT if n == 0 else correction.SECOND_TEXT.format(time=f"{last:%m-%d %H:%M}") if n == 1 else correction.MORE_TEXT.format(n=n + 1, hours=hours)
            assert (r.earlier, r.historical_context) == (n, text)
        first = min(r.alert_seq for r in out if r.station_id == 0)
        assert first == 1 + (sum(x[0] == 0 for x in log) if history is not None else 0) and all(r.alert_id == f"ALT-{r.alert_seq:04d}" for r in out)


def test_exact_quantile(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(-0.5, 0.1, 5000), np.repeat([-0.7, -0.3], 2500), np.full(3000, -0.25), rng.choice([-0.9, -0.1, -0.1000001], 4000), np.array([-0.5])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for share in (0.04, 0.5, 0.0, 1.0):
            assert iforest.quantile(df, "x", share, -1.0, 0.0, bins=16, few=50) == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_repeated_and_missing_keys_lose_no_reading(spark):
    rows = [(0, 1, START, 20.0, 1000.0, 50.0, 3.0), (0, 1, START + timedelta(minutes=5), 20.5, 1000.0, 130.0, 3.0), (None, 2, START, 21.0, 1001.0, 51.0, -2.0), (None, None, START + timedelta(minutes=5), 21.0, 1001.0, 51.0, 2.0), (0, None, START + timedelta(minutes=9), None, None, None, None)]
    df = spark.createDataFrame(rows, frame(spark, [1.0]).schema)
    events = telemetry.detect(df, detectors=False)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(((r.station_id, r.row_id, r.ts) for r in events.collect()), key=key) == sorted(((r[0], r[1], r[2]) for r in rows), key=key)
    out = telemetry.correct_and_alert(df, detectors=False)
    assert out["corrected"].count() == 5 and out["alerts"].count() == 2 and out["tracked"].count() == 5


def test_health_extremes(spark):
    n = 1000
    rng = np.random.default_rng(0)
    good = frame(spark, [float(x) for x in 20 + rng.normal(0, 0.1, n)]).withColumns({f"{c}_bias": F.lit(0.02) for c in CHANNELS} | {f"{c}_post_fit_residual": F.rand(1) * 0.1 for c in CHANNELS})
    profiles = readings.profiles(spark)
    ok = {r.sensor: r for r in health.score(health.measures(good), profiles, "2026-03-10").collect()}
    assert ok["temperature"].health_score > 85 and ok["temperature"].maintenance_status == "NORMAL" and ok["temperature"].completeness_pct == 100.0
    bad = good.withColumns({"temperature": F.when(F.col("row_id") % 10 < 3, None).otherwise(F.col("temperature")), "temperature_bias": F.col("row_id") * 0.002, "temperature_post_fit_residual": F.randn(2) * 2})
    m = health.score(health.measures(bad), profiles).cache()
    t = m.where("sensor = 'temperature'").first()
    assert t.completeness_pct == 70.0 and t.is_degraded and t.maintenance_status == "URGENT_ACTION_REQUIRED" and t.drift_rate_per_day == pytest.approx(0.002 * 999 / (1000 * 5 / 1440), abs=1e-3)
    alerts = health.maintenance_alerts(m).orderBy("urgency_rank", "ordinal").collect()
    assert alerts[0].urgency == "URGENT" and "exceeds limits" in alerts[0].trigger_reason
    assert "█" in render.health_dashboard(m, 0)
    m.unpersist()


def test_whole_plan(spark):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=2))
    out = telemetry.correct_and_alert(df, detectors=False)
    corrected, alerts = out["corrected"].cache(), out["alerts"].cache()
    assert corrected.count() == 576
    for r in corrected.where("humidity_raw IS NOT NULL").collect():
        assert 0 <= r.humidity_ci95_lower <= r.humidity_corrected <= r.humidity_ci95_upper <= 100 and r.wind_speed_corrected >= 0
    log = alerts.orderBy("alert_seq").collect()
    assert [r.alert_id for r in log] == [f"ALT-{i + 1:04d}" for i in range(len(log))] and {"CRITICAL", "WARNING"} == {r.severity for r in log}
    assert all("=" in r.raw_reading for r in log) and {r.sensor_health_grade for r in log} <= {"EXCELLENT", "GOOD", "FAIR", "DEGRADED", "CRITICAL"}
    assert correction.search(alerts, "critical").count() == sum(r.severity == "CRITICAL" for r in log)
    assert "ALT-0001" in render.alert_dashboard(alerts, out["health"], 0)
    injected = injection.inject(chunks.numbered(corrected), "bias_jump", 560)
    raised = injection.alert(injected, "bias_jump", 560, injection.next_alert_id(alerts)).first()
    assert raised.alert_id == f"ALERT-{len(log) + 1:04d}" and "17 samples" in raised.historical_context
    assert serving.history(chunks.numbered(corrected)).count() == 300
    with pytest.raises(ValueError):
        injection.inject(corrected, "nothing", 1)
    corrected.unpersist(), alerts.unpersist()


@pytest.mark.parametrize("scenario", synthetic.SCENARIOS)
def test_generators_are_repeatable(spark, scenario):
    config = synthetic.WeatherConfig(days=1, inject=False, stations=2)
    one, two = (synthetic.drift(spark, scenario, config)["observed"].orderBy("station_id", "row_id").collect() for _ in range(2))
    assert one == two and len(one) == 576
    assert column(synthetic.weather(spark, synthetic.WeatherConfig(days=0.5)), "humidity")[0] is not None


def test_layer_and_its_gradient_are_those_of_one_step_after_another():
    """A layer whose inputs and gradients are multiplied for all steps at once, against one that takes each step by itself."""
    model, rng = sequence.Autoencoder(config=sequence.SequenceConfig(hidden=5, latent=2)), np.random.default_rng(8)
    model.start(4)
    x, dout = rng.standard_normal((7, 12, 4)).astype(np.float32), rng.standard_normal((7, 12, 5)).astype(np.float32)
    out, kept = sequence._lstm(model.params, "e1", x)
    w, u, b = (model.params[f"e1.{k}"] for k in "wub")
    h = c = np.zeros((7, 5), np.float32)
    for t in range(12):
        i, f, o, g = np.split(x[:, t] @ w + h @ u + b, 4, axis=1)
        i, f, o = (1 / (1 + np.exp(-k)) for k in (i, f, o))
        c = f * c + i * np.tanh(g)
        h = o * np.tanh(c)
        assert np.allclose(out[:, t], h, atol=1e-6)
    grads = {k: np.zeros_like(v) for k, v in model.params.items()}
    dx = sequence._lstm_back(model.params, grads, "e1", x, kept, dout)
    for array, gradient in ((x, dx), *((model.params[f"e1.{k}"], grads[f"e1.{k}"]) for k in "wub")):
        place, step = tuple(rng.integers(n) for n in array.shape), np.float32(1e-2)
        old, ends = array[place], []
        for k in (1, -1):
            array[place] = old + k * step
            ends.append(float((sequence._lstm(model.params, "e1", x)[0] * dout).sum(dtype=float)))
        array[place] = old
        assert abs((ends[0] - ends[1]) / (2 * step) - gradient[place]) < 1e-2


def test_scoring_takes_few_sequences_at_a_time(monkeypatch):
    model, sizes = sequence.Autoencoder(config=sequence.SequenceConfig(hidden=3, latent=2)), []
    model.start(4)
    forward = model.forward
    monkeypatch.setattr(model, "forward", lambda b: sizes.append(len(b)) or forward(b))
    assert model.errors(np.zeros((1500, 12, 4), np.float32)).shape == (1500, 4) and sum(sizes) == 1500 and max(sizes) <= 512
