"""Stateful processors, batch by batch in any split, against the batch plans. The processors run here without a stream, on states in memory."""

import datetime
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, CleaningConfig, KalmanConfig, StatisticalThresholds
from skygauge.operators import clean, correction, kalman, physics, statistical
from skygauge.plans import telemetry
from skygauge.sources import synthetic
from skygauge.streaming import live, lookahead


class Cell:
    """A value, list or map state."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else []

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def iterator(self):
        return iter(list((self.value or {}).items()))

    def updateValue(self, key, value):  # noqa: N802
        self.value = {**(self.value or {}), tuple(key): value}

    def removeKey(self, key):  # noqa: N802
        self.value.pop(tuple(key))


class Handle:
    def __init__(self):
        self.timers, self.cells = set(), {}

    def getListState(self, name, schema):  # noqa: N802
        return self.cells.setdefault(name, Cell())

    getValueState = getListState  # noqa: N815

    def getMapState(self, name, key, value):  # noqa: N802
        return self.cells.setdefault(name, Cell())

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))


class Clock:
    def __init__(self, micros):
        self.micros = micros

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.micros // 1000


def drive(processor, batches, delay=0, end=None):
    """What a processor gives for batches of one station's rows, with the watermark of all batches before each; end: micros the clock goes on to afterwards."""
    handle, newest, out, watermark = Handle(), 0, [], 0
    processor.init(handle)
    for batch in batches:
        if len(batch):
            out += list(processor.handleInputRows((0, False), iter([batch]), Clock(watermark)))
            newest = max(newest, int(batch["at"].max()))
        watermark = max(watermark, newest - delay)
        for timer in [t for t in sorted(handle.timers) if t * 1000 <= watermark]:
            handle.deleteTimer(timer)
            out += list(processor.handleExpiredTimer((0, False), Clock(watermark), None))
    if end is not None:
        for timer in sorted(handle.timers):
            handle.deleteTimer(timer)
            out += list(processor.handleExpiredTimer((0, False), Clock(end), None))
    return pd.concat(out, ignore_index=True), handle


def splits(df, rng, n):
    cuts = sorted(rng.randrange(len(df) + 1) for _ in range(n - 1))
    return [df.iloc[a:b].reset_index(drop=True) for a, b in zip([0, *cuts], [*cuts, len(df)], strict=True)]


@pytest.fixture(scope="module")
def station(spark):
    """A station's readings with spikes, flatlines, sentinels and gaps, one of several days in one channel."""
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=4, minutes=15, stations=1))
    t = F.col("temperature")
    df = df.withColumn("temperature", F.when(F.col("row_id").between(100, 300), None).when(F.col("row_id") % 97 == 5, t + 30).when(F.col("row_id").between(320, 350), 11.0).when(F.col("row_id") == 383, None).otherwise(t))
    return df.withColumn("pressure", F.when(F.col("row_id").isin(0, 1, 60, 61), -999.0).otherwise(F.col("pressure")))


def as_rows(df, *more):
    return df.orderBy("ts", "row_id").select(F.unix_micros("ts").alias("at"), F.col("row_id").alias("row"), F.lit(False).alias("no_row"), *CHANNELS, *more).toPandas()


def test_flags_are_those_of_the_batch_plan_in_any_split(spark, station):
    whole = telemetry.flagged(station)
    flags = [c for c in whole.columns if c.startswith(("flag_", "is_"))]
    expected = whole.orderBy("row_id").select("row_id", "rn", *flags).toPandas()
    fences, rows, rng = statistical.fences(station, StatisticalThresholds()), as_rows(station), random.Random(4)
    halo = statistical.halo(StatisticalThresholds())
    for n, delay in ((1, 0), (3, 0), (9, 3_600_000_000), (60, 0)):
        processor = lookahead.ReleaseProcessor(halo, 86_400_000_000)
        out, handle = drive(processor, splits(rows, rng, n), delay, end=int(rows["at"].max()) + 2 * 86_400_000_000)
        core = out[out["core"]].sort_values("rn")
        assert core["row"].tolist() == rows["row"].tolist() and core["rn"].tolist() == list(range(1, len(rows) + 1))
        assert len(handle.cells["rows"].get()) <= halo
    frame = spark.createDataFrame(out.rename(columns={"station": "station_id", "row": "row_id"}).assign(ts=pd.to_datetime(out["at"], unit="us")).drop(columns=["no_station", "no_row", "at"]).replace({np.nan: None}), "station_id int, row_id long, temperature double, pressure double, humidity double, wind_speed double, rn long, chunk long, core boolean, ts timestamp")
    got = clean.validity(statistical.check_chunks(physics.check(frame), known=fences)).orderBy("row_id").select("row_id", "rn", *flags).toPandas()
    assert out["chunk"].nunique() > 20 and (got == expected).all().all()


def test_disorder_within_the_delay_is_put_in_order(station):
    rows, rng = as_rows(station), random.Random(8)
    delay = 5 * 3_600_000_000
    came = rows.iloc[np.argsort(rows["at"] + np.array([rng.randrange(delay // 2) for _ in range(len(rows))]))].reset_index(drop=True)
    out, _ = drive(lookahead.ReleaseProcessor(10, 1), splits(came, rng, 12), delay, end=int(rows["at"].max()) + delay)
    assert out[out["core"]].sort_values("rn")["row"].tolist() == rows["row"].tolist()
    first = out[out["chunk"] == 3]
    assert first["rn"].is_monotonic_increasing and (first["core"].iloc[10:-10]).all() and not first["core"].iloc[:10].any() and not first["core"].iloc[-10:].any()


@pytest.mark.parametrize("strategy", ["interpolate", "ffill", "bfill", "forward", "none"])
def test_fills_are_those_of_the_batch_plan_in_any_split(spark, station, strategy):
    config, rng = CleaningConfig(strategy), random.Random(5)
    flagged = telemetry.flagged(station)
    expected = clean.clean(flagged, config).orderBy("rn").select(*(f"{c}_cleaned" for c in CHANNELS)).toPandas()
    rows = as_rows(flagged, *clean.VALID, "rn")
    for n in (1, 7, 80):
        out, handle = drive(lookahead.FillProcessor(config.limit, 1), splits(rows, rng, n), end=int(rows["at"].max()) + 10_000)
        assert sorted(out["rn"]) == rows["rn"].tolist()
        assert len(handle.cells["rows"].get()) == 0
    values = {c: F.when(F.col(f"is_valid_{c}"), F.col(c)) for c in CHANNELS}
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lookahead.FILLED)
    frame = spark.createDataFrame(out.replace({np.nan: None}), types)
    ends = {f"{c}_{s}": F.when(F.col(f"{c}_{s}_rn") > 0, F.struct(F.col(f"{c}_{s}_rn").alias("rn"), F.col(f"{c}_{s}_x").alias("x"))) for c in CHANNELS for s in ("prev", "next")}
    filled = clean.fill_between(values, frame.withColumns(ends), config) if strategy != "none" else clean.imputed(values, frame, config)
    got = filled.orderBy("rn").select(*(clean.precise(c, F.col(f"{c}_filled")).alias(f"{c}_cleaned") for c in CHANNELS)).toPandas()
    assert got.equals(expected)


def test_rows_that_wait_for_a_fill_are_few(station):
    rows = as_rows(telemetry.flagged(station), *clean.VALID, "rn")
    _, handle = drive(lookahead.FillProcessor(6, None), [rows.iloc[i : i + 10].reset_index(drop=True) for i in range(0, 250, 10)])  # ends in the long gap
    assert 6 <= len(handle.cells["rows"].get()) <= 4 * 6 + 6


def test_late_rows_are_filtered_in_their_place(spark, station):
    with_nulls = station.where("row_id < 200").withColumn("humidity", F.when(F.col("row_id") % 7 != 0, F.col("humidity")))
    expected = kalman.track(with_nulls).orderBy("rn").toPandas()
    rows, rng = as_rows(with_nulls, *(F.lit(None).cast("double").alias(c) for c in live.REFERENCES)), random.Random(6)
    delay = 8 * 3_600_000_000
    came = rows.iloc[np.argsort(rows["at"] + np.array([rng.randrange(delay) for _ in range(len(rows))]))].reset_index(drop=True)
    assert not came["at"].is_monotonic_increasing
    for batches, late in ((splits(came, rng, 15), True), (splits(rows, rng, 15), False), (splits(rows, rng, 1), False)):
        out, handle = drive(live.KalmanProcessor(KalmanConfig(), late), batches, delay)
        last = out.sort_values("revision", kind="stable").drop_duplicates("rn", keep="last").sort_values("rn")
        assert last["row"].tolist() == rows["row"].tolist()
        for c in ("temperature_true", "pressure_bias", "wind_speed_true_std", "humidity_innovation", "nis"):
            assert np.allclose(last[c].astype(float), expected[c].astype(float), atol=1e-8, equal_nan=True)
        assert len(handle.cells["rows"].get()) <= (80 if late else 1)


def test_held_rows_are_few_entries_and_spans_go_on(station, monkeypatch):
    """What a station holds is no object a row, and rows filtered span by span are as those of the whole history."""
    expected = kalman.track(station).orderBy("rn").toPandas()
    rows = as_rows(station, *(F.lit(None).cast("double").alias(c) for c in live.REFERENCES))
    monkeypatch.setattr(live, "SPAN", 50)
    for late, batches in ((True, [rows.iloc[::2], rows.iloc[1::2]]), (False, [rows.iloc[:170], rows.iloc[170:]])):
        out, handle = drive(live.KalmanProcessor(KalmanConfig(), late), [b.reset_index(drop=True) for b in batches], 10**15)
        last = out.sort_values("revision", kind="stable").drop_duplicates("rn", keep="last").sort_values("rn")
        assert last["row"].tolist() == rows["row"].tolist() and len(handle.cells["rows"].get()) == 1
        for c in ("temperature_true", "pressure_bias", "wind_speed_true_std"):
            assert np.allclose(last[c].astype(float), expected[c].astype(float), atol=1e-8, equal_nan=True)


def test_long_batches_are_let_go_in_bounded_chunks(monkeypatch):
    n = 1000
    rows = pd.DataFrame({"at": np.arange(n) * 1_000_000, "row": np.arange(n), "no_row": False} | {c: np.arange(n) * 1.0 for c in CHANNELS})
    monkeypatch.setattr(lookahead, "CHUNK_ROWS", 128)
    out, handle = drive(lookahead.ReleaseProcessor(24, 1_000_000), [rows], end=10**15)
    cores = out[out["core"]]
    assert cores["rn"].tolist() == list(range(1, n + 1)) and cores.groupby("chunk").size().max() == 128
    for _, chunk in out.groupby("chunk"):
        low, high = chunk.loc[chunk["core"], "rn"].min(), chunk.loc[chunk["core"], "rn"].max()
        assert chunk["rn"].tolist() == list(range(max(1, low - 24), min(n, high + 24) + 1))


def brute_recurrence(rows, hours=72):
    out = []
    for i, (at, _, kind, sensors) in enumerate(rows):
        alike = [a for a, _, k, s in rows[:i] if at - a <= hours * live.HOUR and (k is not None and k == kind or set(filter(None, s or [])) & set(filter(None, sensors or [])))]
        out.append((len(alike), max(alike, default=None)))
    return out


def test_recurrence_counters_against_brute_force():
    rng, rows = random.Random(9), []
    at = 1_700_000_000_000_000
    for i in range(400):
        at += rng.choice([0, 1, 60_000_000, live.HOUR, 5 * live.HOUR, 40 * live.HOUR])
        rows.append((at, i, rng.choice(["A", "B", None]), rng.choice([None, [], ["t"], ["t", "p"], ["h", None], ["w"]])))
    df = pd.DataFrame([(a, i, False, k, json.dumps({"anomaly_type": k, "sensors": s})) for a, i, k, s in rows], columns=["at", "row", "no_row", "anomaly_type", "kind"])
    for n in (1, 5, 50):
        out, handle = drive(live.RecurrenceProcessor(72), splits(df, rng, n))
        expected = brute_recurrence(rows)
        assert out["earlier"].tolist() == [n for n, _ in expected]
        assert all(l == e for l, (n, e) in zip(out["last"].tolist(), expected, strict=True) if n == 1)
        hours = {h for _, h in handle.cells["times"].get()}
        assert max(hours) - min(hours) <= 74


def test_recurrence_stream_with_nulls_is_that_of_the_batch_plan(spark, tmp_path):
    day = datetime.datetime(2026, 3, 1)
    made = [(0, 1, 10, "A", ["temperature"]), (0, None, 12, None, ["temperature", None]), (None, 3, 13, "A", None), (None, 4, 14, "A", []), (0, 5, 15, "B", ["temperature"]), (0, 6, 120, "B", None), (0, 2**62, 121, "B", None)]
    alerts = spark.createDataFrame([(s, r, day + datetime.timedelta(hours=h), k, x) for s, r, h, k, x in made], "station_id int, row_id long, ts timestamp, anomaly_type string, sensors array<string>")
    alerts.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.recurrence_stream(spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["station_id", "row_id", "ts", "earlier", "historical_context"]
    expected = correction.recurrence(correction.number_alerts(alerts)).select(*columns)
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect())) == sorted(map(repr, expected.collect()))


def test_elements_compose():
    """Two elements on end do to a state what one does after the other."""
    rng = np.random.default_rng(1)
    df = pd.DataFrame(rng.standard_normal((40, 4)) + 10, columns=CHANNELS).assign(station_id=0, row_id=range(40), ts=0, rn=range(1, 41), dt=rng.uniform(1, 9, 40))
    df.loc[df.index % 5 == 2, "humidity"] = np.nan
    for c in CHANNELS:
        df[f"{c}_reference"] = np.where(df.index % 9 == 3, 10.0, np.nan)
    config = KalmanConfig()
    halves = kalman._Chunks([df.iloc[:17], df.iloc[17:]], config).elements().reshape(2, 4, kalman.ELEMENT)
    whole = kalman._Chunks([df], config).elements().reshape(4, kalman.ELEMENT)
    assert np.allclose(kalman.composed(*halves), whole, atol=1e-8)
    start = kalman.first_state(df[list(CHANNELS)].iloc[0].to_numpy(), config)
    one_by_one = kalman._Chunks([df], config).states(start, snapshots=True)
    assert np.allclose(kalman.applied(whole, start).ravel(), one_by_one["snapshot"].iloc[-1], atol=1e-8)
    assert math.isclose(kalman.filter_rows(df, start, config)["nis"].iloc[-1], one_by_one["nis"].iloc[-1], abs_tol=1e-8)


def test_no_group_of_a_long_history_is_large(spark, station, monkeypatch):
    expected = kalman.track(station).orderBy("rn").toPandas()
    got = kalman.track(station, chunk_rows=8, group=4).orderBy("rn").toPandas()
    assert len(got) == len(expected) == 384 and max(abs(got[c] - expected[c]).max() for c in ("temperature_true", "humidity_bias", "pressure_true_std")) < 1e-7


def test_a_buffer_holds_the_last_readings(station):
    rows, rng = as_rows(station), random.Random(3)
    came = rows.iloc[np.argsort(rows["at"] + np.array([rng.randrange(20 * live.HOUR) for _ in range(len(rows))]))].reset_index(drop=True)
    for n in (1, 8):
        batches = splits(came, rng, n)
        out, handle = drive(live.BufferProcessor(25), batches)
        last = out[out["revision"] == out["revision"].max()]
        assert last["row"].tolist() == rows["row"].tolist()[-25:] and last["place"].tolist() == list(range(25)) and len(handle.cells["rows"].get()) == 25
    first = out[out["revision"] == 1]
    assert first["row"].tolist() == sorted(next(b for b in batches if len(b))["row"])[-25:]
