"""Structured Streaming: readings as they arrive.

Flags that look at one row, windowed counts and duplicate removal are plain streaming plans.
The Kalman filter and alert recurrence keep state for each station. Flags whose frames reach
forward need later rows: lookahead.py holds readings back until those are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from skygauge.functions.config import CHANNELS, KalmanConfig
from skygauge.operators import physics
from skygauge.operators.correction import context
from skygauge.operators.kalman import OUTPUT, filtered, first_state

READINGS = T.StructType([T.StructField("station_id", T.IntegerType()), T.StructField("row_id", T.LongType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in CHANNELS)])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Readings from files as they appear in a folder."""
    reader = spark.readStream.schema(READINGS).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def without_duplicates(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each station's reading of a time once, if its copies come within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station_id", "ts"])


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Readings and physics violations by station and tumbling (or sliding) window of time."""
    checked = physics.check(stream.withWatermark("ts", delay) if stream.isStreaming else stream)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return checked.groupBy(window.alias("w"), "station_id").agg(F.count("*").alias("readings"), F.count_if("flag_t_p_rh_physics_violation").alias("thermo_violations"), F.count_if("flag_wind_physics_violation").alias("wind_violations")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "station_id", "readings", "thermo_violations", "wind_violations")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Spans of a station's readings without a gap of that length."""
    stream = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "station_id").agg(F.count("*").alias("readings")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "station_id", "readings")


#: Keys without nulls, as pandas would round large ids beside one.
KEYS = "coalesce(station_id, 0) AS station", "station_id IS NULL AS no_station", "coalesce(row_id, 0L) AS row", "row_id IS NULL AS no_row"
STATION = ("station", "no_station")


def _keyed(stream: DataFrame, *columns: str | Column) -> DataFrame:
    """station, row, at (microseconds) and ts, with marks of null ones, and the columns."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.select(*map(F.expr, KEYS), F.unix_micros("ts").alias("at"), "ts", *columns)


def _named(out: DataFrame) -> DataFrame:
    """out with station_id, row_id and ts again."""
    known = lambda x: F.when(~F.col(f"no_{x}"), F.col(x)).alias(f"{x}_id")
    return out.select(known("station"), known("row"), F.timestamp_micros("at").alias("ts"), *(c for c in out.columns if c not in ("station", "no_station", "row", "no_row", "at", "ts")))


#: Order of a station's readings: by time, those without an id first, then by id.
def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at", "no_row", "row"], ascending=[True, False, True], kind="stable", ignore_index=True)


def keep(state: ListState, rows: list[tuple]) -> None:
    """Make rows, or nothing, the state."""
    if rows:
        state.put(rows)
    else:
        state.clear()


#: Rows held in a state are records, so many to an entry; one entry a row would take an object for each of its numbers.
ENTRY = "rows binary"
ENTRY_ROWS = 4096


def records(*numbers: str) -> np.dtype:
    return np.dtype([("at", "<i8"), ("row", "<i8"), ("no_row", "?"), *((c, "<f8") for c in numbers)])


def taken(frames: Iterator[pd.DataFrame], kind: np.dtype) -> np.ndarray:
    """The rows of frames as records."""
    parts = [np.zeros(0, kind)]
    for f in frames:
        parts.append(np.empty(len(f), kind))
        for c in kind.names:
            parts[-1][c] = f[c].to_numpy(kind[c])
    return np.concatenate(parts)


def ordered(rows: np.ndarray) -> np.ndarray:
    """Places of records in the order of _in_order()."""
    return np.lexsort((rows["row"], ~rows["no_row"], rows["at"]))


def held(state: ListState, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(entry, kind) for entry, in state.get())])


def hold(state: ListState, rows: np.ndarray) -> None:
    """Make records, or nothing, the state."""
    keep(state, [(rows[i : i + ENTRY_ROWS].tobytes(),) for i in range(0, len(rows), ENTRY_ROWS)])


REFERENCES = tuple(f"{c}_reference" for c in CHANNELS)
SEEN = (*CHANNELS, *REFERENCES)
SEEN_ROW = records(*SEEN)
#: Rows that are filtered at a time.
SPAN = 1 << 16
TRACKED = T.StructType([T.StructField("station", T.IntegerType()), T.StructField("no_station", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("no_row", T.BooleanType()), T.StructField("at", T.LongType()),
    T.StructField("rn", T.LongType()), *(f for f in OUTPUT.fields if f.name not in ("station_id", "row_id", "ts", "rn")), T.StructField("revision", T.LongType())])


class KalmanProcessor(StatefulProcessor):
    """The filters of one station, kept between batches.

    `base` is the filters' state after the last row that can't be preceded by a late one any more. Rows after it are held. A late
    row is put in its place, the filters run again from the base, and what it changes is given again, with a higher
    revision. Without a watermark no row is late, and only the last one is held. Beside the rows of a batch a task holds
    no more than SPAN of them with their estimates.
    """

    def __init__(self, config: KalmanConfig | None = None, late: bool = False) -> None:
        self.config, self.late = config or KalmanConfig(), late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "at long, rn long, revision long, filters array<double>")
        self.rows = handle.getListState("rows", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = held(self.rows, SEEN_ROW)
        everything = np.concatenate([known, taken(rows, SEEN_ROW)])
        order = ordered(everything)
        since = int(np.argmax(order >= len(known)))  # all before it is as it was
        everything = everything[order]
        del order
        at, rn, revision, filters = self.base.get() if self.base.exists() else (None, 0, 0, None)
        if filters is None:
            state = first_state(np.nan_to_num(np.array([everything[c][0] for c in CHANNELS]), nan=0.0, posinf=0.0, neginf=0.0), self.config)
        else:
            state = np.asarray(filters, float).reshape(len(CHANNELS), 9)
        final = int((everything["at"] <= timerValues.getCurrentWatermarkInMs() * 1000).sum()) if self.late else len(everything) - 1
        last, base = at, (at, rn, revision + 1, filters)
        borders = sorted({*range(0, len(everything), SPAN), final, len(everything)})
        for low, high in zip(borders, borders[1:], strict=False):
            some = everything[low:high]
            gap = np.diff(some["at"], prepend=some["at"][0] if last is None else last) / 1e6
            last = int(some["at"][-1])
            frame = pd.DataFrame({c: some[c] for c in SEEN_ROW.names})
            frame["dt"] = np.where(gap > 0, np.maximum(0.1, gap / 60.0), self.config.default_minutes)
            frame["station_id"], frame["row_id"], frame["ts"] = 0, frame["row"], frame["at"]
            frame["rn"] = rn + low + np.arange(1, len(frame) + 1)
            found, state = filtered(frame, state, self.config)
            if high == final:
                base = (last, rn + final, revision + 1, [float(x) for x in state.ravel()])
            if high > since:
                found = found.reset_index(drop=True).assign(station=key[0], no_station=key[1], row=frame["row"], no_row=frame["no_row"], at=frame["at"], revision=revision + 1)
                yield found[TRACKED.names].iloc[max(0, since - low) :]
        hold(self.rows, everything[final:])
        self.base.update(base)

    def close(self) -> None:
        pass


def track_stream(stream: DataFrame, config: KalmanConfig | None = None, delay: str | None = None, watermarked: bool = False) -> DataFrame:
    """kalman.track() on a stream: state goes on from batch to batch, so the estimates are the same.

    Without a delay each reading is estimated once, and rows are taken in the order of batches. With one, a row that is late by
    no more than it takes its place: it and those after it are estimated again, so a reading has one row a revision, and
    latest() of them is what the whole history gives. watermarked: the stream has its delay already, as with_references() gives it. Columns
    {channel}_reference are checks, if the stream has them. Null
    stations and row ids are kept as they are; rows without a time aren't tracked.
    """
    checks = [F.col(c) if c in stream.columns else F.lit(None).cast("double").alias(c) for c in REFERENCES]
    stream = stream.where("ts IS NOT NULL")
    keyed = _keyed(stream.withWatermark("ts", delay) if delay else stream, *CHANNELS, *checks)
    return _named(keyed.groupBy(*STATION).transformWithStateInPandas(KalmanProcessor(config, bool(delay) or watermarked), TRACKED, "Append", "EventTime" if delay or watermarked else "None"))


def latest(tracked: DataFrame) -> DataFrame:
    """The last revision of each reading of a stored result of track_stream(). A late reading changes the numbers of all after it, which are given again, so
    the last revision of each number is the one that holds."""
    rows = F.struct(*(F.col(c) for c in tracked.columns if c not in ("station_id", "rn")))
    return tracked.groupBy("station_id", "rn").agg(F.max_by(rows, "revision").alias("r")).select("station_id", "rn", "r.*")


def with_references(stream: DataFrame, references: DataFrame, delay: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """A stream of readings with {channel}_reference from a stream of checks (station_id, row_id, ts of the check, channels), null
    where none comes. A check is found if its time is no more than `within` from its reading's; delay: how late either may arrive."""
    named = references.withWatermark("ts", delay).select(F.col("station_id").alias("_s"), F.col("row_id").alias("_r"), F.col("ts").alias("_t"), *(F.col(c).alias(f"{c}_reference") for c in CHANNELS))
    near = F.expr(f"_t >= ts - INTERVAL {within} AND _t <= ts + INTERVAL {within}")
    own = F.col("station_id").eqNullSafe(F.col("_s")) & F.col("row_id").eqNullSafe(F.col("_r"))
    return stream.withWatermark("ts", delay).join(named, own & near, "leftOuter").drop("_s", "_r", "_t")


RECURRENCE = T.StructType([T.StructField("station", T.IntegerType()), T.StructField("no_station", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("no_row", T.BooleanType()), T.StructField("at", T.LongType()), T.StructField("anomaly_type", T.StringType()), T.StructField("earlier", T.LongType()), T.StructField("last", T.LongType())])
HOUR = 3_600_000_000


class RecurrenceProcessor(StatefulProcessor):
    """How often a station's alerts of each kind (a type and sensors) came, by hour of their time.

    An alert counts the kinds that it is like: the hours that lie wholly within the span by their number alone, the first one by its
    times. A batch reads the counters of its station once and writes those that changed; hours before the span of the
    newest alert are removed, so what is kept doesn't grow with the history. An alert that comes late counts those before it
    by time; what was given for later ones isn't given again.
    """

    def __init__(self, hours: int = 72) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "kind string, hour long", "at array<long>, row array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = _in_order(pd.concat(list(rows), ignore_index=True))
        came["row"] = np.where(came["no_row"], np.iinfo(np.int64).min, came["row"])
        came["hour"] = came["at"] // HOUR
        known = {tuple(k): v for k, v in self.times.iterator()}
        changed: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
        for (kind, hour), own in came.groupby(["kind", "hour"], sort=False):
            at, row = known.get((kind, hour), ([], []))
            order = np.lexsort((np.r_[np.array(row, np.int64), own["row"]], np.r_[np.array(at, np.int64), own["at"]]))
            changed[kind, int(hour)] = np.r_[np.array(at, np.int64), own["at"]][order].tolist(), np.r_[np.array(row, np.int64), own["row"]][order].tolist()
        kept = set(known)
        known |= changed
        by_kind: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (kind, _), (at, row) in sorted(known.items(), key=lambda x: x[0][1]):
            by_kind.setdefault(kind, []).append((np.asarray(at, np.int64), np.asarray(row, np.int64)))
        lines = {kind: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for kind, parts in by_kind.items()}  # in order of time
        alike = {kind: [other for other in lines if kinds_alike(kind, other)] for kind in came["kind"].unique()}
        earlier, last, span = np.zeros(len(came), np.int64), np.full(len(came), np.iinfo(np.int64).min), self.hours * HOUR
        for kind, own in came.groupby("kind", sort=False):
            at, row, place = own["at"].to_numpy(np.int64), own["row"].to_numpy(np.int64), own.index.to_numpy()
            for other in alike[kind]:
                times, ids = lines[other]
                upto, least = before(times, ids, at, row), np.searchsorted(times, at - span, "left")
                earlier[place] += upto - np.minimum(least, upto)
                last[place] = np.maximum(last[place], np.where(upto > 0, times[np.maximum(upto - 1, 0)], last[place]))
        oldest = max(hour for _, hour in known) - self.hours - 1
        for k in known:
            if k[1] < oldest:
                if k in kept:
                    self.times.removeKey(k)
            elif k in changed:
                self.times.updateValue(k, changed[k])
        out = came.assign(station=key[0], no_station=key[1], earlier=earlier, last=last, row=np.where(came["no_row"], 0, came["row"]))
        yield out[RECURRENCE.names]

    def close(self) -> None:
        pass


def before(times: np.ndarray, ids: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many of (times, ids), in order, come before each (at, row)."""
    low, high = np.searchsorted(times, at, "left"), np.searchsorted(times, at, "right")
    return low + np.array([np.searchsorted(ids[a:b], r, "left") if b > a else 0 for a, b, r in zip(low.tolist(), high.tolist(), row.tolist(), strict=True)], np.int64).reshape(len(at))


def kinds_alike(a: str, b: str) -> bool:
    """Whether two kinds (JSON of type and sensors) share their type or a sensor; nulls are like nothing."""
    (type_a, sensors_a), (type_b, sensors_b) = (((x := json.loads(k)).get("anomaly_type"), set(filter(None, x.get("sensors") or []))) for k in (a, b))
    return type_a is not None and type_a == type_b or bool(sensors_a & sensors_b)


def recurrence_stream(alerts: DataFrame, hours: int = 72) -> DataFrame:
    """correction.recurrence() on a stream of (station_id, row_id, ts, anomaly_type, sensors), which come in order; any of them may be null. An alert without a
    time isn't given."""
    kind = F.to_json(F.struct("anomaly_type", "sensors"), {"ignoreNullFields": "false"}).alias("kind")
    keyed = _keyed(alerts.where("ts IS NOT NULL"), "anomaly_type", kind).drop("ts")
    found = _named(keyed.groupBy(*STATION).transformWithStateInPandas(RecurrenceProcessor(hours), RECURRENCE, "Append", "None"))
    return found.withColumn("historical_context", context(F.col("earlier"), F.timestamp_micros("last"), hours)).drop("last")


BUFFERED = T.StructType([*(f for f in TRACKED.fields if f.name in ("station", "no_station", "row", "no_row", "at")), *(T.StructField(c, T.DoubleType()) for c in CHANNELS), T.StructField("place", T.IntegerType()), T.StructField("revision", T.LongType())])


class BufferProcessor(StatefulProcessor):
    """The last readings of a station, in order of time."""

    def __init__(self, rows: int) -> None:
        self.most = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "at long, row long, no_row boolean, numbers array<double>")
        self.revision = handle.getValueState("revision", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame([(t, r, n, *x) for t, r, n, x in self.rows.get()], columns=["at", "row", "no_row", *CHANNELS])
        came = pd.concat([r[held.columns] for r in rows], ignore_index=True)
        last = _in_order(pd.concat([held, came], ignore_index=True) if len(held) else came).iloc[-self.most :]
        n = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((n,))
        keep(self.rows, [(int(t), int(r), bool(x), list(map(float, numbers))) for t, r, x, numbers in zip(last["at"], last["row"], last["no_row"], last[list(CHANNELS)].to_numpy(float), strict=True)])
        yield last.assign(station=key[0], no_station=key[1], place=np.arange(len(last), dtype=np.int32), revision=n)[BUFFERED.names]

    def close(self) -> None:
        pass


def buffer_stream(stream: DataFrame, rows: int = 60) -> DataFrame:
    """What a dashboard shows of each station as readings arrive: after each batch that has any of it, its last `rows` readings (place from 0, oldest first), under a higher
    revision. Late readings take their place while it is among the last."""
    keyed = _keyed(stream.where("ts IS NOT NULL"), *CHANNELS).drop("ts")
    return _named(keyed.groupBy(*STATION).transformWithStateInPandas(BufferProcessor(rows), BUFFERED, "Append", "None"))


def shown(buffered: DataFrame) -> DataFrame:
    """The newest buffer of each station in a stored result of buffer_stream()."""
    newest = buffered.groupBy(F.col("station_id").alias("_s")).agg(F.max("revision").alias("_n"))
    return buffered.join(newest, F.col("station_id").eqNullSafe(F.col("_s")) & (F.col("revision") == F.col("_n"))).drop("_s", "_n", "revision")
