"""Tracking of each channel's true value, rate and sensor bias with a Kalman filter.

The joint filter of all channels is block-diagonal, so each channel is a filter of three states
on its own, with scalar algebra. A history is cut into chunks that are filtered in parallel,
after Sarkka and Garcia-Fernandez's associative form of the filter:

1. what a chunk does to whatever state it begins with is one element: a linear map, an offset and a covariance,
   and the information its readings hold on that state;
2. elements compose: those of GROUP chunks on end make one element, those of GROUP such groups one again, until a
   station has no more than GROUP at the top. From its first state on these are applied in order, which gives the
   state each group begins with, and so down to the state each chunk begins with;
3. each chunk is filtered from that state.

Steps 1 and 3 take many chunks and all channels at a time, as arrays, one row of each in turn. A
station of any length is spread over all tasks: no group of step 2 holds more than GROUP elements.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.functions.config import CHANNELS, KalmanConfig
from skygauge.plans import chunks
from skygauge.plans.scratch import stored

ESTIMATES = ("true", "rate", "bias", "true_std", "bias_std", "innovation", "post_fit_residual")
OUTPUT = T.StructType([T.StructField("station_id", T.IntegerType()), T.StructField("row_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("rn", T.LongType()),
    *(T.StructField(f"{c}_{x}", T.DoubleType()) for c in CHANNELS for x in ("observed", *ESTIMATES)), T.StructField("nis", T.DoubleType())])


class ChannelFilter:
    """Value, rate and bias of one channel, and their covariance."""

    def __init__(self, channel: str, first: float | None, config: KalmanConfig) -> None:
        self.q, self.qb, self.r = config.weather_noise[channel] ** 2, config.bias_noise[channel] ** 2, config.sensor_noise[channel] ** 2
        self.reference = config.reference_noise**2
        self.x = [first if first is not None and math.isfinite(first) else 0.0, 0.0, 0.0]
        self.p = [config.initial_value[channel] ** 2, 0.0, 0.0, config.initial_rate**2, 0.0, config.initial_bias**2]  # vv vr vb rr rb bb

    def predict(self, dt: float) -> None:
        vv, vr, vb, rr, rb, bb = self.p
        self.x[0] += self.x[1] * dt
        self.p = [vv + 2 * dt * vr + dt * dt * rr + self.q * dt**3 / 3, vr + dt * rr + self.q * dt * dt / 2, vb + dt * rb, rr + self.q * dt, rb, bb + self.qb * dt]

    def _correct(self, seen: float, bias: float, noise: float) -> tuple[float, float]:
        """Take in a measurement of value + bias * bias state; gives the innovation and its normalised square."""
        vv, vr, vb, rr, rb, bb = self.p
        g = (vv + bias * vb, vr + bias * rb, vb + bias * bb)
        s = g[0] + bias * g[2] + noise
        k = (g[0] / s, g[1] / s, g[2] / s)
        y = seen - self.x[0] - bias * self.x[2]
        self.x = [self.x[i] + k[i] * y for i in range(3)]
        old = ((vv, vr, vb), (vr, rr, rb), (vb, rb, bb))
        # Joseph's form, written out: symmetric whatever the gain's rounding.
        self.p = [old[i][j] - k[i] * g[j] - g[i] * k[j] + k[i] * k[j] * s for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
        return y, y * y / s

    def step(self, dt: float, seen: float | None, reference: float | None) -> tuple[list, float | None]:
        """ESTIMATES after a prediction and what is seen; the share of NIS, if anything was."""
        self.predict(dt)
        has, checked = seen is not None and math.isfinite(seen), reference is not None and math.isfinite(reference)
        innovation, nis = self._correct(seen, 1.0, self.r) if has else (None, None)
        if checked:  # independent noise: one after the other is the joint update
            nis = (nis or 0.0) + self._correct(reference, 0.0, self.reference)[1]
        fit = seen - self.x[0] - self.x[2] if has else None
        return [*self.x, math.sqrt(max(0.0, self.p[0])), math.sqrt(max(0.0, self.p[5])), innovation, fit], nis


def minutes_since(df: DataFrame, config: KalmanConfig | None = None, chunk_rows: int = chunks.CHUNK_ROWS) -> DataFrame:
    """df with rn, chunk and dt: minutes since the station's previous row, at least 0.1; the default for the first row and where time doesn't go on."""
    config = config or KalmanConfig()
    rows = chunks.chunked(chunks.numbered(df), 1, chunk_rows)
    seconds = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(chunks.by_row())) / 1e6
    dt = F.when(seconds > 0, F.greatest(F.lit(0.1), seconds / 60.0)).otherwise(F.lit(config.default_minutes))
    return chunks.cores(rows.withColumn("dt", dt))


#: Rows of a chunk of a history, and chunks that are filtered at a time.
CHUNK_ROWS = 1024
CHUNKS = 32
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
Arrays = list[np.ndarray]


def _forward(x: Arrays, p: Arrays, dt: np.ndarray, q: np.ndarray, qb: np.ndarray) -> tuple[Arrays, Arrays]:
    """Means (value, rate, bias) and covariances (PAIRS) after dt."""
    vv, vr, vb, rr, rb, bb = p
    dt2 = dt * dt
    return [x[0] + x[1] * dt, x[1], x[2]], [vv + 2 * dt * vr + dt2 * rr + q * dt2 * dt / 3, vr + dt * rr + q * dt2 / 2, vb + dt * rb, rr + q * dt, rb, bb + qb * dt]


def _gain(p: Arrays, has: np.ndarray, bias: float, noise: np.ndarray) -> tuple[Arrays, Arrays, np.ndarray]:
    """Of a measurement of value + bias * bias state: its covariance with the state, the gain (0 where there is none) and its variance."""
    vv, vr, vb, rr, rb, bb = p
    g = [vv + bias * vb, vr + bias * rb, vb + bias * bb]
    s = g[0] + bias * g[2] + noise
    return g, [np.where(has, i / s, 0.0) for i in g], s


def _take_in(x: Arrays, p: Arrays, seen: np.ndarray, has: np.ndarray, bias: float, noise: np.ndarray) -> tuple[Arrays, Arrays, np.ndarray, np.ndarray]:
    """Means and covariances after a measurement, its innovation (0 where there is none) and variance."""
    g, k, s = _gain(p, has, bias, noise)
    y = np.where(has, seen - x[0] - bias * x[2], 0.0)
    # Joseph's form, written out: symmetric whatever the gain's rounding.
    return [x[i] + k[i] * y for i in range(3)], [old - k[i] * g[j] - g[i] * k[j] + k[i] * k[j] * s for old, (i, j) in zip(p, PAIRS, strict=True)], y, s


class _Chunks:
    """Some chunks' readings as arrays by (chunk and channel, row), padded with rows of no time and no reading."""

    def __init__(self, frames: list[pd.DataFrame], config: KalmanConfig) -> None:
        self.frames, self.config = frames, config
        n, length = len(frames), max(len(f) for f in frames)
        self.dt, self.seen, self.checked = np.zeros((n, len(CHANNELS), length)), np.full((n, len(CHANNELS), length), np.nan), np.full((n, len(CHANNELS), length), np.nan)
        for i, f in enumerate(frames):
            self.dt[i, :, : len(f)] = f["dt"].to_numpy(float)
            self.seen[i, :, : len(f)] = f[list(CHANNELS)].to_numpy(float).T
            self.checked[i, :, : len(f)] = f[[f"{c}_reference" for c in CHANNELS]].to_numpy(float).T
        self.dt, self.seen, self.checked = (np.ascontiguousarray(a.reshape(n * len(CHANNELS), length).T) for a in (self.dt, self.seen, self.checked))
        self.has, self.has_checked = np.isfinite(self.seen), np.isfinite(self.checked)
        by = lambda numbers: np.tile([numbers[c] ** 2 for c in CHANNELS], n)
        self.q, self.qb, self.r, self.ref = by(config.weather_noise), by(config.bias_noise), by(config.sensor_noise), np.full(n * len(CHANNELS), config.reference_noise**2)

    def elements(self) -> np.ndarray:
        """For each chunk and channel the map (9), offset (3), covariance (6), information vector (3) and matrix (6)."""
        size = self.dt.shape[1]
        zero = lambda k: [np.zeros(size) for _ in range(k)]
        a = [[np.full(size, float(i == j)) for j in range(3)] for i in range(3)]
        b, c, eta, info = zero(3), zero(6), zero(3), zero(6)
        for t in range(len(self.dt)):
            dt = self.dt[t]
            a[0] = [a[0][j] + dt * a[1][j] for j in range(3)]
            b, c = _forward(b, c, dt, self.q, self.qb)
            for seen, has, bias, noise in ((self.seen[t], self.has[t], 1.0, self.r), (self.checked[t], self.has_checked[t], 0.0, self.ref)):
                if not has.any():
                    continue
                _, k, s = _gain(c, has, bias, noise)
                weight = np.where(has, 1.0 / s, 0.0)
                h = [a[0][j] + bias * a[2][j] for j in range(3)]
                b, c, y, _ = _take_in(b, c, seen, has, bias, noise)
                eta = [eta[j] + h[j] * y * weight for j in range(3)]
                info = [old + h[i] * h[j] * weight for old, (i, j) in zip(info, PAIRS, strict=True)]
                a = [[a[i][j] - k[i] * h[j] for j in range(3)] for i in range(3)]
        return np.stack([*a[0], *a[1], *a[2], *b, *c, *eta, *info], axis=1)

    def states(self, starts: np.ndarray, snapshots: bool = False) -> pd.DataFrame:
        """OUTPUT of all rows, from the means (3) and covariances (6) each chunk and channel begins with; with snapshots also
        those after each row, as a column of arrays of all channels."""
        x, p = list(starts[:, :3].T), list(starts[:, 3:].T)
        after = np.empty((len(self.dt), self.dt.shape[1], 9)) if snapshots else None
        out = np.full((len(ESTIMATES) + 1, *self.dt.shape), np.nan)
        for t in range(len(self.dt)):
            x, p = _forward(x, p, self.dt[t], self.q, self.qb)
            has, checked = self.has[t], self.has_checked[t]
            x, p, y, s = _take_in(x, p, self.seen[t], has, 1.0, self.r)
            nis = np.where(has, y * y / s, np.nan)
            if checked.any():  # independent noise: one after the other is the joint update
                x, p, z, s = _take_in(x, p, self.checked[t], checked, 0.0, self.ref)
                nis = np.where(checked, np.nan_to_num(nis) + z * z / s, nis)
            if snapshots:
                after[t] = np.stack([*x, *p], axis=1)
            out[:, t] = (*x, np.sqrt(np.maximum(p[0], 0)), np.sqrt(np.maximum(p[5], 0)), np.where(has, y, np.nan), np.where(has, self.seen[t] - x[0] - x[2], np.nan), nis)
        self.after = np.stack([*x, *p], axis=1)  # by chunk and channel; rows of padding change nothing
        parts = []
        out = out.reshape(len(out), len(self.dt), len(self.frames), len(CHANNELS))
        for i, f in enumerate(self.frames):
            own = out[:, : len(f), i]
            columns = {x: f[x].to_numpy() for x in ("station_id", "row_id", "ts", "rn")}
            for k, c in enumerate(CHANNELS):
                columns[f"{c}_observed"] = f[c].to_numpy(float)
                columns |= {f"{c}_{name}": own[j, :, k] for j, name in enumerate(ESTIMATES)}
            some = ~np.isnan(own[-1]).all(axis=1)
            columns["nis"] = np.where(some, np.nansum(own[-1], axis=1), np.nan)
            if snapshots:
                n = len(CHANNELS)
                columns["snapshot"] = list(after[: len(f), n * i : n * i + n].reshape(len(f), 9 * n))
            parts.append(pd.DataFrame(columns))
        return pd.concat(parts)[OUTPUT.names + ["snapshot"] * snapshots]


def _by_chunk(batches: Iterator[pd.DataFrame], run: Callable[[list[pd.DataFrame]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """run on lists of up to CHUNKS whole chunks of a partition that is sorted by chunk."""
    held: list[pd.DataFrame] = []
    whole: list[pd.DataFrame] = []
    key = lambda f: (None if pd.isna(f["station_id"].iloc[0]) else int(f["station_id"].iloc[0]), int(f["chunk"].iloc[0]))
    for batch in batches:
        for _, part in batch.groupby(["station_id", "chunk"], sort=False, dropna=False):
            if held and key(held[0]) != key(part):
                whole.append(pd.concat(held))
                held = []
            held.append(part)
            if len(whole) == CHUNKS:
                yield run(whole)
                whole = []
    if held:
        yield run([*whole, pd.concat(held)])


ELEMENT = 27
#: Elements that are composed, or applied one after another, in one task.
GROUP = 256
ELEMENTS = T.StructType([T.StructField("station_id", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("first", T.ArrayType(T.DoubleType())), T.StructField("element", T.ArrayType(T.DoubleType()))])
STARTS = T.StructType([T.StructField("station_id", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("start", T.ArrayType(T.DoubleType()))])


def _elements(frames: list[pd.DataFrame], config: KalmanConfig) -> pd.DataFrame:
    found = _Chunks(frames, config).elements().reshape(len(frames), -1)
    firsts = [np.nan_to_num(f[list(CHANNELS)].iloc[0].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0) for f in frames]
    return pd.DataFrame({"station_id": [f["station_id"].iloc[0] for f in frames], "chunk": [f["chunk"].iloc[0] for f in frames], "first": firsts, "element": list(found)})


def _square(p: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their PAIRS."""
    return p[..., [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(*p.shape[:-1], 3, 3)


def _parts(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Map, offset, covariance, information vector and matrix of elements."""
    return e[:, :9].reshape(-1, 3, 3), e[:, 9:12, None], _square(e[:, 12:18]), e[:, 18:21, None], _square(e[:, 21:])


def _flat(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Vectors and the PAIRS of symmetric matrices side by side."""
    return np.concatenate([x[:, :, 0], p[:, [i for i, _ in PAIRS], [j for _, j in PAIRS]]], axis=1)


def first_state(first: np.ndarray, config: KalmanConfig) -> np.ndarray:
    """Mean and covariance of each channel before its first reading."""
    out = np.zeros((len(CHANNELS), 9))
    out[:, 0] = first
    out[:, 3], out[:, 6], out[:, 8] = [config.initial_value[c] ** 2 for c in CHANNELS], config.initial_rate**2, config.initial_bias**2
    return out


def applied(element: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state (a row a channel: mean, covariance) after what an element stands for."""
    a, b, c, eta, info = _parts(element)
    m, p = state[:, :3, None], _square(state[:, 3:])
    through = a @ np.linalg.inv(np.eye(3) + p @ info)
    p_after = through @ p @ a.transpose(0, 2, 1) + c
    return _flat(through @ (m + p @ eta) + b, (p_after + p_after.transpose(0, 2, 1)) / 2)


def composed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The element of two elements on end."""
    (a1, b1, c1, eta1, info1), (a2, b2, c2, eta2, info2) = _parts(first), _parts(second)
    through = a2 @ np.linalg.inv(np.eye(3) + c1 @ info2)
    back = a1.transpose(0, 2, 1) @ np.linalg.inv(np.eye(3) + info2 @ c1)
    c, info = through @ c1 @ a2.transpose(0, 2, 1) + c2, back @ info2 @ a1 + info1
    half = lambda x: (x + x.transpose(0, 2, 1)) / 2
    a = (through @ a1).reshape(-1, 9)
    return np.concatenate([a, _flat(through @ (b1 + c1 @ eta2) + b2, half(c)), _flat(back @ (eta2 - info2 @ b1) + eta1, half(info))], axis=1)


def _by_channel(numbers: object, width: int) -> np.ndarray:
    return np.asarray(numbers, float).reshape(len(CHANNELS), width)


def _folded(elements: pd.DataFrame, group: int) -> pd.DataFrame:
    """One element of a group's."""
    elements = elements.sort_values("chunk")
    whole = reduce(composed, [_by_channel(e, ELEMENT) for e in elements["element"]])
    one = elements.iloc[:1]
    return pd.DataFrame({"station_id": one["station_id"], "chunk": one["chunk"] // group, "first": one["first"], "element": [whole.ravel()]})


def _starts(elements: pd.DataFrame, start: np.ndarray | None, config: KalmanConfig) -> pd.DataFrame:
    """The state each element of a group begins with; start: that of the first, if it isn't a station's first chunk."""
    elements, out = elements.sort_values("chunk"), []
    for first, element in zip(elements["first"], elements["element"], strict=True):
        state = applied(before, state) if out else first_state(first, config) if start is None else start
        before = _by_channel(element, ELEMENT)
        out.append(state.ravel())
    return pd.DataFrame({"station_id": elements["station_id"], "chunk": elements["chunk"], "start": out})


def starts_of(elements: DataFrame, config: KalmanConfig, group: int = GROUP) -> DataFrame:
    """STARTS of all elements (stored), group by group from the top down."""
    levels, top = [elements], elements.agg(F.max("chunk")).first()[0] or 0
    while top >= group:
        levels.append(stored(levels[-1].groupBy("station_id", F.floor(F.col("chunk") / group)).applyInPandas(lambda e: _folded(e, group), ELEMENTS)))
        top //= group
    found = levels.pop().groupBy("station_id").applyInPandas(lambda e: _starts(e, None, config), STARTS)
    while levels:
        def below(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            return _starts(e, _by_channel(s["start"].iloc[0], 9), config)

        own = levels.pop().withColumn("group", F.floor(F.col("chunk") / group))
        found = own.groupBy("station_id", "group").cogroup(found.withColumnRenamed("chunk", "group").groupBy("station_id", "group")).applyInPandas(below, STARTS)
    return found


def filtered(rows: pd.DataFrame, state: np.ndarray, config: KalmanConfig) -> tuple[pd.DataFrame, np.ndarray]:
    """OUTPUT of rows on end (station_id, row_id, ts, rn, dt, channels, references) from a state on, and the state after them. They are filtered in
    about as many pieces as rows of a piece, side by side."""
    length = max(1, math.isqrt(len(rows)))
    pieces = [rows.iloc[i : i + length] for i in range(0, len(rows), length)]
    made, starts = _Chunks(pieces, config), [state]
    if len(pieces) > 1:
        for element in made.elements().reshape(len(pieces), len(CHANNELS), ELEMENT)[:-1]:
            starts.append(applied(element, starts[-1]))
    return made.states(np.concatenate(starts)), made.after[-len(CHANNELS) :]


def filter_rows(rows: pd.DataFrame, state: np.ndarray, config: KalmanConfig) -> pd.DataFrame:
    """filtered() without the state."""
    return filtered(rows, state, config)[0]


def _states(frames: list[pd.DataFrame], config: KalmanConfig) -> pd.DataFrame:
    """Of chunks whose first row holds the state they begin with."""
    starts = np.concatenate([np.asarray(f["start"].iloc[0], float).reshape(len(CHANNELS), 9) for f in frames])
    return _Chunks([f.iloc[1:] for f in frames], config).states(starts)


def track(df: DataFrame, references: DataFrame | None = None, config: KalmanConfig | None = None, sanitize: bool = False, chunk_rows: int = CHUNK_ROWS, group: int = GROUP) -> DataFrame:
    """All estimates of each reading. references: (station_id, row_id) and channels, null where there is no check.

    Sentinel values are measurements here unless sanitize is set; only null and infinite ones aren't.
    """
    config = config or KalmanConfig()
    if sanitize:
        from skygauge.functions.config import StatisticalThresholds
        from skygauge.operators.statistical import present

        df = df.withColumns({c: present(c, StatisticalThresholds()) for c in CHANNELS})
    timed = minutes_since(df.select(F.col("station_id").cast("int"), "row_id", "ts", *CHANNELS, *(["rn"] if "rn" in df.columns else [])), config, chunk_rows)
    checks = [f"{c}_reference" for c in CHANNELS]
    if references is None:
        timed = timed.withColumns({c: F.lit(None).cast("double") for c in checks})
    else:
        known = references.select(F.col("station_id").alias("_s"), F.col("row_id").alias("_r"), *(F.col(c).alias(f"{c}_reference") for c in CHANNELS))
        timed = timed.join(known, F.col("station_id").eqNullSafe(F.col("_s")) & F.col("row_id").eqNullSafe(F.col("_r")), "left").drop("_s", "_r")
    timed = stored(timed.select("station_id", "row_id", "ts", "rn", "chunk", "dt", *CHANNELS, *checks))
    dealt = lambda rows: rows.repartition("station_id", "chunk").sortWithinPartitions("station_id", "chunk", "rn")
    elements = stored(dealt(timed).mapInPandas(partial(_by_chunk, run=partial(_elements, config=config)), ELEMENTS))
    starts = starts_of(elements, config, group)
    # A chunk's start goes before its rows, with row number 0 (and an id, as pandas would round ids beside a null).
    zero = F.lit(0).cast("long")
    first = starts.select("station_id", zero.alias("row_id"), "chunk", zero.alias("rn"), "start")
    rows = timed.withColumn("rn", F.col("rn").cast("long")).unionByName(first, allowMissingColumns=True)
    return dealt(rows).mapInPandas(partial(_by_chunk, run=partial(_states, config=config)), OUTPUT)


def intervals(tracked: DataFrame) -> DataFrame:
    """tracked with 95 % intervals of the true value and of the bias."""
    return tracked.withColumns({f"{c}_{x}_ci95_{side}": F.col(f"{c}_{x}") + sign * 1.96 * F.col(f"{c}_{x}_std")
        for c in CHANNELS for x in ("true", "bias") for side, sign in (("lower", -1), ("upper", 1))})


def views(tracked: DataFrame) -> dict[str, DataFrame]:
    """The state, bias, residual and uncertainty parts of the wide table."""
    pick = lambda *kinds: tracked.select("station_id", "row_id", "ts", *(f"{c}_{k}" for k in kinds for c in CHANNELS))
    residuals = tracked.select("station_id", "row_id", "ts", *(f"{c}_{k}" for k in ("innovation", "post_fit_residual") for c in CHANNELS), "nis")
    return {"state": pick("true", "rate"), "bias": pick("bias", "bias_std"), "residuals": residuals, "uncertainty": pick("true_std", "bias_std")}


def _stacked(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(station_id, rn, sensor, ...) with the columns {channel}_{kind} as kinds' names."""
    return df.select("station_id", "rn", F.inline(F.array(*(F.struct(F.lit(c).alias("sensor"), *(F.col(f"{c}_{k}").alias(n) for k, n in kinds.items())) for c in CHANNELS))))


def summary(tracked: DataFrame) -> DataFrame:
    """Mean, deviation and root mean square of the residuals, and the last bias, by station and sensor."""
    rows = _stacked(tracked, {"post_fit_residual": "e", "bias": "bias"})
    some = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.groupBy("station_id", "sensor").agg(some(F.avg("e")).alias("residual_mean"), some(F.stddev_samp("e")).alias("residual_std"),
        some(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("residual_rmse"), F.max_by("bias", "rn").alias("final_bias"))


def evaluation(tracked: DataFrame, truth: DataFrame, biases: DataFrame | None = None) -> DataFrame:
    """Root mean square errors against known truth, raw and filtered, and the reduction in per cent."""
    keys = ["station_id", "row_id"]
    joined = tracked.join(truth.select(*keys, *(F.col(c).alias(f"{c}_truth") for c in CHANNELS)), keys)
    if biases is not None:
        joined = joined.join(biases.select(*keys, *(f"{c}_true_bias" for c in CHANNELS)), keys)
    else:
        joined = joined.withColumns({f"{c}_true_bias": F.lit(None).cast("double") for c in CHANNELS})
    rows = _stacked(joined, {"observed": "z", "true": "x", "truth": "t", "bias": "b", "true_bias": "tb"})
    rmse: Column = lambda a, b: F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2)))
    found = rows.groupBy("station_id", "sensor").agg(rmse("z", "t").alias("raw_rmse"), rmse("x", "t").alias("filtered_rmse"), rmse("b", "tb").alias("bias_rmse"),
        F.max_by("tb", "rn").alias("true_final_bias"), F.max_by("b", "rn").alias("estimated_final_bias"))
    return found.withColumn("reduction_percent", 100.0 * F.try_divide(F.col("raw_rmse") - F.col("filtered_rmse"), F.col("raw_rmse")))
