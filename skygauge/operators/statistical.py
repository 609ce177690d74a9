"""Statistical flags of each channel: missing, IQR, rolling z-score, spikes and flatlines.

All row windows of all channels are taken in one pass over a chunk of a station's history, so
there is one shuffle and one sort for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from skygauge.functions.config import CHANNELS, StatisticalThresholds
from skygauge.operators import quantiles
from skygauge.operators.physics import any_of, sure
from skygauge.plans import chunks
from skygauge.plans.scratch import stored

#: Numbers in a block of frames, at most: 8 MB.
FRAME_CELLS = 1 << 20
KINDS = ("missing", "iqr_outlier", "zscore_outlier", "spike", "stuck", "stat_anomaly")


def flag(channel: str, kind: str) -> str:
    return f"flag_{channel}_{kind}"


def missing(x: Column, sentinels: tuple[float, ...]) -> Column:
    """Null, NaN, infinite or one of the sentinel values."""
    return x.isNull() | sure(F.isnan(x) | (F.abs(x) == float("inf")) | x.isin(*sentinels))


def present(channel: str, limits: StatisticalThresholds) -> Column:
    return F.when(~missing(F.col(channel), limits.sentinels), F.col(channel))


def fences(df: DataFrame, limits: StatisticalThresholds, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """A row a station: q1, q3, lower and upper of each channel.

    Quartiles are exact, linear between neighbours, whatever the resolution and length of the history.
    """
    quartiles = quantiles.exact(df, ["station_id"], {c: present(c, limits) for c in channels}, (0.25, 0.75))
    out = [F.col("station_id")]
    for c in channels:
        q1, q3 = F.col(c)[0], F.col(c)[1]
        reach = limits.iqr_multiplier * (q3 - q1)
        out += [q1.alias(f"{c}_q1"), q3.alias(f"{c}_q3"), (q1 - reach).alias(f"{c}_lower"), (q3 + reach).alias(f"{c}_upper")]
    return quartiles.select(*out)


def halo(limits: StatisticalThresholds) -> int:
    """How far the flags of a row can depend on its neighbours: two nested frames, or a window and its spread back."""
    return max(2 * limits.window, 4 * limits.stuck_window, 2)


def iqr_flags(df: DataFrame, limits: StatisticalThresholds, channels: tuple[str, ...] = CHANNELS, known: DataFrame | None = None) -> DataFrame:
    """df with the IQR flags, by its own fences or known ones. They are one row a station and join by size: broadcast if small. Its own are stored,
    so that Spark knows how small they are when it plans the join, and doesn't shuffle and sort the rows by station for it."""
    found = (stored(fences(df, limits, channels).coalesce(1)) if known is None else known).withColumnRenamed("station_id", "_s").select("_s", *(f"{c}_{x}" for c in channels for x in ("lower", "upper")))
    joined = df.join(found, F.col("station_id").eqNullSafe(F.col("_s")))
    flags = {flag(c, "iqr_outlier"): sure((present(c, limits) < F.col(f"{c}_lower")) | (present(c, limits) > F.col(f"{c}_upper"))) for c in channels}
    return joined.withColumns(flags).drop("_s", *(f"{c}_{x}" for c in channels for x in ("lower", "upper")))


def _frames(x: np.ndarray, back: int, forth: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Of each row its frame, from so many rows before it to so many after it, NaN beyond the ends; in blocks of some MB."""
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(back, np.nan), x, np.full(forth, np.nan)]), back + forth + 1)
    block = max(1, FRAME_CELLS // (back + forth + 1))
    for at in range(0, len(x), block):
        yield slice(at, at + block), frames[at : at + block]


def _medians(x: np.ndarray, back: int, forth: int, least: int) -> np.ndarray:
    """The median of the values in each row's frame, NaN where there are fewer than least."""
    out = np.empty(len(x))
    for rows, frames in _frames(x, back, forth):
        ordered, n = np.sort(frames, axis=1), (~np.isnan(frames)).sum(axis=1)  # NaN comes last
        at = lambda i: np.take_along_axis(ordered, np.maximum(i // 2, 0)[:, None], axis=1)[:, 0]  # noqa: B023, E731
        out[rows] = np.where(n >= least, 0.5 * at(n - 1) + 0.5 * at(n), np.nan)
    return out


def _moments(x: np.ndarray, back: int, forth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the values in each row's frame how many they are, their mean and sample variance; taken in as Spark's avg and var_samp do, one after another."""
    n, total, variance = np.zeros(len(x)), np.zeros(len(x)), np.empty(len(x))
    for rows, frames in _frames(x, back, forth):
        k, whole, mean, m2 = (np.zeros(len(frames)) for _ in range(4))
        for v in frames.T:
            there = ~np.isnan(v)
            k += there
            whole += np.where(there, v, 0.0)
            delta = np.where(there, v - mean, 0.0)
            share = delta / np.maximum(k, 1.0)
            mean += share
            m2 += delta * (delta - share)
        n[rows], total[rows], variance[rows] = k, whole, m2 / (k - 1.0)
    return n, total / n, variance


def _flags_of_chunk(table: pa.Table, limits: StatisticalThresholds, channels: tuple[str, ...]) -> pa.Table:
    """A chunk in order, with its flags."""
    table = table.sort_by("rn")
    half = limits.window // 2
    centred = half, limits.window - 1 - half  # pandas' centre of an even window
    least = max(3, limits.window // 4)
    for c in channels:
        x = table[c].cast(pa.float64()).to_numpy()
        x = np.where(np.isfinite(x) & ~np.isin(x, limits.sentinels), x, np.nan)
        if limits.robust:
            dev = np.abs(x - _medians(x, *centred, least))
            scale = 1.4826 * _medians(dev, *centred, least)
        else:
            n, mean, variance = _moments(x, *centred)
            dev = np.where(n >= least, np.abs(x - mean), np.nan)
            scale = np.where(n >= least, np.sqrt(variance), np.nan)
        step = limits.max_step.get(c, limits.default_step)
        edge = np.full(min(1, len(x)), np.nan)
        back, forth = np.abs(x - np.concatenate([edge, x[:-1]])), np.abs(x - np.concatenate([x[1:], edge]))
        n = limits.stuck_window * (2 if c == "wind_speed" else 1)
        held, _, variance = _moments(np.where(x > limits.calm, x, np.nan) if c == "wind_speed" else x, n - 1, 0)
        still = (held == n) & (variance <= limits.stuck_variance)
        ends = np.concatenate([[0], np.cumsum(still)])
        found = {
            "missing": np.isnan(x), "zscore_outlier": (scale > 0) & ~np.isnan(dev) & ~(dev / scale <= limits.zscore), "spike": ((back > step) & (forth > step)) | (back > 1.75 * step),
            "stuck": ends[np.minimum(np.arange(len(x)) + n, len(x))] > ends[:-1],
        }
        for kind, flags in found.items():
            table = table.append_column(flag(c, kind), pa.array(flags))
    return table


def row_flags(df: DataFrame, limits: StatisticalThresholds, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """df (by chunk, with halo) with the flags that look at neighbouring rows. A chunk is an Arrow table in its task, and frames are numpy arrays side by side."""

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            return _flags_of_chunk(table, limits, channels)

    names = [flag(c, kind) for c in channels for kind in ("missing", "zscore_outlier", "spike", "stuck")]
    return df.groupBy("station_id", "chunk").applyInArrow(run, StructType([*df.schema.fields, *(StructField(x, BooleanType()) for x in names)]))


def check(df: DataFrame, limits: StatisticalThresholds | None = None, channels: tuple[str, ...] = CHANNELS, chunk_rows: int = chunks.CHUNK_ROWS, known: DataFrame | None = None) -> DataFrame:
    """df with rn, chunk and six flags a channel. known: fences of a longer history, if df is a part of one."""
    limits = limits or StatisticalThresholds()
    reach = halo(limits)
    flagged = iqr_flags(chunks.numbered(df), limits, channels, known)
    return _anomalies(chunks.cores(row_flags(chunks.chunked(flagged, reach, max(chunk_rows, reach)), limits, channels)), channels)


def check_chunks(df: DataFrame, limits: StatisticalThresholds | None = None, channels: tuple[str, ...] = CHANNELS, known: DataFrame | None = None) -> DataFrame:
    """check() of rows that are in chunks already, with copies of the neighbours within halo(): rn, chunk and core."""
    limits = limits or StatisticalThresholds()
    return _anomalies(chunks.cores(row_flags(iqr_flags(df, limits, channels, known), limits, channels)), channels)


def _anomalies(flagged: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    return flagged.withColumns({flag(c, "stat_anomaly"): any_of([F.col(flag(c, k)) for k in KINDS[1:5]]) & ~F.col(flag(c, "missing")) for c in channels})
