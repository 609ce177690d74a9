"""Quality control of a stream whose flags and fills look ahead.

A row's flags depend on a number of rows before and after it (statistical.halo()). released() holds a station's
readings in state until as many later ones are there, in order of time, and lets them go as a chunk
with copies of their neighbours on both sides: what a batch plan makes of a chunk holds for it, so flag_batches() flags the
chunks of each micro-batch with the very plan of the batch side. filled() then holds readings, with their flags, until what
fills their gaps is known: the next valid reading, or that there is none within the limit. So
neither batch borders nor the length of a gap makes a difference. What is held is bounded by the delay and the
frames, not by the history.

Readings are taken in order of time within the watermark's delay; those without a time, and later ones than the delay allows, are
left out. The last readings of a station wait for later ones. Where a history ends, `close_after` says after what time without one they go with the
frames they have; timers see to it, once the watermark has come that far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skygauge.functions.config import CHANNELS, CleaningConfig, StatisticalThresholds
from skygauge.operators import clean, physics, statistical
from skygauge.plans.telemetry import QualityConfig
from skygauge.plans.chunks import CHUNK_ROWS
from skygauge.streaming.live import ENTRY, STATION, _keyed, _named, held, hold, keep, ordered, records, taken

_KEY = [T.StructField("station", T.IntegerType()), T.StructField("no_station", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("no_row", T.BooleanType()), T.StructField("at", T.LongType())]
CHUNKS = T.StructType([*_KEY, *(T.StructField(c, T.DoubleType()) for c in CHANNELS), T.StructField("rn", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("core", T.BooleanType())])


def micros(interval: str | None) -> int | None:
    return None if interval is None else pd.Timedelta(interval).value // 1000


HELD_ROW = records(*CHANNELS)


class ReleaseProcessor(StatefulProcessor):
    """A station's readings that wait for later ones, and the last `halo` of those that have gone, which the next will need as neighbours."""

    def __init__(self, halo: int, close_after: int | None) -> None:
        self.halo, self.close_after = halo, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ENTRY)
        self.place = handle.getValueState("place", "gone long, before long, chunk long")  # of the rows held; in all; chunks so far

    def _let_go(self, key: tuple, rows: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Those rows, of all that are held in order, whose neighbours are there, in chunks of CHUNK_ROWS at most."""
        gone, before, chunk = self.place.get() if self.place.exists() else (0, 0, 0)
        settled = int((rows["at"] <= watermark).sum())  # nothing can come before them any more
        closing = self.close_after is not None and len(rows) > gone and watermark >= int(rows["at"][-1]) + self.close_after
        until = settled if closing else max(gone, settled - self.halo)
        for first in range(gone, until, CHUNK_ROWS):
            end = min(until, first + CHUNK_ROWS)
            low, high = max(0, first - self.halo), min(settled, end + self.halo)
            out = pd.DataFrame({c: rows[c][low:high] for c in HELD_ROW.names}).assign(station=key[0], no_station=key[1], chunk=chunk)
            place = np.arange(low, high)
            out["core"], out["rn"] = (place >= first) & (place < end), before - gone + place + 1
            chunk += 1
            yield out[CHUNKS.names]
        if until > gone:
            low = max(0, until - self.halo)
            before, rows, gone = before + until - gone, rows[low:], until - low
        hold(self.rows, rows)
        self.place.update((gone, before, chunk))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rows) > gone:
            last = int(rows["at"][-1])
            for after in (last, *([] if self.close_after is None else [last + self.close_after])):
                if after > watermark:
                    self.handle.registerTimer(after // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        everything = np.concatenate([held(self.rows, HELD_ROW), taken(rows, HELD_ROW)])
        yield from self._let_go(key, everything[ordered(everything)], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._let_go(key, held(self.rows, HELD_ROW), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def released(stream: DataFrame, limits: StatisticalThresholds | None = None, delay: str = "1 hour", close_after: str | None = None) -> DataFrame:
    """Readings in chunks (station_id, row_id, ts, channels, rn, chunk, core) once their neighbours are there; core tells them from the copies around them."""
    keyed = _keyed(stream.where("ts IS NOT NULL").withWatermark("ts", delay), *CHANNELS)
    processor = ReleaseProcessor(statistical.halo(limits or StatisticalThresholds()), micros(close_after))
    return _named(keyed.groupBy(*STATION).transformWithStateInPandas(processor, CHUNKS, "Append", "EventTime"))


def flag_batches(sink: Callable[[DataFrame, int], None], fences: Callable[[], DataFrame], config: QualityConfig | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on released(): sink gets the flagged readings with their validity, as telemetry.flagged() makes them of a whole history, and the batch's number, by
    which it can tell a batch that is run again. fences() gives the IQR fences of the history (statistical.fences()), from a table that is kept elsewhere."""
    config = config or QualityConfig()

    def run(batch: DataFrame, number: int) -> None:
        sink(clean.validity(statistical.check_chunks(physics.check(batch, config.physics), config.statistical, known=fences())), number)

    return run


NEIGHBOURS = ("prev_rn", "prev_x", "next_rn", "next_x")
ENDS = [f"{c}_{x}" for c in CHANNELS for x in NEIGHBOURS]
FILLED = T.StructType([*_KEY, T.StructField("rn", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in CHANNELS), *(T.StructField(v, T.BooleanType()) for v in clean.VALID), *(T.StructField(x, T.LongType() if x.endswith("rn") else T.DoubleType()) for x in ENDS)])
HELD = [f.name for f in FILLED.fields if f.name not in ("station", "no_station")]


class FillProcessor(StatefulProcessor):
    """The last valid reading of each of a station's channels, and those readings, with their neighbours as far as known, whose next valid one matters
    and isn't there yet. Of a gap these are the first `limit` rows, and the last ones that have come."""

    def __init__(self, limit: int, close_after: int | None) -> None:
        self.limit, self.close_after = limit, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([f for f in FILLED.fields if f.name in HELD]))
        self.last = handle.getValueState("last", "newest long, at long, rn array<long>, x array<double>")

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=HELD)

    def _let_go(self, key: tuple, held: pd.DataFrame, came: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        newest, at, last_rn, last_x = self.last.get() if self.last.exists() else (0, 0, [0] * len(CHANNELS), [float("nan")] * len(CHANNELS))
        last_rn, last_x = list(last_rn), list(last_x)
        if len(came):
            newest, at = max(newest, int(came["rn"].max())), max(at, int(came["at"].max()))
            rn = came["rn"].to_numpy(np.int64)
            for i, c in enumerate(CHANNELS):
                x, valid = came[c].to_numpy(float), came[f"is_valid_{c}"].to_numpy(bool)
                places = np.flatnonzero(valid)
                rns, xs = np.r_[last_rn[i], rn[places], 0], np.r_[last_x[i], x[places], np.nan]
                before, after = np.searchsorted(places, np.arange(len(came)), "right"), np.searchsorted(places, np.arange(len(came)), "left") + 1
                came = came.assign(**{f"{c}_prev_rn": rns[before], f"{c}_prev_x": xs[before], f"{c}_next_rn": rns[after], f"{c}_next_x": xs[after]})
                if len(places) and len(held):
                    waits = (held[f"{c}_next_rn"] == 0).to_numpy()
                    held.loc[waits, f"{c}_next_rn"], held.loc[waits, f"{c}_next_x"] = rns[1], xs[1]
                last_rn[i], last_x[i] = int(rns[len(places)]), float(xs[len(places)])
        rows = pd.concat([held, came[HELD]], ignore_index=True) if len(held) and len(came) else came[HELD] if len(came) else held
        ready, closing = np.ones(len(rows), bool), self.close_after is not None and watermark >= at + self.close_after
        for c in CHANNELS:
            near = (rows[f"{c}_prev_rn"] > 0) & (rows["rn"] - rows[f"{c}_prev_rn"] <= self.limit)
            ready &= (rows[f"is_valid_{c}"] | (rows[f"{c}_next_rn"] > 0) | (~near & (newest - rows["rn"] >= self.limit)) | closing).to_numpy(bool)
        stay = rows[~ready]
        keep(self.rows, [tuple(r) for r in stay.astype(object).itertuples(index=False)])
        self.last.update((newest, at, last_rn, last_x))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(stay) and self.close_after is not None:
            self.handle.registerTimer((at + self.close_after) // 1000 + 1)
        if ready.any():
            yield rows[ready].assign(station=key[0], no_station=key[1])[FILLED.names]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows), ignore_index=True).sort_values("rn", kind="stable", ignore_index=True)
        yield from self._let_go(key, self._held(), came, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._let_go(key, self._held(), pd.DataFrame(columns=HELD), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def filled(flagged: DataFrame, config: CleaningConfig | None = None, delay: str = "1 hour", close_after: str | None = None) -> DataFrame:
    """A stream of flagged readings (with rn and validity, a station's in order of its numbers) with {channel}_cleaned, as clean.clean() makes it of a whole history."""
    config = config or CleaningConfig()
    keyed = _keyed(flagged.withWatermark("ts", delay), *CHANNELS, *clean.VALID, "rn")
    found = _named(keyed.groupBy(*STATION).transformWithStateInPandas(FillProcessor(config.limit, micros(close_after)), FILLED, "Append", "EventTime"))
    ends = {f"{c}_{side}": F.when(F.col(f"{c}_{side}_rn") > 0, F.struct(F.col(f"{c}_{side}_rn").alias("rn"), F.col(f"{c}_{side}_x").alias("x"))) for c in CHANNELS for side in ("prev", "next")}
    values = {c: F.when(F.col(f"is_valid_{c}"), F.col(c)) for c in CHANNELS}
    found = clean.fill_between(values, found.withColumns(ends).drop(*ENDS), config)
    return found.withColumns({f"{c}_cleaned": clean.precise(c, F.col(f"{c}_filled")) for c in CHANNELS}).drop(*(f"{c}_filled" for c in CHANNELS))
