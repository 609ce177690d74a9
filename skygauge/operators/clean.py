"""Validity of each reading, cleaning and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, CleaningConfig
from skygauge.functions.rounding import half_even
from skygauge.operators.physics import DERIVED, any_of
from skygauge.operators.statistical import flag
from skygauge.plans import chunks

#: The physics flags that make a channel's reading invalid.
PHYSICS_OF = {
    "temperature": ("flag_temp_out_of_bounds",),
    "pressure": ("flag_pressure_out_of_bounds",),
    "humidity": ("flag_rh_out_of_bounds", "flag_dew_point_exceeds_temp", "flag_vapor_exceeds_pressure"),
    "wind_speed": ("flag_wind_physics_violation",),
}
VALID = tuple(f"is_valid_{c}" for c in CHANNELS)


def validity(df: DataFrame) -> DataFrame:
    """df, flagged, with is_valid_{channel} and is_all_valid."""
    bad = {c: any_of([F.col(flag(c, "missing")), *(F.col(x) for x in PHYSICS_OF[c]), F.col(flag(c, "stat_anomaly"))]) for c in CHANNELS}
    df = df.withColumns({f"is_valid_{c}": ~bad[c] for c in CHANNELS})
    return df.withColumn("is_all_valid", reduce(lambda a, b: a & b, (F.col(v) for v in VALID)))


def precise(c: str, x: Column) -> Column:
    """x at the sensor's precision; wind isn't negative."""
    return half_even(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))) if c == "wind_speed" else x, 2)


def imputed(values: dict[str, Column], df: DataFrame, config: CleaningConfig) -> DataFrame:
    """df (by chunk, without copies) with {name}_filled for each column of values.

    interpolate: on the line between the valid neighbours, or at the only one's value, no
    further than limit rows from either; ffill, bfill: the neighbour's value within limit
    rows; none: as it is; any other name: like interpolate, but only after a valid value.
    """
    strategy = config.strategy.lower()
    if strategy == "none":
        return df.withColumns({f"{k}_filled": v for k, v in values.items()})
    return fill_between(values, chunks.with_neighbours(df, values), config)


def fill_between(values: dict[str, Column], df: DataFrame, config: CleaningConfig) -> DataFrame:
    """df, with {name}_prev and {name}_next as chunks.with_neighbours() gives them, with {name}_filled instead."""
    strategy = config.strategy.lower()
    rn, out = F.col("rn"), {}
    for k, v in values.items():
        before, after = F.col(f"{k}_prev"), F.col(f"{k}_next")
        since, until = rn - before["rn"], after["rn"] - rn
        near = F.coalesce(since <= config.limit, F.lit(False)), F.coalesce(until <= config.limit, F.lit(False))
        line = before["x"] + (after["x"] - before["x"]) * F.try_divide(since, after["rn"] - before["rn"])
        between = F.coalesce(line, before["x"], after["x"])
        out[f"{k}_filled"] = F.coalesce(v, {
            "interpolate": F.when(near[0] | near[1], between), "ffill": F.when(near[0], before["x"]), "bfill": F.when(near[1], after["x"]),
        }.get(strategy, F.when(near[0], between)))
    return df.withColumns(out).drop(*(f"{k}_{x}" for k in values for x in ("prev", "prior", "next")))


def clean(df: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    """df, with validity, with {channel}_cleaned."""
    values = {c: F.when(F.col(f"is_valid_{c}"), F.col(c)) for c in CHANNELS}
    df = imputed(values, df, config or CleaningConfig())
    return df.withColumns({f"{c}_cleaned": precise(c, F.col(f"{c}_filled")) for c in CHANNELS}).drop(*(f"{c}_filled" for c in CHANNELS))


def unified(df: DataFrame) -> DataFrame:
    """Raw, cleaned, derived and flag columns, in that order."""
    flags = [c for c in df.columns if c.startswith(("flag_", "is_"))]
    return df.select("station_id", "row_id", "ts", *CHANNELS, *(f"{c}_cleaned" for c in CHANNELS), *DERIVED, *flags)
