"""Physical-consistency flags and derived humidity quantities, one projection and no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions import thermo
from skygauge.functions.config import PhysicsThresholds

DERIVED = ("saturation_vapor_pressure_hpa", "actual_vapor_pressure_hpa", "dew_point_c", "absolute_humidity_gm3")
THERMO_FLAGS = ("flag_rh_out_of_bounds", "flag_dew_point_exceeds_temp", "flag_vapor_exceeds_pressure", "flag_ah_unphysical", "flag_temp_out_of_bounds", "flag_pressure_out_of_bounds")
WIND_FLAGS = ("flag_wind_negative", "flag_wind_exceeds_typical", "flag_wind_exceeds_extreme")
FLAGS = (*THERMO_FLAGS, "flag_t_p_rh_physics_violation", *WIND_FLAGS, "flag_wind_physics_violation")


def sure(condition: Column) -> Column:
    """A condition that is false where it can't be told."""
    return F.coalesce(condition, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def derived(df: DataFrame) -> DataFrame:
    t, rh = F.col("temperature"), F.col("humidity")
    df = df.withColumns({DERIVED[0]: thermo.saturation_vapor_pressure(t), DERIVED[1]: thermo.vapor_pressure(t, rh), DERIVED[2]: thermo.dew_point(t, rh)})
    return df.withColumn(DERIVED[3], thermo.absolute_humidity(t, F.col(DERIVED[1])))


def check(df: DataFrame, limits: PhysicsThresholds | None = None) -> DataFrame:
    """df with the four derived columns and the eleven flags."""
    limits = limits or PhysicsThresholds()
    t, p, rh, ws = (F.col(x) for x in ("temperature", "pressure", "humidity", "wind_speed"))
    e, td, ah = (F.col(x) for x in DERIVED[1:])
    outside = lambda x, low, high: sure((x < low) | (x > high))
    df = derived(df).withColumns({
        "flag_rh_out_of_bounds": outside(rh, limits.rh_min, limits.rh_max),
        "flag_dew_point_exceeds_temp": sure(td > t + limits.dew_point_tolerance),
        "flag_vapor_exceeds_pressure": sure(e >= p),
        "flag_ah_unphysical": outside(ah, limits.absolute_humidity_min, limits.absolute_humidity_max),
        "flag_temp_out_of_bounds": outside(t, limits.temperature_min, limits.temperature_max),
        "flag_pressure_out_of_bounds": outside(p, limits.pressure_min, limits.pressure_max),
        "flag_wind_negative": sure(ws < limits.wind_min),
        "flag_wind_exceeds_typical": sure(ws > limits.wind_typical),
        "flag_wind_exceeds_extreme": sure(ws > limits.wind_extreme),
    })
    return df.withColumns({
        "flag_t_p_rh_physics_violation": any_of([F.col(x) for x in THERMO_FLAGS]),
        "flag_wind_physics_violation": F.col("flag_wind_negative") | F.col("flag_wind_exceeds_extreme"),
    })
