"""Humidity thermodynamics as column expressions, after Magnus. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(x: Column, low: float) -> Column:
    """max(x, low) that keeps nulls, which greatest() would skip."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = at_least(x, low)
    return x if high is None else F.when(x.isNotNull(), F.least(x, F.lit(high)))


def saturation_vapor_pressure(t: Column) -> Column:
    """hPa over water, t in °C."""
    return F.lit(6.112) * F.exp(F.try_divide(F.lit(17.67) * t, t + F.lit(243.5)))


def vapor_pressure(t: Column, rh: Column) -> Column:
    """hPa; a negative humidity counts as 0 %."""
    return saturation_vapor_pressure(t) * at_least(rh, 0.0) / F.lit(100.0)


def dew_point(t: Column, rh: Column) -> Column:
    """°C, with the humidity ratio held between 0.0001 and 1.5."""
    gamma = F.try_divide(F.lit(17.67) * t, F.lit(243.5) + t) + F.ln(clamp(rh / F.lit(100.0), 1e-4, 1.5))
    return F.try_divide(F.lit(243.5) * gamma, F.lit(17.67) - gamma)


def absolute_humidity(t: Column, e: Column) -> Column:
    """g/m³."""
    return F.try_divide(F.lit(216.7) * e, t + F.lit(273.15))


def dew_point_depression(t: Column, rh: Column) -> Column:
    return t - dew_point(t, rh)
