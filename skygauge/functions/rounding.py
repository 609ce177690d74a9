"""Rounding as numerical libraries do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: str | Column, digits: int) -> Column:
    """x at so many decimals, ties to the even neighbour; null stays null."""
    scale = float(10**digits)
    return F.rint((F.col(x) if isinstance(x, str) else x) * scale) / scale + F.lit(0.0)  # -0.0 becomes 0.0


def _exactly(x: Column, digits: int) -> Column:
    size, scale = F.abs(x), 10**digits
    whole = size - F.pmod(size, F.lit(1.0))
    part = size - whole  # exact
    # The product with the scale, and what its rounding left out: both halves of part have few enough bits for exact products.
    split = part * F.lit(134217729.0)
    high = split - (split - part)
    product = part * F.lit(float(scale))
    rest = (high * F.lit(float(scale)) - product) + (part - high) * F.lit(float(scale))
    tie = F.abs(product - F.rint(product)) == 0.5
    n = F.when(tie & (rest != 0.0), product + F.signum(rest) * 0.5).otherwise(F.rint(product)).cast("long")
    sign = F.when(F.format_string("%.0f", F.signum(x)).startswith("-"), "-").otherwise("")
    text = F.format_string(f"%s%d.%0{digits}d", sign, whole.cast("long") + F.floor(n / scale), F.pmod(n, F.lit(scale)))
    return F.when(size < 2.0**53, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def fixed(x: str | Column, digits: int) -> Column:
    """x as text with one or two decimals, rounded by its exact binary value as C's printf does; null stays null.

    format_string rounds the shortest decimal that stands for x, so 24.65, which is a little less in binary, becomes
    24.7 there. Numbers of 2**53 or more, and those that aren't finite, are as format_string gives them.
    """
    # The array names x, which may be a long expression, once.
    return F.get(F.transform(F.array(F.col(x) if isinstance(x, str) else x), lambda v: _exactly(v, digits)), F.lit(0))
