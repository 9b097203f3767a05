"""Guarded arithmetic.

The workload has four distinct policies for a zero denominator.  Each has its own
function so that a caller has to say which one it means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_DENOMINATOR_FLOOR = 1.0


def floored(value: Column, floor: float) -> Column:
    """max(value, floor) that keeps null as null (plain ``greatest`` would return the floor)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def ratio_floored(num: Column, den: Column, floor: float = RATIO_DENOMINATOR_FLOOR) -> Column:
    """num / max(den, floor)."""
    return num / floored(den, floor)


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is zero."""
    return F.when(den != 0, num / den)


def ratio_or_one(num: Column, den: Column) -> Column:
    """num / den, 1 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(1.0))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Asymmetric closeness: the tolerance scales with the second argument."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def fixed(value: Column, digits: int = 6) -> Column:
    """Half-up rounding by plain IEEE arithmetic; ties are recognised to within float noise.

    Engines that sum in another order then still round alike, and -0.0 becomes 0.0.  Null, NaN and
    the infinities stay what they are, and so do values too large to have that many digits.
    """
    scale = float(10**digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.500001)).cast("double") / F.lit(scale)
    return F.when(F.abs(value) < F.lit(2.0**53 / scale), rounded).otherwise(value)


def count_where(condition: Column) -> Column:
    """Number of rows where the condition is true, 0 for an empty group."""
    return F.count(F.when(condition, F.lit(1)))


def no_nan(value: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
