"""Rounding and clamping as Column expressions that give the same doubles in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """x rounded half towards positive infinity; on doubles, unlike round(), which rounds half away from zero."""
    k = 10.0**digits
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """Whether x is a number: not null, not NaN and not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def percent_change(a: Column, b: Column) -> Column:
    """From a to b in per cent of |a|; 0 where a is 0."""
    return F.coalesce(F.try_divide(b - a, F.abs(a)) * F.lit(100.0), F.lit(0.0))
