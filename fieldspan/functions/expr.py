"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_positive(x: Column | str) -> Column:
    """ln of positive values, NULL for all others."""
    return F.when(col(x) > 0, F.ln(col(x)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def inside(x: Column | str, low: float, high: float) -> Column:
    """The value, or NULL outside the range."""
    return F.when(col(x).between(low, high), col(x))


def half_month(day: Column | str) -> Column:
    """0 to 23: two for each month, split after the 15th."""
    return ((F.month(day) - 1) * 2 + (F.dayofmonth(day) > 15).cast("int")).cast("int")


def circular_month(month: Column | str, k: int) -> Column:
    """1 to 12, k months on."""
    return F.pmod(col(month) - 1 + k, F.lit(12)) + 1


def stage(year: Column | str, cuts: tuple[tuple[int, str], ...], last: str) -> Column:
    """The name of the first period whose final year is not before ``year``."""
    out = None
    for end, name in cuts:
        test = col(year) <= end
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(last)) if out is not None else F.lit(last)


def degree_days(tmin: Column | str, tmax: Column | str, base: float) -> Column:
    """Single-sine degree-days of a day above ``base``; NULL if an end is NULL.

    With mean M and half-range A: nothing if the day stays below, M - base if it stays above, and
    else the area of the sine above the base.
    """
    lo, hi = col(tmin), col(tmax)
    mean, half = (hi + lo) / 2, (hi - lo) / 2
    turn = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.lit(base) - mean) / F.nullif(half, F.lit(0.0)))))
    area = ((mean - base) * (F.lit(math.pi / 2) - turn) + half * F.cos(turn)) / F.lit(math.pi)
    return (
        F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("double"))
        .when(half <= 0, F.greatest(mean - base, F.lit(0.0)))
        .when(hi <= base, F.lit(0.0))
        .when(lo >= base, mean - base)
        .otherwise(area)
    )


def daily_mean_days(tmin: Column | str, tmax: Column | str, base: float) -> Column:
    return F.greatest((col(tmin) + col(tmax)) / 2 - base, F.lit(0.0))


def significant(x: Column | str, digits: int = 6) -> Column:
    """Rounded to so many significant digits."""
    v = col(x)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * scale, 0) / scale)
