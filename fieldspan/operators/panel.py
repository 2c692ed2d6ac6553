"""Panel filters, windows and bins over (unit, year) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.functions.expr import col
from fieldspan.operators import spread


def positive_sample(df: DataFrame, variables: tuple[str, ...], flag: str | None = None) -> DataFrame:
    """Rows whose variables are all present and positive, and whose flag is 1."""
    tests = [F.col(v).isNotNull() & (F.col(v) > 0) for v in variables]
    if flag:
        tests.append(F.col(flag) == 1)
    return df.where(reduce(lambda a, b: a & b, tests))


def balanced(df: DataFrame, unit: str = "unit", year: str = "year") -> DataFrame:
    """Units that are there in every year that any unit has; the count of years is one row."""
    years = df.agg(F.count_distinct(year).alias("_all"))
    full = df.groupBy(unit).agg(F.count_distinct(year).alias("_own"))
    full = full.join(F.broadcast(years), F.col("_own") == F.col("_all")).select(unit)
    return df.join(full, unit, "left_semi")


def by_year(unit: str = "unit", year: str = "year"):
    return Window.partitionBy(unit).orderBy(year)


def adjacent_change(df: DataFrame, value: Column | str, unit: str = "unit", year: str = "year", name: str = "d") -> DataFrame:
    """Change since the year before; no row where that year is missing or a value is NULL."""
    w = by_year(unit, year)
    v = col(value)
    return df.withColumns({name: v - F.lag(v).over(w), "_gap": F.col(year) - F.lag(year).over(w)}).where((F.col("_gap") == 1) & F.col(name).isNotNull()).drop("_gap")


def winsorized(df: DataFrame, value: str | list[str], group: str = "year", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values moved to the group's percentiles, each column to its own; the group's numbers are joined back, so no group sits in one window."""
    values = [value] if isinstance(value, str) else value
    ends = spread.quantiles_of(df, values, [group], [low, high]).select(group, *[F.col(v).alias(f"_q_{v}") for v in values])
    moved = {v: F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), F.col(f"_q_{v}")[0]), F.col(f"_q_{v}")[1])) for v in values}
    return df.join(ends, group).withColumns(moved).drop(*[f"_q_{v}" for v in values])


def rolling(value: Column | str, kind: str, radius: int, least: int, order) -> Column:
    """Centred rolling ``avg`` or ``stddev_samp``, NULL with fewer than ``least`` values."""
    w = order.rowsBetween(-radius, radius)
    f = {"avg": F.avg, "stddev_samp": F.stddev_samp}[kind]
    return F.when(F.count(col(value)).over(w) >= least, f(col(value)).over(w))


def percent_rank_mean_ties(df: DataFrame, value: str, group: str, name: str) -> DataFrame:
    """Share of the group's values below or equal, ties at their average rank; NULLs have none."""
    return spread.percent_rank(df, value, [group], name)


def edges(df: DataFrame, value: str, n: int, by: list[str] | None = None) -> DataFrame:
    """Distinct quantile edges of n bins as the array ``edges``."""
    found = spread.quantiles(df, value, by or [], [k / n for k in range(n + 1)])
    return found.select(*(by or []), F.array_sort(F.array_distinct("q")).alias("edges"))


def left_closed_bin(value: Column | str, e: Column) -> Column:
    """0-based bin with [a, b) edges, the last closed, values outside moved to the end bins."""
    k = F.size(F.filter(e, lambda x: x <= col(value))) - 1
    return F.greatest(F.lit(0), F.least(k, F.size(e) - 2)).cast("int")


def right_closed_bin(value: Column | str, e: Column) -> Column:
    """0-based bin with (a, b] edges, the first closed."""
    k = F.size(F.filter(e, lambda x: x < col(value))) - 1
    return F.greatest(F.lit(0), k).cast("int")
