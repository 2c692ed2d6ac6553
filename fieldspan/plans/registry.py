"""Named queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8, **other: int) -> DataFrame:
    """Doubles to so many decimals, so that engines that sum in another order agree."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, other.get(c, digits)) + F.lit(0.0) for c, t in df.dtypes if t == "double"})
