"""Order statistics and running extremes of groups of any size, spread over tasks.

A group's rows are dealt into buckets of neighbouring values, whose bounds a mergeable sketch of the
group gives. Windows run inside a bucket; what the buckets before it hold, a few numbers each, is summed
up and joined. Bounds only deal the rows, so results are exact. Groups of at most ``most`` rows take
one window or one aggregation buffer instead; both ways give the same rows. Group keys are not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256
MOST = 1_000_000  #: rows of a group that one task may order


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return (df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))).agg(F.max("count")).first()[0] or 0


def bucketed(df: DataFrame, value: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``_b``: buckets of a group are in the order of value, equal values in one; NULLs in the first."""
    points = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, points, F.lit(20 * buckets))).alias("_cuts"))
    return df.join(cuts, by).withColumn("_b", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(value)))).drop("_cuts")


def _before(df: DataFrame, by: list[str], name: str, own: Column, total) -> DataFrame:
    """by, _b and ``name``: ``total`` (an aggregate function) of the buckets' ``own`` aggregates, over the buckets before."""
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*by, "_b").agg(own.alias("_own")).select(*by, "_b", total("_own").over(w).alias(name))


def quantiles(df: DataFrame, value: str, by: list[str], probabilities: list[float], most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """by and ``q``, the group's quantiles with linear interpolation; NULL values don't count, groups without any have NULL.

    Beyond ``most`` rows, the buckets' counts tell which of them hold the wanted places, and only their rows are ordered.
    """
    if largest(df, by) <= most:
        return (df.groupBy(*by) if by else df.groupBy()).agg(F.percentile(value, F.array(*[F.lit(p) for p in probabilities])).alias("q"))
    if not by:
        return quantiles(df.select(value, F.lit(0).alias("_every")), value, ["_every"], probabilities, most, buckets).select("q")
    rows = bucketed(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null"), "_v", by, buckets)
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)  # a row per bucket
    place = [(F.col("_all") - 1) * F.lit(p) for p in probabilities]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place])))
    known = counts.select(*by, "_b", "_n", F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"), F.sum("_n").over(whole).alias("_all"))
    known = known.withColumn("_at", F.filter(wanted, lambda k: (k >= F.col("_from")) & (k < F.col("_from") + F.col("_n")))).where(F.size("_at") > 0)
    nth = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1 + F.col("_from")
    found = rows.join(known.select(*by, "_b", "_from", "_at", "_all"), [*by, "_b"]).withColumn("_k", nth).where(F.array_contains("_at", F.col("_k")))
    held = found.groupBy(*by, "_all").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    mixed = [F.element_at("_m", F.floor(x)) + (F.element_at("_m", F.ceil(x)) - F.element_at("_m", F.floor(x))) * (x - F.floor(x)) for x in place]
    return df.select(*by).distinct().join(held.select(*by, F.array(*mixed).alias("q")), by, "left")


def quantiles_of(df: DataFrame, values: list[str], by: list[str], probabilities: list[float], most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """by and, under each value's name, its ``quantiles``; groups of at most ``most`` rows give all of them in one aggregation."""
    if largest(df, by) <= most:
        return df.groupBy(*by).agg(*[F.percentile(v, F.array(*[F.lit(p) for p in probabilities])).alias(v) for v in values])
    out = df.select(*by).distinct()
    for v in values:
        out = out.join(quantiles(df, v, by, probabilities, most, buckets).withColumnRenamed("q", v), by)
    return out


def percent_rank(df: DataFrame, value: str, by: list[str], name: str, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Share of the group's values below or equal, ties at their average rank; rows with NULL are left out."""
    rows = df.where(F.col(value).isNotNull())
    if largest(rows, by) <= most:
        w = Window.partitionBy(*by)
        rank, ties = F.rank().over(w.orderBy(value)), F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return rows.withColumn(name, (rank + (ties - 1) / 2) / F.count(F.lit(1)).over(w))
    rows = bucketed(rows, value, by, buckets)
    before = _before(rows, by, "_from", F.count(F.lit(1)), F.sum)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    rank, ties = F.rank().over(Window.partitionBy(*by, "_b").orderBy(value)), F.count(F.lit(1)).over(Window.partitionBy(*by, "_b", value))
    ranked = rows.withColumns({"_rank": rank, "_ties": ties}).join(before, [*by, "_b"]).join(totals, by)
    return ranked.withColumn(name, (F.coalesce("_from", F.lit(0)) + F.col("_rank") + (F.col("_ties") - 1) / 2) / F.col("_all")).select(*df.columns, name)


def running(df: DataFrame, value: str, by: list[str], order: list[str], name: str, kind: str = "max", own: bool = True, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """The running ``max`` or ``min`` of value in the order of numeric ``order[0]``, then the rest; without the row itself unless ``own``."""
    best, of_two = {"max": (F.max, F.greatest), "min": (F.min, F.least)}[kind]
    frame = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if largest(df, by) <= most:
        return df.withColumn(name, best(value).over(frame(Window.partitionBy(*by))))
    rows = bucketed(df, order[0], by, buckets)
    inside = rows.withColumn("_in", best(value).over(frame(Window.partitionBy(*by, "_b"))))
    return inside.join(_before(rows, by, "_from", best(value), best), [*by, "_b"]).withColumn(name, of_two("_in", "_from")).select(*df.columns, name)
