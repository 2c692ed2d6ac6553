"""Index numbers: input indices, residuals, weighted aggregation of growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.functions.expr import col, log_positive
from fieldspan.operators.panel import adjacent_change

ELASTICITIES = {"x_l": 0.20, "x_s": 0.25, "x_k": 0.15, "x_m": 0.40}
STAGES = (((1997, "1995-1997"), (1999, "1998-1999")), "2000-2001")


def elasticities(table: DataFrame | None, residual: str = "x_s") -> dict[str, float]:
    """Weights by input out of an (eq, term, coef) table; what one lacks is the rest to 1.

    Without a table, the defaults. A coefficient table has a row per term, so it is read whole.
    """
    if table is None:
        return dict(ELASTICITIES)
    found = {r["term"]: float(r["coef"]) for r in table.where("eq = 'frontier'").select("term", "coef").collect()}
    out = {k: found[k] for k in ELASTICITIES if k in found and k != residual}
    return out | {residual: 1.0 - sum(out.values())}


def solow(y: Column | str = "y", weights: dict[str, float] = ELASTICITIES) -> Column:
    """ln y minus the weighted logs of the inputs."""
    out = log_positive(y)
    for k, w in weights.items():
        out = out - w * log_positive(k)
    return out


def geometric_index(df: DataFrame, weights: dict[str, float], name: str = "x_index") -> DataFrame:
    """Fixed-weight geometric index: each input over its geometric mean, weights made to sum to 1."""
    total = sum(weights.values())
    means = df.groupBy().agg(*[F.avg(log_positive(k)).alias(f"_g_{k}") for k in weights])
    terms = [w / total * (log_positive(k) - F.col(f"_g_{k}")) for k, w in weights.items()]
    return df.join(F.broadcast(means)).withColumn(name, F.exp(sum(terms[1:], terms[0]))).drop(*[f"_g_{k}" for k in weights])


def crs_index(weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    terms = [w / total * log_positive(k) for k, w in weights.items()]
    return F.exp(sum(terms[1:], terms[0]))


def tornqvist(growth: DataFrame, weight: DataFrame) -> DataFrame:
    """National growth by year from unit growth (unit, year, dln) and weights (unit, year, w).

    Shares are over units with growth and a weight in both years; a unit's weight is the mean of
    its shares in the two years.
    """
    now, before = weight.select("unit", "year", F.col("w").alias("w1")), weight.select("unit", (F.col("year") + 1).alias("year"), F.col("w").alias("w0"))
    rows = growth.where("dln is not null").join(now, ["unit", "year"]).join(before, ["unit", "year"]).where("w0 > 0 and w1 > 0")
    totals = rows.groupBy("year").agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))
    rows = rows.join(totals, "year").withColumn("share", (F.col("w0") / F.col("t0") + F.col("w1") / F.col("t1")) / 2)
    national = rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dln").alias("dln_simple"),
        (F.sum(F.col("share") * F.col("dln")) / F.sum("share")).alias("dln_weighted"),
        F.stddev_samp("dln").alias("dln_sd"),
    )
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row per year
    return national.withColumns(
        {"cum_simple": F.sum("dln_simple").over(w), "cum_weighted": F.sum("dln_weighted").over(w), "growth_weighted": 100 * (F.exp("dln_weighted") - 1)}
    )


def weighted_growth(growth: DataFrame, weight: DataFrame, names: list[str]) -> DataFrame:
    """year, the ``tornqvist`` weighted growth of each named column, and its rows as ``n_`` and the name.

    Shares are among the column's own rows. Sums by year of growth times a year's weights over sums of those weights
    are the same, so that one pass serves all columns; a column without rows in a year is NULL there.
    """
    now, before = weight.select("unit", "year", F.col("w").alias("w1")), weight.select("unit", (F.col("year") + 1).alias("year"), F.col("w").alias("w0"))
    rows = growth.select("unit", "year", *names).join(now, ["unit", "year"]).join(before, ["unit", "year"]).where("w0 > 0 and w1 > 0")
    there = {k: F.col(k).isNotNull() for k in names}
    mean = lambda k, w: F.sum(F.col(w) * F.col(k)) / F.sum(F.when(there[k], F.col(w)))
    return rows.groupBy("year").agg(*[((mean(k, "w0") + mean(k, "w1")) / 2).alias(k) for k in names], *[F.count(k).alias(f"n_{k}") for k in names])


def unit_growth(df: DataFrame, value: Column) -> DataFrame:
    """unit, year, dln: gap-guarded growth of a log value."""
    return adjacent_change(df.withColumn("_v", value).where("_v is not null"), "_v", name="dln").select("unit", "year", "dln")


def lagged(df: DataFrame, *values: str) -> DataFrame:
    """Joins each row to the row of the year before; values get the suffix 0."""
    before = df.select("unit", (F.col("year") + 1).alias("year"), *[F.col(v).alias(f"{v}0") for v in values])
    return df.join(before, ["unit", "year"])


def named_sum(*terms: Column | str) -> Column:
    """Row-wise sum that is NULL only if all terms are."""
    cols = [col(t) for t in terms]
    any_there = cols[0].isNotNull()
    for c in cols[1:]:
        any_there = any_there | c.isNotNull()
    total = F.coalesce(cols[0], F.lit(0.0))
    for c in cols[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(any_there, total)
