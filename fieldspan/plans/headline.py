"""The headline path: sample, residual, gap-guarded growth, winsorizing, aggregation, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldspan.functions.expr import ratio, stage
from fieldspan.operators import index as I, panel as P
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import DIRTY_SQL, HOLES_SQL, PANEL_SQL, VARS, dirtied, panel, with_holes

_POSITIVE = " AND ".join(f"{v} > 0" for v in VARS)
SOLOW_SQL = "ln(y)-0.20*ln(x_l)-0.25*ln(x_s)-0.15*ln(x_k)-0.40*ln(x_m)"
GROWTH_SQL = HOLES_SQL + f""", tfp AS (SELECT unit, year, y, {SOLOW_SQL} AS v FROM holes WHERE {_POSITIVE}),
 growth AS (SELECT unit, year, v - pv AS dln FROM (SELECT unit, year, v, lag(v) OVER w AS pv, lag(year) OVER w AS py FROM tfp WINDOW w AS (PARTITION BY unit ORDER BY year)) WHERE year - py = 1),
 ends AS (SELECT year, quantile_cont(dln, 0.01) AS lo, quantile_cont(dln, 0.99) AS hi FROM growth GROUP BY year),
 wins AS (SELECT unit, growth.year AS year, least(greatest(dln, lo), hi) AS dln FROM growth JOIN ends ON growth.year = ends.year)"""
NATIONAL_SQL = GROWTH_SQL + """, pairs AS (SELECT w.year AS year, w.dln AS dln, a.y AS w1, b.y AS w0 FROM wins w JOIN tfp a ON a.unit=w.unit AND a.year=w.year JOIN tfp b ON b.unit=w.unit AND b.year=w.year-1),
 shares AS (SELECT year, dln, (w0/sum(w0) OVER (PARTITION BY year) + w1/sum(w1) OVER (PARTITION BY year))/2 AS share FROM pairs),
 yearly AS (SELECT year, count(*) AS n, avg(dln) AS dln_simple, sum(share*dln)/sum(share) AS dln_weighted, stddev_samp(dln) AS dln_sd FROM shares GROUP BY year),
 national AS (SELECT *, sum(dln_simple) OVER (ORDER BY year) AS cum_simple, sum(dln_weighted) OVER (ORDER BY year) AS cum_weighted, 100*(exp(dln_weighted)-1) AS growth_weighted FROM yearly)"""
STAGE_SQL = "CASE WHEN year <= 1997 THEN '1995-1997' WHEN year <= 1999 THEN '1998-1999' ELSE '2000-2001' END"


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positive_sample(with_holes(panel(spark, sf_dir)), VARS)


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.winsorized(I.unit_growth(sample(spark, sf_dir), I.solow()), "dln")


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = sample(spark, sf_dir).select("unit", "year", F.col("y").alias("w"))
    return I.tornqvist(growth(spark, sf_dir), weight)


@query("p01_analysis_sample", f"WITH {DIRTY_SQL} SELECT * FROM (SELECT *, CAST(CASE WHEN unit%5<>0 THEN 1 ELSE 0 END AS INT) AS ag FROM dirty) WHERE ag = 1 AND {_POSITIVE}")
def p01(spark, d):
    return P.positive_sample(dirtied(panel(spark, d)).withColumn("ag", (F.col("unit") % 5 != 0).cast("int")), VARS, "ag")


@query("p02_balanced_panel", f"WITH {HOLES_SQL} SELECT unit, year, y FROM holes WHERE unit IN (SELECT unit FROM holes GROUP BY unit HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM holes))")
def p02(spark, d):
    return P.balanced(with_holes(panel(spark, d))).select("unit", "year", "y")


@query("p13_stage_bucketing", f"WITH {PANEL_SQL} SELECT {STAGE_SQL} AS stage, count(*) AS n, round(avg(y),1) AS mean_y FROM panel GROUP BY 1")
def p13(spark, d):
    rows = panel(spark, d).withColumn("stage", stage("year", *I.STAGES))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 1).alias("mean_y"))


@query("e04_solow_residual", f"WITH {HOLES_SQL} SELECT unit, year, round({SOLOW_SQL},8) AS ln_tfp FROM holes WHERE {_POSITIVE}")
def e04(spark, d):
    return sample(spark, d).select("unit", "year", F.round(I.solow(), 8).alias("ln_tfp"))


@query("w03_gap_guarded_growth", f"WITH {GROWTH_SQL} SELECT unit, year, round(dln,8) AS dln FROM growth")
def w03(spark, d):
    return rounded(I.unit_growth(sample(spark, d), I.solow()))


@query("w08_winsorized_growth", f"WITH {GROWTH_SQL} SELECT unit, year, round(dln,8) AS dln FROM wins")
def w08(spark, d):
    return rounded(growth(spark, d).select("unit", "year", "dln"))


@query("e05_tornqvist", f"WITH {NATIONAL_SQL} SELECT year, n, round(dln_simple,8) AS dln_simple, round(dln_weighted,8) AS dln_weighted, round(dln_sd,8) AS dln_sd, round(cum_simple,8) AS cum_simple, round(cum_weighted,8) AS cum_weighted, round(growth_weighted,6) AS growth_weighted FROM national")
def e05(spark, d):
    return rounded(national(spark, d), growth_weighted=6)


@query("e06_mean_growth", f"WITH {NATIONAL_SQL} SELECT round(100*(exp(arg_max(cum_weighted, year)/(max(year)-min(year)))-1),6) AS mean_growth, CAST(max(year)-min(year) AS INT) AS span FROM national")
def e06(spark, d):
    """The cumulated index holds the first year's growth too; the span is last year less first."""
    span = (F.max("year") - F.min("year")).cast("int")
    total = F.max_by("cum_weighted", "year")
    return national(spark, d).agg(F.round(100 * (F.exp(total / span) - 1), 6).alias("mean_growth"), span.alias("span"))


_STAGES = f"WITH {NATIONAL_SQL} SELECT {STAGE_SQL} AS stage, count(*) AS years, round(100*(exp(avg(dln_weighted))-1),6) AS growth, round(100*stddev_samp(dln_weighted),6) AS sd FROM national GROUP BY 1"


@query("e07_stage_table", _STAGES)
def e07(spark, d):
    rows = national(spark, d).withColumn("stage", stage("year", *I.STAGES))
    return rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("years"), F.round(100 * (F.exp(F.avg("dln_weighted")) - 1), 6).alias("growth"), F.round(100 * F.stddev_samp("dln_weighted"), 6).alias("sd")
    )


@query("w02_first_difference", f"WITH {NATIONAL_SQL} SELECT year, round(cum_weighted - lag(cum_weighted) OVER (ORDER BY year),8) AS d FROM national")
def w02(spark, d):
    w = Window.orderBy("year")  # a row per year
    return national(spark, d).select("year", F.round(F.col("cum_weighted") - F.lag("cum_weighted").over(w), 8).alias("d"))


@query("w04_cumulative_sum", f"WITH {PANEL_SQL} SELECT unit, year, round(sum(y) OVER (PARTITION BY unit ORDER BY year),4) AS cum_y FROM panel")
def w04(spark, d):
    w = P.by_year().rowsBetween(Window.unboundedPreceding, 0)
    return panel(spark, d).select("unit", "year", F.round(F.sum("y").over(w), 4).alias("cum_y"))


@query("p10_ratios", f"WITH {PANEL_SQL} SELECT unit, year, round(y/nullif(x_l,0),8) AS y_l, round(x_k/nullif(x_l,0),8) AS k_l, round(x_m/nullif(x_l,0),8) AS m_l, round(x_s/nullif(x_l,0),8) AS s_l, round(x_m/nullif(y,0),8) AS m_y FROM panel")
def p10(spark, d):
    pairs = {"y_l": ("y", "x_l"), "k_l": ("x_k", "x_l"), "m_l": ("x_m", "x_l"), "s_l": ("x_s", "x_l"), "m_y": ("x_m", "y")}
    return panel(spark, d).select("unit", "year", *[F.round(ratio(a, b), 8).alias(k) for k, (a, b) in pairs.items()])
