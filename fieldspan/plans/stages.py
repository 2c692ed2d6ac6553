"""Stored stages: each query writes the panel or sums of it in some form and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspan.operators import regress as R
from fieldspan.plans.registry import query, rounded
from fieldspan.sources import tables as S
from fieldspan.sources.tables import HOLES_SQL, INPUTS, PANEL_SQL, panel, with_holes

_SUMS = f"WITH {PANEL_SQL} SELECT unit, year, round(y,4) AS y, round(x_l,4) AS x_l FROM panel"


def sums(spark, d):
    return panel(spark, d).select("unit", "year", F.round("y", 4).alias("y"), F.round("x_l", 4).alias("x_l"))


@query("s02_csv_scan", _SUMS)
def s02(spark, d):
    """Through headed CSV files under a stated schema."""
    path = S.stage_path(spark, "sums-csv")
    S.write_csv(sums(spark, d), path, ["unit", "year"])
    return S.read_csv(spark, path, "unit int, year int, y double, x_l double")


@query("s03_pruned_csv_scan", f"WITH {PANEL_SQL} SELECT unit, round(sum(y),4) AS y FROM panel GROUP BY unit")
def s03(spark, d):
    """Two of a CSV file's columns are parsed."""
    path = S.stage_path(spark, "panel-csv")
    S.write_csv(panel(spark, d), path, ["unit", "year"])
    names = "unit int, sid int, region int, year int, y double, x_l double, x_s double, x_k double, x_m double"
    return S.read_csv(spark, path, names).groupBy("unit").agg(F.round(F.sum("y"), 4).alias("y"))


@query("s04_yearly_stages", _SUMS)
def s04(spark, d):
    """Years are written in two runs; the second replaces one year of the first and leaves the others."""
    path = S.stage_path(spark, "years")
    rows = sums(spark, d)
    S.write_years(rows.where("year <= 1999").withColumn("y", F.when(F.col("year") == 1999, F.lit(-1.0)).otherwise(F.col("y"))), path)
    S.write_years(rows.where("year >= 1999"), path)
    return spark.read.parquet(path).select("unit", F.col("year").cast("int").alias("year"), "y", "x_l")


@query("s05_all_or_nothing", _SUMS)
def s05(spark, d):
    """A stage with a failed row writes nothing; without one it writes all."""
    path = S.stage_path(spark, "complete")
    rows = sums(spark, d)
    if S.write_complete(rows.withColumn("y", F.when(F.col("year") != 1998, F.col("y"))), path, F.col("y").isNull()) or S.exists(spark, path):
        raise AssertionError("a failed stage was written")
    S.write_complete(rows, path, F.col("y").isNull())
    return spark.read.parquet(path)


@query("s09_extended_years", _SUMS)
def s09(spark, d):
    """A stage of the first years is extended by those that it lacks."""
    path = S.stage_path(spark, "extended")
    rows = sums(spark, d)
    rows.where("year < 1998").write.partitionBy("year").parquet(path)
    S.extend_years(rows, path)
    return spark.read.parquet(path).select("unit", F.col("year").cast("int").alias("year"), "y", "x_l")


@query("s11_cached_stage", _SUMS)
def s11(spark, d):
    """The second call reads what the first has built; a forced one builds anew."""
    path = S.stage_path(spark, "cached")
    S.cached(spark, path, lambda: sums(spark, d).withColumn("y", F.lit(0.0)))
    S.cached(spark, path, lambda: sums(spark, d), force=True)
    return S.cached(spark, path, lambda: sums(spark, d).limit(0))


@query("s12_grid_probe", f"WITH {PANEL_SQL} SELECT CAST(count(*) AS BIGINT) AS cells, min(year) AS least_year, max(year) AS most_year, min(unit) AS least_unit, max(unit) AS most_unit FROM panel")
def s12(spark, d):
    """The panel's grid of units and years, read off the data."""
    return S.probed(panel(spark, d), ["year", "unit"], 1.0).select("cells", "least_year", "most_year", "least_unit", "most_unit")


@query("s13_required_columns", f"WITH {PANEL_SQL} SELECT unit, year, round(y,4) AS y FROM panel")
def s13(spark, d):
    """The columns that a step needs are asked for before it runs."""
    return rounded(S.require(panel(spark, d), "unit", "year", "y").select("unit", "year", "y"), 4)


@query("s14_csv_sink", f"WITH {HOLES_SQL} SELECT sid, year, round(sum(y),4) AS y, CAST(count(*) AS BIGINT) AS n FROM holes GROUP BY 1,2")
def s14(spark, d):
    """A summary as CSV, with the same values when read again."""
    path = S.stage_path(spark, "summary-csv")
    S.write_csv(with_holes(panel(spark, d)).groupBy("sid", "year").agg(F.round(F.sum("y"), 4).alias("y"), F.count(F.lit(1)).alias("n")), path, ["sid", "year"])
    return S.read_csv(spark, path, "sid int, year int, y double, n long")


@query("s17_coefficient_rows", f"WITH {HOLES_SQL} SELECT year, 'x_m' AS term, round(regr_slope(ln(y), ln(x_m)),8) AS coef FROM holes GROUP BY year UNION ALL SELECT year, 'const', round(regr_intercept(ln(y), ln(x_m)),8) FROM holes GROUP BY year")
def s17(spark, d):
    """Each year's fit appends its terms to a table of coefficients."""
    path = S.stage_path(spark, "coefficients")
    for f in R.ols(with_holes(panel(spark, d)), F.ln("y"), {"x_m": F.ln(INPUTS[-1])}, ["year"]):
        S.accumulate(spark, path, [(int(f["year"]), k, float(v)) for k, v in f["coef"].items()], "year int, term string, coef double")
    return rounded(spark.read.parquet(path))
