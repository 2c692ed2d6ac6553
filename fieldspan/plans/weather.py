"""Weather queries: pixels are groups of event users, zones are nations, weights are balances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspan.functions.expr import clip, degree_days, half_month
from fieldspan.operators import panel as P, weather as W
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import table

DAYS_SQL = "days AS (SELECT CAST(user_id % 20 AS INT) AS pixel, CAST(day(ts) AS INT) AS dy, min(value)/10 AS tmin, max(value)/10 AS tmax FROM events GROUP BY 1,2)"


def _dd(b: float) -> str:
    m, a = "((tmax+tmin)/2)", "((tmax-tmin)/2)"
    turn = f"asin(greatest(-1.0, least(1.0, ({b}-{m})/nullif({a},0))))"
    return f"CASE WHEN tmin IS NULL OR tmax IS NULL THEN NULL WHEN {a}<=0 THEN greatest({m}-{b},0.0) WHEN tmax<={b} THEN 0.0 WHEN tmin>={b} THEN {m}-{b} ELSE (({m}-{b})*(pi()/2-{turn})+{a}*cos({turn}))/pi() END"


DD_SQL = DAYS_SQL + f", dd AS (SELECT pixel, dy, tmin, tmax, {_dd(8.0)} AS lo, {_dd(32.0)} AS hdd FROM days), gd AS (SELECT *, lo-hdd AS gdd FROM dd)"
DEKAD_SQL = DD_SQL + ", dek AS (SELECT pixel, CAST((dy-1)//10 AS INT) AS dekad, CASE WHEN count(gdd)=10 THEN sum(gdd) END AS gdd, CASE WHEN count(hdd)=10 THEN sum(hdd) END AS hdd FROM gd WHERE dy<=30 AND NOT (pixel=7 AND dy=15) GROUP BY 1,2)"
CLIM_SQL = "yr AS (SELECT CAST(c_nationkey % 5 AS INT) AS pixel, year(o_orderdate) AS yr, CAST((month(o_orderdate)-1)*2+CAST(day(o_orderdate)>15 AS INT) AS INT) AS hm, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT)*10//count(*) AS v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2,3), clim AS (SELECT pixel, hm, CAST(CAST(sum(v) AS BIGINT)*1000//count(*) AS DOUBLE)/1e6 AS v FROM yr GROUP BY 1,2), sm AS (SELECT a.pixel AS pixel, a.hm AS hm, avg(b.v) AS v FROM clim a JOIN clim b ON a.pixel=b.pixel AND (((b.hm-a.hm+3)%24)+24)%24 <= 6 GROUP BY 1,2)"
SEASON_SQL = CLIM_SQL + ", en AS (SELECT pixel, min(v) AS lo, max(v) AS hi FROM sm GROUP BY 1), season AS (SELECT sm.pixel AS pixel, CAST(hm//2+1 AS INT) AS month, bool_or(hi>lo AND v >= lo+0.5*(hi-lo)) AS in_season FROM sm JOIN en ON sm.pixel=en.pixel GROUP BY 1,2)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 20).cast("int").alias("pixel"), F.dayofmonth("ts").alias("dy")).agg((F.min("value") / 10).alias("tmin"), (F.max("value") / 10).alias("tmax"))


def dekads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.growing_and_heat(days(spark, sf_dir)).where("dy <= 30 and not (pixel = 7 and dy = 15)")
    return rows.groupBy("pixel", F.floor((F.col("dy") - 1) / 10).cast("int").alias("dekad")).agg(W.strict_sum("gdd", 10).alias("gdd"), W.strict_sum("hdd", 10).alias("hdd"))


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the years' means by pixel and half-month, in whole thousandths, then millionths: exact in any order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = o.groupBy((F.col("c_nationkey") % 5).cast("int").alias("pixel"), F.year("o_orderdate").alias("yr"), half_month("o_orderdate").alias("hm")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    years = years.select("pixel", "hm", F.expr("s * 10 div n").alias("v"))
    return years.groupBy("pixel", "hm").agg((F.expr("sum(v) * 1000 div count(1)").cast("double") / 1e6).alias("v"))


def smooth(spark, d):
    return W.circular_smooth(climatology(spark, d), "pixel", "hm", "v", "s").select("pixel", "hm", F.col("s").alias("v"))


def season(spark, d):
    months = W.half_amplitude(smooth(spark, d), "pixel", "v")
    return months.groupBy("pixel", (F.expr("hm div 2") + 1).cast("int").alias("month")).agg(F.bool_or("in_season").alias("in_season"))


@query("g01_degree_days", f"WITH {DAYS_SQL} SELECT pixel, dy, round({_dd(8.0)},8) AS dd8, round({_dd(20.0)},8) AS dd20 FROM days")
def g01(spark, d):
    return rounded(days(spark, d).select("pixel", "dy", degree_days("tmin", "tmax", 8.0).alias("dd8"), degree_days("tmin", "tmax", 20.0).alias("dd20")))


@query("g02_growing_and_heat", f"WITH {DD_SQL} SELECT pixel, dy, round(gdd,8) AS gdd, round(hdd,8) AS hdd FROM gd")
def g02(spark, d):
    return rounded(W.growing_and_heat(days(spark, d)).select("pixel", "dy", "gdd", "hdd"))


@query("g03_method_bias", f"WITH {DD_SQL}, b AS (SELECT pixel, gdd, greatest((tmin+tmax)/2-8,0)-greatest((tmin+tmax)/2-32,0) AS gm FROM gd) SELECT pixel, round(avg(gm),8) AS mean_daily, round(avg(gdd),8) AS mean_sine, round(avg(gdd-gm),8) AS bias FROM b GROUP BY pixel")
def g03(spark, d):
    rows = W.daily_mean(W.growing_and_heat(days(spark, d)))
    return rows.groupBy("pixel").agg(F.round(F.avg("gdd_mean"), 8).alias("mean_daily"), F.round(F.avg("gdd"), 8).alias("mean_sine"), F.round(F.avg(F.col("gdd") - F.col("gdd_mean")), 8).alias("bias"))


@query("g04_strict_dekads", f"WITH {DEKAD_SQL} SELECT pixel, dekad, round(gdd,6) AS gdd, round(hdd,6) AS hdd FROM dek")
def g04(spark, d):
    return rounded(dekads(spark, d), 6)


@query("g05_fixed_season", f"WITH {DEKAD_SQL} SELECT pixel, CASE WHEN count(gdd)=2 THEN round(sum(gdd),6) END AS gdd, CASE WHEN count(gdd)=2 THEN round(sum(hdd),6) END AS hdd FROM dek WHERE dekad IN (1,2) GROUP BY pixel")
def g05(spark, d):
    whole = F.count("gdd") == 2
    return rounded(dekads(spark, d).where("dekad in (1, 2)").groupBy("pixel").agg(F.when(whole, F.sum("gdd")).alias("gdd"), F.when(whole, F.sum("hdd")).alias("hdd")), 6)


@query("g06_masked_season", f"WITH {DEKAD_SQL}, mask AS (SELECT pixel, dekad FROM dek WHERE (pixel+dekad)%3<>0 AND pixel%9<>4), m AS (SELECT k.pixel AS pixel, CASE WHEN count(gdd)=count(*) THEN sum(gdd) END AS gdd FROM mask k JOIN dek ON dek.pixel=k.pixel AND dek.dekad=k.dekad GROUP BY 1) SELECT p.pixel AS pixel, round(gdd,6) AS gdd FROM (SELECT DISTINCT pixel FROM dek) p LEFT JOIN m ON m.pixel=p.pixel")
def g06(spark, d):
    rows = dekads(spark, d)
    inside_ = (F.col("pixel") + F.col("dekad")) % 3 != 0
    held = rows.withColumn("m", inside_ & (F.col("pixel") % 9 != 4))
    wanted = F.count_if("m")
    x = F.when(F.col("m"), F.col("gdd"))
    return rounded(held.groupBy("pixel").agg(F.when((wanted > 0) & (F.count(x) == wanted), F.sum(x)).alias("gdd")), 6)


@query("g07_whole_period", f"WITH {DEKAD_SQL} SELECT pixel, CASE WHEN count(gdd)=3 THEN round(sum(gdd),6) END AS gdd FROM dek GROUP BY pixel")
def g07(spark, d):
    return rounded(dekads(spark, d).groupBy("pixel").agg(W.strict_sum("gdd", 3).alias("gdd")), 6)


@query("g08_climatology", f"WITH {CLIM_SQL} SELECT pixel, hm, round(v,6) AS v FROM clim")
def g08(spark, d):
    return rounded(climatology(spark, d), 6)


@query("g09_smoothed_climatology", f"WITH {CLIM_SQL} SELECT pixel, hm, round(v,6) AS v FROM sm")
def g09(spark, d):
    return rounded(smooth(spark, d), 6)


@query("g10_half_amplitude_season", f"WITH {SEASON_SQL} SELECT * FROM season")
def g10(spark, d):
    return season(spark, d)


@query("g11_circular_peaks")
def g11(spark, d):
    rows = smooth(spark, d).groupBy("pixel").agg(F.array_sort(F.collect_list(F.struct("hm", "v"))).alias("s")).select("pixel", F.col("s.v").alias("v"))

    def find(batches):
        for b in batches:
            yield pd.DataFrame({"pixel": b["pixel"], "peaks": [W.peaks(list(v)) for v in b["v"]]})

    return rows.mapInPandas(find, "pixel int, peaks array<int>")


@query("g12_peak_union", "SELECT c_nationkey, list_sort(list_distinct(list_transform(flatten([[p-2,p-1,p,p+1,p+2] FOR p IN [CAST(c_nationkey%12+1 AS INT), CAST((c_nationkey*5)%12+1 AS INT)]]), lambda x: CAST(((x-1)%12+12)%12+1 AS INT)))) AS months FROM (SELECT DISTINCT c_nationkey FROM customer)")
def g12(spark, d):
    peaks = F.array((F.col("c_nationkey") % 12 + 1).cast("int"), ((F.col("c_nationkey") * 5) % 12 + 1).cast("int"))
    return table(spark, d, "customer").select("c_nationkey").distinct().select("c_nationkey", W.peak_union(peaks).alias("months"))


@query("g13_average_resample", "SELECT CAST(c_custkey // 50 AS BIGINT) AS cell, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END),6) AS v FROM customer GROUP BY 1")
def g13(spark, d):
    return table(spark, d, "customer").groupBy(F.expr("c_custkey div 50").alias("cell")).agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 6).alias("v"))


_CELL = "(SELECT c_custkey // 50 AS cell, CAST(c_mktsegment IN ('BUILDING','MACHINERY') AS INT) AS m, greatest(c_acctbal,0) AS w FROM customer)"


@query("g14_weighted_majority", f"SELECT CAST(cell AS BIGINT) AS cell, coalesce(sum(m*w)/nullif(sum(w),0) >= 0.5, false) AS inside FROM {_CELL} GROUP BY cell")
def g14(spark, d):
    m, w = F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int"), F.greatest("c_acctbal", F.lit(0.0))
    return table(spark, d, "customer").groupBy(F.expr("c_custkey div 50").alias("cell")).agg(F.coalesce(F.sum(m * w) / F.nullif(F.sum(w), F.lit(0.0)) >= 0.5, F.lit(False)).alias("inside"))


@query("g15_nearest_mode_bilinear", "WITH g AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_retailprice AS v, p_size AS s FROM part), m AS (SELECT k//4 AS c, s, count(*) AS n FROM g GROUP BY 1,2), mode AS (SELECT c, arg_max(s, (n, -s)) AS m FROM m GROUP BY c) SELECT a.k AS k, round(0.75*a.v+0.25*b.v,6) AS linear, a.v AS nearest, CAST(m AS INT) AS mode FROM g a JOIN g b ON b.k=a.k+1 JOIN mode ON mode.c=a.k//4 WHERE a.k % 4 = 0")
def g15(spark, d):
    g = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("s"))
    mode = g.groupBy(F.expr("k div 4").alias("c"), "s").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max_by("s", F.struct("n", -F.col("s"))).cast("int").alias("mode"))
    corners = g.where("k % 4 = 0").select("k", F.explode(F.array(F.struct(F.col("k").alias("p"), F.lit(0.75).alias("w")), F.struct((F.col("k") + 1).alias("p"), F.lit(0.25).alias("w")))).alias("x")).select("k", "x.p", "x.w")
    mixed = corners.join(g.select(F.col("k").alias("p"), "v"), "p").groupBy("k").agg(F.sum(F.col("w") * F.col("v")).alias("linear"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("w") > 0.5, F.col("v"))).alias("nearest")).where("n = 2")
    return mixed.join(mode, F.expr("k div 4") == F.col("c")).select("k", F.round("linear", 6).alias("linear"), "nearest", "mode")


_BRIDGE = "bridge AS (SELECT CAST(c_custkey % 20 AS INT) AS pixel, c_nationkey AS zone, greatest(c_acctbal,0) AS w FROM customer)"


def bridge(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") % 20).cast("int").alias("pixel"), F.col("c_nationkey").alias("zone"), F.greatest("c_acctbal", F.lit(0.0)).alias("w"))


_ZONAL = "CAST(zone AS INT) AS zone, dekad, round(sum(CASE WHEN gdd IS NOT NULL THEN w*gdd END)/nullif(sum(CASE WHEN gdd IS NOT NULL THEN w END),0),6) AS weighted_mean, round(avg(CASE WHEN w>0 THEN gdd END),6) AS plain_mean, round(sum(CASE WHEN gdd IS NOT NULL THEN w*gdd END),2) AS weighted_sum"


@query("j14_zonal_join", f"WITH {DEKAD_SQL}, {_BRIDGE} SELECT {_ZONAL} FROM dek JOIN bridge ON dek.pixel=bridge.pixel GROUP BY zone, dekad")
def j14(spark, d):
    return rounded(W.zonal(dekads(spark, d), bridge(spark, d), "gdd", ["dekad"]), 6, weighted_sum=2)


@query("g16_zonal_statistics", f"WITH {DD_SQL}, {_BRIDGE}, p AS (SELECT pixel, avg(gdd) AS gdd, 0 AS dekad FROM gd GROUP BY pixel) SELECT CAST(zone AS INT) AS zone, round(sum(w*gdd)/nullif(sum(w),0),6) AS weighted_mean, round(avg(CASE WHEN w>0 THEN gdd END),6) AS plain_mean FROM p JOIN bridge ON p.pixel=bridge.pixel GROUP BY zone")
def g16(spark, d):
    p = W.growing_and_heat(days(spark, d)).groupBy("pixel").agg(F.avg("gdd").alias("gdd"))
    return rounded(W.zonal(p, bridge(spark, d), "gdd", []).drop("weighted_sum"), 6)


@query("g17_depth_weighted", "SELECT l_orderkey, l_linenumber, round(l_quantity*0.25+l_discount*0.75,8) AS d28, round(l_quantity*0.07+l_discount*0.21+l_tax*0.72,8) AS d100 FROM lineitem")
def g17(spark, d):
    a, b = W.depth_mean([("l_quantity", 7.0), ("l_discount", 21.0)]), W.depth_mean([("l_quantity", 7.0), ("l_discount", 21.0), ("l_tax", 72.0)])
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("d28"), b.alias("d100")))


_Z = DD_SQL + ", s AS (SELECT pixel, avg(tmax) AS m, stddev_samp(tmax) AS sd, count(tmax) AS n FROM gd GROUP BY pixel), z AS (SELECT gd.pixel AS pixel, dy, CASE WHEN n>=3 AND sd>1e-8 THEN (tmax-m)/sd END AS z FROM gd JOIN s ON gd.pixel=s.pixel)"


@query("g18_anomaly_z", f"WITH {_Z} SELECT pixel, dy, round(z,8) AS z FROM z")
def g18(spark, d):
    return rounded(W.anomalies(days(spark, d), "tmax", ["pixel"], "z").select("pixel", "dy", "z"))


@query("g19_season_mean", f"WITH {SEASON_SQL}, mm AS (SELECT pixel, CAST(hm//2+1 AS INT) AS month, avg(v) AS v FROM clim WHERE NOT (pixel=2 AND hm IN (10,11)) GROUP BY 1,2) SELECT season.pixel AS pixel, CASE WHEN count(v)=count(*) THEN round(avg(v),4) END AS v FROM season LEFT JOIN mm ON mm.pixel=season.pixel AND mm.month=season.month WHERE in_season GROUP BY season.pixel")
def g19(spark, d):
    """A month of the season without a value makes the mean NULL."""
    mm = climatology(spark, d).where("not (pixel = 2 and hm in (10, 11))").groupBy("pixel", (F.expr("hm div 2") + 1).cast("int").alias("month")).agg(F.avg("v").alias("v"))
    rows = season(spark, d).where("in_season").join(mm, ["pixel", "month"], "left")
    return rows.groupBy("pixel").agg(F.when(F.count("v") == F.count(F.lit(1)), F.round(F.avg("v"), 4)).alias("v"))


@query("g20_anomaly_percentile", f"WITH {_Z} SELECT pixel, dy, round((rank() OVER (PARTITION BY pixel ORDER BY round(z,9)) + (count(*) OVER (PARTITION BY pixel, round(z,9))-1)/2.0)/count(*) OVER (PARTITION BY pixel),8) AS pctl FROM z WHERE z IS NOT NULL")
def g20(spark, d):
    z = W.anomalies(days(spark, d), "tmax", ["pixel"], "z").withColumn("z", F.round("z", 9))
    return rounded(P.percent_rank_mean_ties(z, "z", "pixel", "pctl").select("pixel", "dy", "pctl"))


@query("g21_dormant_mask", f"WITH {DD_SQL}, m AS (SELECT pixel, CAST((dy-1)//10 AS INT) AS dekad, avg(gdd) AS g FROM gd GROUP BY 1,2) SELECT pixel, dekad, g >= 5 AS awake FROM m")
def g21(spark, d):
    rows = W.growing_and_heat(days(spark, d)).groupBy("pixel", F.floor((F.col("dy") - 1) / 10).cast("int").alias("dekad")).agg(F.avg("gdd").alias("g"))
    return rows.select("pixel", "dekad", (F.col("g") >= 5).alias("awake"))


@query("g22_cropland_share", "SELECT c_nationkey, round(100.0*count(*) FILTER (WHERE c_mktsegment='BUILDING')/nullif(count(*) FILTER (WHERE c_mktsegment IN ('BUILDING','MACHINERY')),0),6) AS pct, CAST(count(*) FILTER (WHERE c_mktsegment IN ('BUILDING','MACHINERY')) AS BIGINT) AS valid FROM customer GROUP BY 1")
def g22(spark, d):
    one, valid = F.count_if(F.col("c_mktsegment") == "BUILDING"), F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.lit(100.0) * one / F.nullif(valid, F.lit(0).cast("long")), 6).alias("pct"), valid.alias("valid"))


_AREA = "cos(radians(20+c_nationkey))*(0.1*111.195)*(0.1*111.195)"


@query("g23_cell_area", f"SELECT c_nationkey, round(sum({_AREA}),4) AS km2, round(sum({_AREA}*least(1.0,greatest(0.0,c_acctbal/5000))),4) AS crop_km2 FROM customer GROUP BY 1")
def g23(spark, d):
    area = F.cos(F.radians(20 + F.col("c_nationkey"))) * (0.1 * 111.195) * (0.1 * 111.195)
    share = clip(F.col("c_acctbal") / 5000, 0.0, 1.0)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(area), 4).alias("km2"), F.round(F.sum(area * share), 4).alias("crop_km2"))
