"""Windows, ranks and bins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldspan.functions.expr import half_month, log_positive
from fieldspan.operators import panel as P, spread
from fieldspan.plans.headline import GROWTH_SQL
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import DIRTY_SQL, HOLES_SQL, PANEL_SQL, dirtied, panel, table, with_holes

_W = "WINDOW w AS (PARTITION BY unit ORDER BY year)"


@query("w01_adjacent_neighbours", f"WITH {HOLES_SQL} SELECT unit, year, CASE WHEN year-py=1 AND ny-year=1 THEN round(sqrt(pv*nv)/y,8) END AS factor FROM (SELECT unit, year, y, lag(y) OVER w AS pv, lead(y) OVER w AS nv, lag(year) OVER w AS py, lead(year) OVER w AS ny FROM holes {_W})")
def w01(spark, d):
    w = P.by_year()
    near = (F.col("year") - F.lag("year").over(w) == 1) & (F.lead("year").over(w) - F.col("year") == 1)
    return with_holes(panel(spark, d)).select("unit", "year", F.when(near, F.round(F.sqrt(F.lag("y").over(w) * F.lead("y").over(w)) / F.col("y"), 8)).alias("factor"))


@query("w05_centred_rolling", f"WITH {DIRTY_SQL}, b AS (SELECT unit, year, x_m FROM dirty) SELECT unit, year, CASE WHEN count(x_m) OVER a >= 2 THEN round(stddev_samp(x_m) OVER a,6) END AS sd3, CASE WHEN count(x_m) OVER a >= 2 THEN round(avg(x_m) OVER a,6) END AS ma3, CASE WHEN count(x_m) OVER c >= 3 THEN round(avg(x_m) OVER c,6) END AS ma5 FROM b WINDOW a AS (PARTITION BY unit ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), c AS (PARTITION BY unit ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w05(spark, d):
    w = P.by_year()
    parts = {"sd3": P.rolling("x_m", "stddev_samp", 1, 2, w), "ma3": P.rolling("x_m", "avg", 1, 2, w), "ma5": P.rolling("x_m", "avg", 2, 3, w)}
    return dirtied(panel(spark, d)).select("unit", "year", *[F.round(c, 6).alias(k) for k, c in parts.items()])


@query("w06_percentile_rank", f"WITH {DIRTY_SQL} SELECT unit, year, round((rank() OVER (PARTITION BY year ORDER BY x_m) + (count(*) OVER (PARTITION BY year, x_m)-1)/2.0)/count(*) OVER (PARTITION BY year),8) AS pctl FROM dirty WHERE x_m IS NOT NULL")
def w06(spark, d):
    return rounded(P.percent_rank_mean_ties(dirtied(panel(spark, d)), "x_m", "year", "pctl").select("unit", "year", "pctl"))


@query("w07_group_median", f"WITH {PANEL_SQL}, m AS (SELECT unit, median(y) AS m FROM panel GROUP BY unit) SELECT panel.unit AS unit, year, round(y/m,8) AS rel FROM panel JOIN m ON panel.unit=m.unit")
def w07(spark, d):
    rows = panel(spark, d)
    m = rows.groupBy("unit").agg(F.median("y").alias("m"))
    return rows.join(m, "unit").select("unit", "year", F.round(F.col("y") / F.col("m"), 8).alias("rel"))


@query("w09_year_shares", f"WITH {PANEL_SQL}, s AS (SELECT unit, year, y/sum(y) OVER (PARTITION BY year) AS s FROM panel) SELECT a.unit AS unit, a.year AS year, round((a.s+b.s)/2,10) AS share FROM s a JOIN s b ON a.unit=b.unit AND a.year=b.year+1")
def w09(spark, d):
    rows = panel(spark, d)
    s = rows.join(rows.groupBy("year").agg(F.sum("y").alias("t")), "year").select("unit", "year", (F.col("y") / F.col("t")).alias("s"))
    before = s.select("unit", (F.col("year") + 1).alias("year"), F.col("s").alias("s0"))
    return s.join(before, ["unit", "year"]).select("unit", "year", F.round((F.col("s") + F.col("s0")) / 2, 10).alias("share"))


@query("w10_running_max", f"WITH {PANEL_SQL} SELECT unit, year, max(y) OVER (PARTITION BY year ORDER BY x_l, unit ROWS UNBOUNDED PRECEDING) AS top FROM panel")
def w10(spark, d):
    return spread.running(panel(spark, d), "y", ["year"], ["x_l", "unit"], "top").select("unit", "year", "top")


@query("w11_running_min_chain", f"WITH {PANEL_SQL}, a AS (SELECT unit, year, x_l/y AS a, x_m/y AS b FROM panel), m AS (SELECT *, min(b) OVER (PARTITION BY year ORDER BY a, b, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a) SELECT unit, year, round(a,10) AS a, round(b,10) AS b FROM m WHERE before IS NULL OR b < before - 1e-15")
def w11(spark, d):
    rows = panel(spark, d).select("unit", "year", (F.col("x_l") / F.col("y")).alias("a"), (F.col("x_m") / F.col("y")).alias("b"))
    rows = spread.running(rows, "b", ["year"], ["a", "b", "unit"], "_m", "min", own=False)
    return rounded(rows.where(F.col("_m").isNull() | (F.col("b") < F.col("_m") - 1e-15)).drop("_m"), 10)


@query("w12_priority_dedupe", f"WITH {DIRTY_SQL}, k AS (SELECT unit//2 AS target, *, row_number() OVER (PARTITION BY unit//2, year ORDER BY CAST(x_m IS NULL AS INT), unit) AS r FROM dirty) SELECT CAST(target AS BIGINT) AS target, year, unit, round(x_m,6) AS x_m FROM k WHERE r = 1")
def w12(spark, d):
    rows = dirtied(panel(spark, d)).withColumn("target", F.expr("cast(unit div 2 as bigint)"))
    first = F.row_number().over(Window.partitionBy("target", "year").orderBy(F.col("x_m").isNull(), "unit"))
    return rows.withColumn("r", first).where("r = 1").select("target", "year", "unit", F.round("x_m", 6).alias("x_m"))


@query("w14_standardised_anomaly", "WITH v AS (SELECT user_id % 20 AS pixel, CAST(floor((day(ts)-1)/10) AS INT) AS dekad, CAST(ts AS DATE) AS dt, avg(value) AS v FROM events GROUP BY 1,2,3), s AS (SELECT pixel, dekad, avg(v) AS m, stddev_samp(v) AS sd, count(v) AS n FROM v GROUP BY 1,2) SELECT v.pixel AS pixel, strftime(v.dt, '%Y-%m-%d') AS dt, CASE WHEN n >= 3 AND sd > 1e-8 THEN round((v.v-m)/sd,8) END AS z FROM v JOIN s ON v.pixel=s.pixel AND v.dekad=s.dekad")
def w14(spark, d):
    day = F.to_date("ts")
    v = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("pixel"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("dekad"), day.alias("dt")).agg(F.avg("value").alias("v"))
    s = v.groupBy("pixel", "dekad").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))
    return v.join(s, ["pixel", "dekad"]).select("pixel", F.col("dt").cast("string").alias("dt"), F.when((F.col("n") >= 3) & (F.col("sd") > 1e-8), F.round((F.col("v") - F.col("m")) / F.col("sd"), 8)).alias("z"))


@query("w15_first_appearance", f"WITH {HOLES_SQL}, f AS (SELECT unit, min(year) AS first FROM holes GROUP BY unit), c AS (SELECT first AS year, count(*) AS entered FROM f GROUP BY first) SELECT CAST(year AS INT) AS year, entered, CAST(sum(entered) OVER (ORDER BY year) AS BIGINT) AS so_far FROM c")
def w15(spark, d):
    f = with_holes(panel(spark, d)).groupBy("unit").agg(F.min("year").alias("year"))
    c = f.groupBy("year").agg(F.count(F.lit(1)).alias("entered"))
    return c.withColumn("so_far", F.sum("entered").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


_EDGES = "list_sort(list_distinct(quantile_cont({v}, [0.0,0.2,0.4,0.6,0.8,1.0])))"


@query("w16_right_closed_bins", f"WITH {PANEL_SQL}, q AS (SELECT {_EDGES.format(v='x_l')} AS e FROM panel), b AS (SELECT greatest(0, len(list_filter(e, lambda x: x < x_l))-1) AS bin, y FROM panel CROSS JOIN q) SELECT CAST(bin AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(y),1) AS mean_y FROM b GROUP BY bin")
def w16(spark, d):
    rows = panel(spark, d)
    e = P.edges(rows, "x_l", 5)
    return rows.join(F.broadcast(e)).groupBy(P.right_closed_bin("x_l", F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 1).alias("mean_y"))


@query("w17_left_closed_bins", f"WITH {PANEL_SQL}, q AS (SELECT {_EDGES.format(v='x_m')} AS e FROM panel), b AS (SELECT greatest(0, least(len(list_filter(e, lambda x: x <= x_m))-1, len(e)-2)) AS bin, y FROM panel CROSS JOIN q) SELECT CAST(bin AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(median(y),1) AS med_y FROM b GROUP BY bin HAVING count(*) >= 10")
def w17(spark, d):
    rows = panel(spark, d)
    e = P.edges(rows, "x_m", 5)
    bins = rows.join(F.broadcast(e)).groupBy(P.left_closed_bin("x_m", F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("y"), 1).alias("med_y"))
    return bins.where("n >= 10")


@query("w18_log_width_bins", f"WITH {PANEL_SQL}, q AS (SELECT quantile_cont(ln(x_k),0.005) AS lo, quantile_cont(ln(x_k),0.995) AS hi FROM panel), b AS (SELECT greatest(0, least(19, CAST(floor((ln(x_k)-lo)/((hi-lo)/20)) AS INT))) AS bin, ln(x_k) AS lx FROM panel CROSS JOIN q) SELECT bin, CAST(count(*) AS BIGINT) AS n, round(median(lx),8) AS med FROM b GROUP BY bin")
def w18(spark, d):
    rows = panel(spark, d).withColumn("lx", log_positive("x_k"))
    q = spread.quantiles(rows, "lx", [], [0.005, 0.995])
    lo, hi = F.col("q")[0], F.col("q")[1]
    k = F.greatest(F.lit(0), F.least(F.lit(19), F.floor((F.col("lx") - lo) / ((hi - lo) / 20)).cast("int")))
    binned = rows.join(F.broadcast(q)).select(k.alias("bin"), "lx")
    middle = spread.quantiles(binned, "lx", ["bin"], [0.5]).select("bin", F.round(F.col("q")[0], 8).alias("med"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(middle, "bin")


@query("w19_quantile_classes", f"WITH {GROWTH_SQL}, m AS (SELECT unit, avg(dln) AS g FROM growth GROUP BY unit), q AS (SELECT {_EDGES.format(v='g')} AS e FROM m), c AS (SELECT greatest(0, least(len(list_filter(e, lambda x: x <= g))-1, len(e)-2)) AS k, e FROM m CROSS JOIN q) SELECT CAST(k AS INT) AS k, CASE WHEN k=0 THEN '< ' || printf('%.2f', 100*e[2]) WHEN k=len(e)-2 THEN '>= ' || printf('%.2f', 100*e[len(e)-1]) ELSE printf('%.2f', 100*e[k+1]) || ' to ' || printf('%.2f', 100*e[k+2]) END AS label, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY k, label")
def w19(spark, d):
    from fieldspan.operators import index as I
    from fieldspan.plans.headline import sample

    m = I.unit_growth(sample(spark, d), I.solow()).groupBy("unit").agg(F.avg("dln").alias("g"))
    e = P.edges(m, "g", 5)
    shown = lambda i: F.format_string("%.2f", 100 * F.get("edges", i))
    k = F.col("k")
    label = F.when(k == 0, F.concat(F.lit("< "), shown(F.lit(1)))).when(k == F.size("edges") - 2, F.concat(F.lit(">= "), shown(k))).otherwise(F.concat(shown(k), F.lit(" to "), shown(k + 1)))
    return m.join(F.broadcast(e)).withColumn("k", P.left_closed_bin("g", F.col("edges"))).groupBy("k", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_CLIM = "c AS (SELECT c_nationkey % 3 AS px, CAST((month(o_orderdate)-1)*2 + CAST(day(o_orderdate)>15 AS INT) AS INT) AS hm, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"


@query("w20_circular_mean", f"WITH {_CLIM} SELECT CAST(a.px AS INT) AS px, a.hm AS hm, round(avg(b.v),4) AS smooth FROM c a JOIN c b ON a.px=b.px AND (((b.hm-a.hm+3)%24)+24)%24 <= 6 GROUP BY a.px, a.hm")
def w20(spark, d):
    from fieldspan.operators.weather import circular_smooth

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy((F.col("c_nationkey") % 3).cast("int").alias("px"), half_month("o_orderdate").alias("hm")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(circular_smooth(c, "px", "hm", "v", "smooth"), 4)
