"""Index numbers, comparison tables and the volatility suite."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldspan.functions.expr import stage
from fieldspan.operators import index as I, panel as P
from fieldspan.plans.headline import GROWTH_SQL, NATIONAL_SQL, STAGE_SQL, growth, national, sample
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import HOLES_SQL, PANEL_SQL, deflator, panel, with_holes

_GM = "g AS (SELECT avg(ln(x_l)) AS gl, avg(ln(x_s)) AS gs, avg(ln(x_k)) AS gk, avg(ln(x_m)) AS gm FROM panel)"


@query("e01_geometric_index", f"WITH {PANEL_SQL}, {_GM} SELECT unit, year, round(exp(0.2*(ln(x_l)-gl)+0.25*(ln(x_s)-gs)+0.15*(ln(x_k)-gk)+0.4*(ln(x_m)-gm)),8) AS x_index FROM panel CROSS JOIN g")
def e01(spark, d):
    return rounded(I.geometric_index(panel(spark, d), I.ELASTICITIES).select("unit", "year", "x_index"))


@query("e02_crs_index", f"WITH {PANEL_SQL} SELECT unit, year, round(exp(0.2*ln(x_l)+0.25*ln(x_s)+0.15*ln(x_k)+0.4*ln(x_m)),4) AS x FROM panel")
def e02(spark, d):
    return panel(spark, d).select("unit", "year", F.round(I.crs_index(I.ELASTICITIES), 4).alias("x"))


_COEF = "coef AS (SELECT 'frontier' AS eq, 'x_' || substr('lskm', CAST(r_regionkey AS INT)+1, 1) AS term, CAST(0.1+0.05*r_regionkey AS DOUBLE) AS coef FROM region WHERE r_regionkey < 4)"


@query("e03_elasticities", f"WITH {_COEF} SELECT term, round(CASE WHEN term='x_s' THEN 1-(SELECT sum(coef) FROM coef WHERE term<>'x_s') ELSE coef END,8)::DOUBLE AS elasticity FROM coef")
def e03(spark, d):
    from fieldspan.sources.tables import table

    term = F.concat(F.lit("x_"), F.substring(F.lit("lskm"), F.col("r_regionkey").cast("int") + 1, F.lit(1)))
    coef = table(spark, d, "region").where("r_regionkey < 4").select(F.lit("frontier").alias("eq"), term.alias("term"), (0.1 + 0.05 * F.col("r_regionkey")).alias("coef"))
    known = I.elasticities(coef)
    names = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    return coef.select("term", F.round(F.element_at(names, F.col("term")), 8).alias("elasticity"))


_PY = "holes"


@query("e08_estimator_comparison", f"WITH {NATIONAL_SQL}, lp AS (SELECT unit, year, dl FROM (SELECT unit, year, ln(y/x_l)-lag(ln(y/x_l)) OVER w AS dl, year-lag(year) OVER w AS gap FROM holes WINDOW w AS (PARTITION BY unit ORDER BY year)) WHERE gap=1), a AS (SELECT year, avg(dl) AS labour, count(*) AS n_labour FROM lp GROUP BY year), m AS (SELECT wins.year AS year, avg(dln) AS tfp_matched, avg(dl) AS labour_matched FROM wins JOIN lp ON wins.unit=lp.unit AND wins.year=lp.year GROUP BY wins.year) SELECT national.year AS year, round(dln_weighted,8) AS tfp, round(labour,8) AS labour, n_labour, round(tfp_matched,8) AS tfp_matched, round(labour_matched,8) AS labour_matched FROM national FULL JOIN a ON a.year=national.year FULL JOIN m ON m.year=national.year")
def e08(spark, d):
    labour = P.adjacent_change(with_holes(panel(spark, d)), F.ln(F.col("y") / F.col("x_l")), name="dl").select("unit", "year", "dl")
    a = labour.groupBy("year").agg(F.avg("dl").alias("labour"), F.count(F.lit(1)).alias("n_labour"))
    m = growth(spark, d).join(labour, ["unit", "year"]).groupBy("year").agg(F.avg("dln").alias("tfp_matched"), F.avg("dl").alias("labour_matched"))
    return rounded(national(spark, d).select("year", F.col("dln_weighted").alias("tfp")).join(a, "year", "full").join(m, "year", "full"))


@query("e09_volatility", f"WITH {NATIONAL_SQL}, u AS (SELECT unit, stddev_samp(dln) AS sd FROM growth GROUP BY unit HAVING count(*) >= 3), s AS (SELECT year, CASE WHEN count(dln_weighted) OVER w >= 2 THEN avg(dln_weighted) OVER w END AS ma3 FROM national WINDOW w AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT round((SELECT stddev_samp(dln_weighted) FROM national),8) AS sd_national, round((SELECT stddev_samp(ma3) FROM s),8) AS sd_smoothed, round((SELECT avg(sd) FROM u),8) AS mean_unit_sd, round((SELECT median(sd) FROM u),8) AS median_unit_sd, round((SELECT avg(CASE WHEN abs(dln)>0.5 THEN 1.0 ELSE 0.0 END) FROM growth),8) AS share_large")
def e09(spark, d):
    raw = I.unit_growth(sample(spark, d), I.solow())
    units = raw.groupBy("unit").agg(F.stddev_samp("dln").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 3").agg(F.avg("sd").alias("mean_unit_sd"), F.median("sd").alias("median_unit_sd"))
    large = raw.agg(F.avg((F.abs("dln") > 0.5).cast("double")).alias("share_large"))
    nat = national(spark, d).withColumn("ma3", P.rolling("dln_weighted", "avg", 1, 2, Window.orderBy("year")))  # a row per year
    return rounded(nat.agg(F.stddev_samp("dln_weighted").alias("sd_national"), F.stddev_samp("ma3").alias("sd_smoothed")).join(units).join(large))


@query("e10_stage_and_dispersion", f"WITH {GROWTH_SQL}, u AS (SELECT {STAGE_SQL} AS stage, year, avg(dln) AS m, stddev_samp(dln) AS sd FROM wins GROUP BY 1,2) SELECT stage, round(avg(m),8) AS mean_of_years, round(avg(sd),8) AS mean_dispersion, round(corr(year, sd),6) AS trend FROM u GROUP BY stage")
def e10(spark, d):
    years = growth(spark, d).groupBy(stage("year", *I.STAGES).alias("stage"), "year").agg(F.avg("dln").alias("m"), F.stddev_samp("dln").alias("sd"))
    return years.groupBy("stage").agg(F.round(F.avg("m"), 8).alias("mean_of_years"), F.round(F.avg("sd"), 8).alias("mean_dispersion"), F.round(F.corr("year", "sd"), 6).alias("trend"))


@query("e12_gap_table", f"WITH {GROWTH_SQL}, o AS (SELECT unit, year, dl FROM (SELECT unit, year, ln(y/x_m)-lag(ln(y/x_m)) OVER w AS dl, year-lag(year) OVER w AS gap FROM holes WINDOW w AS (PARTITION BY unit ORDER BY year)) WHERE gap=1), j AS (SELECT {STAGE_SQL.replace('year', 'wins.year')} AS stage, dln, dl FROM wins JOIN o ON o.unit=wins.unit AND o.year=wins.year) SELECT stage, CAST(count(*) AS BIGINT) AS n, round(avg(dln),8) AS a, round(avg(dl),8) AS b, round(avg(dln-dl),8) AS gap, round(median(dln-dl),8) AS median_gap FROM j GROUP BY stage")
def e12(spark, d):
    other = P.adjacent_change(with_holes(panel(spark, d)), F.ln(F.col("y") / F.col("x_m")), name="dl").select("unit", "year", "dl")
    j = growth(spark, d).join(other, ["unit", "year"]).withColumn("gap", F.col("dln") - F.col("dl"))
    return rounded(j.groupBy(stage("year", *I.STAGES).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.avg("dln").alias("a"), F.avg("dl").alias("b"), F.avg("gap").alias("gap"), F.median("gap").alias("median_gap")))


@query("e14_technical_efficiency", f"WITH {PANEL_SQL}, u AS (SELECT unit, year, ln(y) AS ly, ln(y)-0.2*ln(x_l)-0.25*ln(x_s)-0.15*ln(x_k)-0.4*ln(x_m) AS r FROM panel), v AS (SELECT *, max(r) OVER (PARTITION BY year) - r AS uh FROM u) SELECT unit, year, round(exp(-uh),8) AS te, round(ly - r + (r + uh),6) AS frontier, round(r + uh - uh,8) AS ln_tfp FROM v")
def e14(spark, d):
    """Efficiency exp(-u) on a given u: here the distance to the year's best residual."""
    rows = panel(spark, d).withColumn("r", I.solow())
    top = rows.groupBy("year").agg(F.max("r").alias("top"))
    rows = rows.join(top, "year").withColumn("uh", F.col("top") - F.col("r"))
    return rounded(rows.select("unit", "year", F.exp(-F.col("uh")).alias("te"), (F.ln("y") - F.col("r") + F.col("top")).alias("frontier"), (F.col("top") - F.col("uh")).alias("ln_tfp")), frontier=6)


@query("e18_cost_shares", f"WITH {PANEL_SQL}, c AS (SELECT year, x_l*(1+0.03*(year-1995)+sid/1000.0) AS cl, x_s AS cs, x_k AS ck, x_m AS cm FROM panel), s AS (SELECT year, cl/(cl+cs+ck+cm) AS sl, cs/(cl+cs+ck+cm) AS ss, ck/(cl+cs+ck+cm) AS sk, cm/(cl+cs+ck+cm) AS sm FROM c) SELECT year, round(median(sl),8) AS sl, round(median(ss),8) AS ss, round(median(sk),8) AS sk, round(median(sm),8) AS sm FROM s GROUP BY year")
def e18(spark, d):
    cost = panel(spark, d).select("year", (F.col("x_l") * deflator()).alias("l"), F.col("x_s").alias("s"), F.col("x_k").alias("k"), F.col("x_m").alias("m"))
    total = F.col("l") + F.col("s") + F.col("k") + F.col("m")
    return cost.groupBy("year").agg(*[F.round(F.median(F.col(c) / total), 8).alias(f"s{c}") for c in "lskm"])


@query("e19_unit_exponent", f"WITH {GROWTH_SQL} SELECT unit, round(avg(100*(exp(dln)-1)),6) AS mean_pct, round(stddev_samp(100*(exp(dln)-1)),6) AS sd_pct FROM growth GROUP BY unit")
def e19(spark, d):
    pct = 100 * F.expm1("dln")
    return I.unit_growth(sample(spark, d), I.solow()).groupBy("unit").agg(F.round(F.avg(pct), 6).alias("mean_pct"), F.round(F.stddev_samp(pct), 6).alias("sd_pct"))


@query("e15_one_regressor_ols", f"WITH {HOLES_SQL} SELECT year, round(regr_slope(ln(y), ln(x_m)),8) AS slope, round(regr_intercept(ln(y), ln(x_m)),6) AS intercept, round(regr_r2(ln(y), ln(x_m)),8) AS r2 FROM holes GROUP BY year")
def e15(spark, d):
    y, x = F.ln("y"), F.ln("x_m")
    return with_holes(panel(spark, d)).groupBy("year").agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


_AGG = f"""{PANEL_SQL}, a AS (SELECT year, sum(y) AS y, sum(y*(1+0.03*(year-1995)+sid/1000.0)) AS nom, 0.2*ln(sum(x_l))+0.25*ln(sum(x_s))+0.15*ln(sum(x_k))+0.4*ln(sum(x_m)) AS li FROM panel GROUP BY year),
 d AS (SELECT year, 100*(ln(nom)-lag(ln(nom)) OVER w) AS nominal, 100*(ln(nom/y)-lag(ln(nom/y)) OVER w) AS deflator, 100*(ln(y)-lag(ln(y)) OVER w) AS real, 100*(li-lag(li) OVER w) AS input, 100*(ln(y)-li-lag(ln(y)-li) OVER w) AS tfp FROM a WINDOW w AS (ORDER BY year)),
 long AS (UNPIVOT (SELECT * FROM d WHERE tfp IS NOT NULL) ON nominal, deflator, real, input, tfp INTO NAME component VALUE v)"""
_PARTS = ("nominal", "deflator", "real", "input", "tfp")


def accounts(rows):
    """Percent changes of the rows' totals by year: output in current prices, its deflator, real output, inputs, residual."""
    a = rows.groupBy("year").agg(F.sum("y").alias("y"), F.sum(F.col("y") * deflator()).alias("nom"), sum((w * F.ln(F.sum(k)) for k, w in I.ELASTICITIES.items()), F.lit(0.0)).alias("li"))
    w = Window.orderBy("year")  # a row per year
    levels = {"nominal": F.ln("nom"), "deflator": F.ln(F.col("nom") / F.col("y")), "real": F.ln("y"), "input": F.col("li"), "tfp": F.ln("y") - F.col("li")}
    return a.select("year", *[(100 * (v - F.lag(v).over(w))).alias(k) for k, v in levels.items()]).where("tfp is not null")


@query("e09b_growth_decomposition", f"WITH {_AGG} SELECT component, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS sd, round(min(v),6) AS least, round(max(v),6) AS most, round((SELECT corr(real, tfp) FROM d),6) AS corr_output, round((SELECT corr(input, tfp) FROM d),6) AS corr_input FROM long GROUP BY component")
def e09b(spark, d):
    """Which component of national growth moves: level, spread and range of each, and the residual's correlations."""
    a = accounts(panel(spark, d))
    both = a.agg(F.corr("real", "tfp").alias("corr_output"), F.corr("input", "tfp").alias("corr_input"))
    long = a.unpivot(["year"], list(_PARTS), "component", "v")
    stats = long.groupBy("component").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    return rounded(stats.join(F.broadcast(both)), 6)


_BALANCED = f"""{HOLES_SQL}, full_ AS (SELECT unit FROM holes GROUP BY unit HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM holes)),
 b AS (SELECT unit, year, ln(y)-0.2*ln(x_l)-0.25*ln(x_s)-0.15*ln(x_k)-0.4*ln(x_m) AS r FROM holes WHERE unit IN (SELECT unit FROM full_)),
 c AS (SELECT unit, year, 100*(r-lag(r) OVER (PARTITION BY unit ORDER BY year)) AS d FROM b),
 y AS (SELECT year, avg(d) AS nat_mean, median(d) AS nat_median, stddev_samp(d) AS xsec_sd, quantile_cont(d,0.1) AS p10, quantile_cont(d,0.9) AS p90, CAST(count(*) AS BIGINT) AS n FROM c WHERE d IS NOT NULL GROUP BY year)"""


@query("e09c_volatility_by_year", f"WITH {_BALANCED} SELECT year, round(nat_mean,6) AS nat_mean, round(nat_median,6) AS nat_median, round(xsec_sd,6) AS xsec_sd, round(p10,6) AS p10, round(p90,6) AS p90, n, CASE WHEN count(nat_mean) OVER w >= 3 THEN round(stddev_samp(nat_mean) OVER w,6) END AS roll5_sd FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def e09c(spark, d):
    """By year, over the balanced units: national mean and median growth, spread over units, and the rolling spread of the mean."""
    c = I.unit_growth(P.balanced(with_holes(panel(spark, d))), I.solow()).withColumn("d", 100 * F.col("dln"))
    y = c.groupBy("year").agg(F.avg("d").alias("nat_mean"), F.median("d").alias("nat_median"), F.stddev_samp("d").alias("xsec_sd"), F.percentile("d", F.lit(0.1)).alias("p10"), F.percentile("d", F.lit(0.9)).alias("p90"), F.count(F.lit(1)).alias("n"))
    return rounded(y.withColumn("roll5_sd", P.rolling("nat_mean", "stddev_samp", 2, 3, Window.orderBy("year"))), 6)  # a row per year


_TOTALS = "100*(t-lag(t) OVER (ORDER BY year)) AS g FROM (SELECT year, ln(sum(y))-0.2*ln(sum(x_l))-0.25*ln(sum(x_s))-0.15*ln(sum(x_k))-0.4*ln(sum(x_m)) AS t FROM"
_SAMPLES = f"""{HOLES_SQL}, full_ AS (SELECT unit FROM holes GROUP BY unit HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM holes)),
 s AS (SELECT 'all observations' AS rows_of, {_TOTALS} holes GROUP BY year) UNION ALL SELECT 'balanced units' AS rows_of, {_TOTALS} holes WHERE unit IN (SELECT unit FROM full_) GROUP BY year))"""


@query("e09e_totals_by_sample", f"WITH {_SAMPLES} SELECT rows_of, round(avg(g),6) AS mean, round(stddev_samp(g),6) AS sd, round(min(g),6) AS least, round(max(g),6) AS most, count(g) AS years FROM s GROUP BY rows_of")
def e09e(spark, d):
    """Growth of the totals' residual over all observations, and over the units that are there every year: how much
    of the movement comes from who is counted."""
    rows = with_holes(panel(spark, d))
    both = {"all observations": rows, "balanced units": P.balanced(rows)}
    a, b = (accounts(v).select(F.lit(k).alias("rows_of"), F.col("tfp").alias("g")) for k, v in both.items())
    out = a.unionByName(b).groupBy("rows_of").agg(F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"), F.min("g").alias("least"), F.max("g").alias("most"), F.count("g").alias("years"))
    return rounded(out, 6)


_MA = "CASE WHEN count(g) OVER w{k} >= {m} THEN avg(g) OVER w{k} END"


@query("e09d_smoothing", f"WITH {NATIONAL_SQL}, s AS (SELECT year, 100*(exp(dln_weighted)-1) AS g FROM national), m AS (SELECT year, g, {_MA.format(k=3, m=2)} AS ma3, {_MA.format(k=5, m=3)} AS ma5 FROM s WINDOW w3 AS (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w5 AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT round(avg(g),6) AS mean_raw, round(stddev_samp(g),6) AS sd_raw, round(avg(ma3),6) AS mean_ma3, round(stddev_samp(ma3),6) AS sd_ma3, round(avg(ma5),6) AS mean_ma5, round(stddev_samp(ma5),6) AS sd_ma5 FROM m")
def e09d(spark, d):
    """National winsorized growth, raw and as three- and five-year moving averages."""
    w = Window.orderBy("year")  # a row per year
    g = national(spark, d).select("year", (100 * F.expm1("dln_weighted")).alias("raw"))
    m = g.withColumns({"ma3": P.rolling("raw", "avg", 1, 2, w), "ma5": P.rolling("raw", "avg", 2, 3, w)})
    return rounded(m.agg(*[f(k).alias(f"{n}_{k}") for k in ("raw", "ma3", "ma5") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]), 6)
