"""Frontier queries with one input; the SQL finds the same values from pairs of points."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldspan.operators import frontier as O, panel as P
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import HOLES_SQL, PANEL_SQL, panel, with_holes

_N = "CAST(count(*) AS BIGINT)"
#: Points no other of the year beats, and the frontier at (t, x0) as the best point or chord.
PARETO_SQL = HOLES_SQL + ", par AS (SELECT year, x_m, y FROM (SELECT year, x_m, y, max(y) OVER (PARTITION BY year ORDER BY x_m, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM holes) WHERE m IS NULL OR y > m)"


def _seq(points: str) -> str:
    return f"yrs AS (SELECT DISTINCT year AS t FROM holes), allp AS (SELECT t, x_m, y FROM yrs JOIN {points} ON year <= t), seq AS (SELECT t, x_m, y FROM (SELECT t, x_m, y, max(y) OVER (PARTITION BY t ORDER BY x_m, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM allp) WHERE m IS NULL OR y > m)"


def _f(points: str, key: str, at: str) -> str:
    """Frontier values of rows (k, x0) of ``at`` on ``points`` (key, x_m, y): SQL for k, x0, f."""
    return f"""(SELECT k, x0, max(f) AS f FROM (
 SELECT a.k AS k, x0, y*least(1.0, x0/x_m) AS f FROM {at} a JOIN {points} p ON p.{key}=a.k
 UNION ALL SELECT a.k, x0, p.y+(q.y-p.y)*(x0-p.x_m)/(q.x_m-p.x_m) FROM {at} a JOIN {points} p ON p.{key}=a.k AND p.x_m<=x0 JOIN {points} q ON q.{key}=a.k AND q.x_m>x0) GROUP BY 1,2)"""


def rows(spark, d):
    return with_holes(panel(spark, d))


@query("f01_non_dominated", f"WITH {HOLES_SQL} SELECT unit, year FROM holes a WHERE NOT EXISTS (SELECT 1 FROM holes b WHERE b.year=a.year AND b.unit<>a.unit AND b.y>=a.y-1e-9 AND b.x_l<=a.x_l+1e-9 AND b.x_s<=a.x_s+1e-9 AND b.x_k<=a.x_k+1e-9 AND b.x_m<=a.x_m+1e-9)")
def f01(spark, d):
    return O.non_dominated(rows(spark, d), ["year"], ["x_l", "x_s", "x_k", "x_m"], "y", ("unit",)).select("unit", "year")


@query("f03_one_input_value", f"WITH {PARETO_SQL}, ats AS (SELECT DISTINCT year AS k, x_m AS x0 FROM holes), f AS {_f('par', 'year', 'ats')} SELECT unit, year, round(f,4) AS f, round(y/f,8) AS theta FROM holes JOIN f ON k=year AND x0=x_m")
def f03(spark, d):
    r = rows(spark, d)
    h = O.as_array(O.vertices(r, ["year"], "x_m", "y"), ["year"], "x_m", "y")
    v = r.join(h, "year").withColumn("f", O.value("hull", "x_m"))
    return rounded(v.select("unit", "year", "f", (F.col("y") / F.col("f")).alias("theta")), f=4)


_SEQ_SQL = f"WITH {PARETO_SQL}, {_seq('par')}"


@query("f04_sequential_reference", f"{_SEQ_SQL}, ats AS (SELECT DISTINCT year AS k, x_m AS x0 FROM holes), f AS {_f('seq', 't', 'ats')} SELECT unit, year, round(f,4) AS f FROM holes JOIN f ON k=year AND x0=x_m")
def f04(spark, d):
    r = rows(spark, d)
    v = O.sequential(O.vertices(r, ["year"], "x_m", "y"), r.select("year").distinct(), "x_m", "y")
    h = O.as_array(v, ["t"], "x_m", "y").withColumnRenamed("t", "year")
    return rounded(r.join(h, "year").select("unit", "year", O.value("hull", "x_m").alias("f")), 4)


_MALM = f"""{_SEQ_SQL}, ats AS (SELECT DISTINCT year+s AS k, x_m AS x0 FROM holes CROSS JOIN (SELECT unnest([-1,0,1]) AS s)), f AS {_f('seq', 't', 'ats')},
 m AS (SELECT c.unit AS unit, c.year AS year, ln(c.y/tt.f) AS tt, ln(p.y/pp.f) AS pp, ln(c.y/pt.f) AS pt, ln(p.y/tp.f) AS tp FROM holes c JOIN holes p ON p.unit=c.unit AND p.year=c.year-1
 JOIN f tt ON tt.k=c.year AND tt.x0=c.x_m JOIN f pp ON pp.k=c.year-1 AND pp.x0=p.x_m JOIN f pt ON pt.k=c.year-1 AND pt.x0=c.x_m JOIN f tp ON tp.k=c.year AND tp.x0=p.x_m)"""


@query("f05_malmquist", f"{_MALM} SELECT unit, year, round(((pt-pp)+(tt-tp))/2,8) AS lnM, round(tt-pp,8) AS lnEC, round(((pt-pp)+(tt-tp))/2-(tt-pp),8) AS lnTC, round(exp(pp),8) AS eff_prev, round(exp(tt),8) AS eff_now FROM m")
def f05(spark, d):
    return rounded(O.malmquist(rows(spark, d), "x_m", "y"))


@query("f06_hull_defining_points", f"WITH {PARETO_SQL}, ats AS (SELECT DISTINCT year AS k, x_m AS x0 FROM par), f AS {_f('par', 'year', 'ats')}, r AS (SELECT year, max(y/x_m) AS slope FROM holes GROUP BY year) SELECT par.year AS year, {_N} AS defining, round(max(slope),8) AS crs_slope FROM par JOIN f ON k=par.year AND x0=x_m AND y >= f*(1-1e-12) JOIN r ON r.year=par.year GROUP BY par.year")
def f06(spark, d):
    r = rows(spark, d)
    n = O.vertices(r, ["year"], "x_m", "y").groupBy("year").agg(F.count(F.lit(1)).alias("defining"))
    s = O.vertices(r, ["year"], "x_m", "y", "crs").select("year", F.round(F.col("y") / F.col("x_m"), 8).alias("crs_slope"))
    return n.join(s, "year")


_QP = """l AS (SELECT region, ln(x_m) AS lx, ln(y) AS ly FROM panel), q AS (SELECT region, quantile_cont(lx,0.005) AS lo, quantile_cont(lx,0.995) AS hi FROM l GROUP BY region),
 b AS (SELECT l.region AS region, greatest(0, least(7, CAST(floor((lx-lo)/((hi-lo)/8)) AS INT))) AS bin, lx, ly FROM l JOIN q ON q.region=l.region),
 pts AS (SELECT region, bin, count(*) AS n, median(lx) AS lx, quantile_cont(ly,0.95) AS ly FROM b GROUP BY 1,2 HAVING count(*) >= 5)"""


@query("f07_quantile_frontier", f"WITH {PANEL_SQL}, {_QP}, p AS (SELECT region, exp(lx) AS x, exp(ly) AS y FROM pts), v AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.region=a.region AND b.x<=a.x AND b.y>=a.y AND (b.x<a.x OR b.y>a.y)) AND NOT EXISTS (SELECT 1 FROM p b JOIN p c ON b.region=a.region AND c.region=a.region AND b.x<a.x AND c.x>a.x AND b.y+(c.y-b.y)*(a.x-b.x)/(c.x-b.x) >= a.y)) SELECT region, round(x,2) AS x, round(y,2) AS y FROM v")
def f07(spark, d):
    return rounded(O.quantile_frontier(panel(spark, d), "x_m", "y", ["region"], bins=8, least=5), 2)


@query("f08_unit_isoquant", f"WITH {PANEL_SQL}, p AS (SELECT year, x_l/y AS a, x_m/y AS b FROM panel), v AS (SELECT * FROM p t WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.year=t.year AND b.a<=t.a AND b.b<=t.b AND (b.a<t.a OR b.b<t.b)) AND NOT EXISTS (SELECT 1 FROM p b JOIN p c ON b.year=t.year AND c.year=t.year AND b.a<t.a AND c.a>t.a AND b.b+(c.b-b.b)*(t.a-b.a)/(c.a-b.a) <= t.b)) SELECT year, round(a,10) AS a, round(b,10) AS b FROM v")
def f08(spark, d):
    pts = panel(spark, d).select("year", (F.col("x_l") / F.col("y")).alias("a"), (F.col("x_m") / F.col("y")).alias("b"))
    return rounded(O.lower_hull(O.pareto_chain(pts, ["year"], "a", "b"), ["year"], "a", "b"), 10)


@query("f14_national_summary", f"{_MALM}, g AS (SELECT m.unit AS unit, m.year AS year, ((pt-pp)+(tt-tp))/2 AS lnM, tt-pp AS lnEC, y FROM m JOIN holes h ON h.unit=m.unit AND h.year=m.year) SELECT year, {_N} AS n, round(avg(lnM),8) AS simple, round(sum(lnM*y)/sum(y),8) AS weighted, round(avg(lnEC),8) AS ec FROM g GROUP BY year")
def f14(spark, d):
    m = O.malmquist(rows(spark, d), "x_m", "y").join(rows(spark, d).select("unit", "year", "y"), ["unit", "year"])
    return rounded(m.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("lnM").alias("simple"), (F.sum(F.col("lnM") * F.col("y")) / F.sum("y")).alias("weighted"), F.avg("lnEC").alias("ec")))


@query("f16_near_origin_vertex", f"WITH {HOLES_SQL} SELECT year, CAST(arg_max(unit, y/x_m) AS INT) AS unit, round(max(y/x_m),8) AS slope FROM holes GROUP BY year")
def f16(spark, d):
    r = F.col("y") / F.col("x_m")
    return rows(spark, d).groupBy("year").agg(F.max_by("unit", r).alias("unit"), F.round(F.max(r), 8).alias("slope"))


_LOO = f"""WITH {PARETO_SQL}, best AS (SELECT year, arg_max(unit, y/x_m) AS unit FROM holes GROUP BY year),
 par2 AS (SELECT year, x_m, y FROM (SELECT h.year AS year, x_m, y, max(y) OVER (PARTITION BY h.year ORDER BY x_m, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM holes h JOIN best b ON b.year=h.year AND b.unit<>h.unit) WHERE m IS NULL OR y > m),
 ats AS (SELECT DISTINCT h.year AS k, x_m AS x0 FROM holes h JOIN best b ON b.year=h.year AND b.unit<>h.unit), f AS {_f('par', 'year', 'ats')}, g AS {_f('par2', 'year', 'ats')}"""


@query("f17_leave_one_out", f"{_LOO} SELECT h.year AS year, round(avg(y/g.f-y/f.f),8) AS mean_shift, round(max(y/g.f-y/f.f),8) AS max_shift, round(avg(CASE WHEN abs(y/g.f-y/f.f)>0.01 THEN 1.0 ELSE 0.0 END),8) AS moved FROM holes h JOIN best b ON b.year=h.year AND b.unit<>h.unit JOIN f ON f.k=h.year AND f.x0=x_m JOIN g ON g.k=h.year AND g.x0=x_m GROUP BY h.year")
def f17(spark, d):
    """Efficiencies before and after the year's steepest unit leaves the reference."""
    r = rows(spark, d)
    best = r.groupBy("year").agg(F.max_by("unit", F.col("y") / F.col("x_m")).alias("gone"))
    rest = r.join(best, "year").where("unit <> gone")
    a = O.as_array(O.vertices(r, ["year"], "x_m", "y"), ["year"], "x_m", "y", "h1")
    b = O.as_array(O.vertices(rest, ["year"], "x_m", "y"), ["year"], "x_m", "y", "h2")
    s = rest.join(a, "year").join(b, "year").withColumn("s", F.col("y") / O.value("h2", "x_m") - F.col("y") / O.value("h1", "x_m"))
    return rounded(s.groupBy("year").agg(F.avg("s").alias("mean_shift"), F.max("s").alias("max_shift"), F.avg((F.abs("s") > 0.01).cast("double")).alias("moved")))


_VERT = f"WITH {PARETO_SQL}, ats AS (SELECT DISTINCT year AS k, x_m AS x0 FROM par), f AS {_f('par', 'year', 'ats')}, vert AS (SELECT h.unit AS unit, h.year AS year, h.x_m AS x_m, h.y AS y, sid FROM holes h JOIN f ON k=h.year AND x0=h.x_m AND h.y >= f*(1-1e-12))"


def identified(spark, d):
    return O.vertices(rows(spark, d), ["year"], "x_m", "y", keep=("unit", "sid"))


@query("f18_vertex_identities", f"{_VERT} SELECT unit, year FROM vert")
def f18(spark, d):
    return identified(spark, d).select("unit", "year")


@query("j16_identity_merge", f"{_VERT} SELECT v.unit AS unit, v.year AS year, round(h.x_k,6) AS x_k FROM vert v JOIN holes h ON h.unit=v.unit AND h.year=v.year")
def j16(spark, d):
    return identified(spark, d).select("unit", "year").join(rows(spark, d).select("unit", "year", F.round("x_k", 6).alias("x_k")), ["unit", "year"])


_COUNT = " UNION ALL ".join(f"SELECT a.unit, a.year FROM panel a WHERE NOT EXISTS (SELECT 1 FROM panel b WHERE b.year=a.year AND b.{x}<=a.{x} AND b.y>=a.y AND (b.{x}<a.{x} OR b.y>a.y)) AND a.y*(1+1e-12) >= (SELECT max(b.y/b.{x})*a.{x} FROM panel b WHERE b.year=a.year AND b.{x}>=a.{x}) AND NOT EXISTS (SELECT 1 FROM panel b JOIN panel c ON b.year=a.year AND c.year=a.year AND b.{x}<a.{x} AND c.{x}>a.{x} AND b.y+(c.y-b.y)*(a.{x}-b.{x})/(c.{x}-b.{x}) >= a.y)" for x in ("x_l", "x_m"))


@query("f19_vertex_counts", f"WITH {PANEL_SQL}, v AS ({_COUNT}) SELECT CAST(unit AS INT) AS unit, CAST(year AS INT) AS year, {_N} AS times FROM v GROUP BY 1,2")
def f19(spark, d):
    r = panel(spark, d)
    each = [O.vertices(r, ["year"], x, "y", keep=("unit",)).select("unit", "year") for x in ("x_l", "x_m")]
    return each[0].unionByName(each[1]).groupBy("unit", "year").agg(F.count(F.lit(1)).alias("times"))


_GRID = "ends AS (SELECT greatest(min(CASE WHEN year=1996 THEN x_m END), min(CASE WHEN year=2000 THEN x_m END)) AS lo, least(max(CASE WHEN year=1996 THEN x_m END), max(CASE WHEN year=2000 THEN x_m END)) AS hi FROM holes), grid AS (SELECT exp(ln(lo)+(ln(hi)-ln(lo))*i/59.0) AS x0 FROM ends CROSS JOIN (SELECT unnest(range(0,60)) AS i)), ats AS (SELECT k, x0 FROM grid CROSS JOIN (SELECT unnest([1996,2000]) AS k))"


@query("f20_boundary_gap", f"WITH {PARETO_SQL}, {_GRID}, f AS {_f('par', 'year', 'ats')} SELECT round(median(ln(b.f/a.f)),8) AS gap, {_N} AS points FROM f a JOIN f b ON a.x0=b.x0 AND a.k=1996 AND b.k=2000")
def f20(spark, d):
    r = rows(spark, d)
    side = lambda f, y: f(F.when(F.col("year") == y, F.col("x_m")))
    ends = r.agg(F.greatest(side(F.min, 1996), side(F.min, 2000)).alias("lo"), F.least(side(F.max, 1996), side(F.max, 2000)).alias("hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.exp(F.ln("lo") + (F.ln("hi") - F.ln("lo")) * i / 59.0))).alias("x0"))
    h = O.as_array(O.vertices(r.where("year in (1996, 2000)"), ["year"], "x_m", "y"), ["year"], "x_m", "y")
    a, b = (h.where(F.col("year") == y).select(F.col("hull").alias(f"h{y}")) for y in (1996, 2000))
    gap = F.ln(O.value("h2000", "x0") / O.value("h1996", "x0"))
    return grid.join(F.broadcast(a)).join(F.broadcast(b)).agg(F.round(F.median(gap), 8).alias("gap"), F.count(F.lit(1)).alias("points"))


@query("f21_vertex_tilt", f"{_VERT}, r AS (SELECT unit, year, (rank() OVER (PARTITION BY year ORDER BY x_k) + (count(*) OVER (PARTITION BY year, x_k)-1)/2.0)/count(*) OVER (PARTITION BY year) AS p FROM holes) SELECT round(median(p),8) AS median_pctl, round(avg(CASE WHEN p<=0.1 THEN 1.0 ELSE 0.0 END),8) AS bottom FROM vert v JOIN r ON r.unit=v.unit AND r.year=v.year")
def f21(spark, d):
    p = P.percent_rank_mean_ties(rows(spark, d), "x_k", "year", "p").select("unit", "year", "p")
    return identified(spark, d).select("unit", "year").join(p, ["unit", "year"]).agg(F.round(F.median("p"), 8).alias("median_pctl"), F.round(F.avg((F.col("p") <= 0.1).cast("double")), 8).alias("bottom"))


_SURF = """s AS (SELECT year, ln(x_m) AS lx, x_k/x_l AS w, ln(y) AS ly FROM panel), e AS (SELECT quantile_cont(lx,0.01) AS xlo, quantile_cont(lx,0.99) AS xhi, quantile_cont(w,0.01) AS wlo, quantile_cont(w,0.99) AS whi FROM s),
 c AS (SELECT greatest(0,least(3,CAST(floor((lx-xlo)/((xhi-xlo)/4)) AS INT))) AS xi, greatest(0,least(2,CAST(floor((w-wlo)/((whi-wlo)/3)) AS INT))) AS wi, ly FROM s CROSS JOIN e),
 z AS (SELECT wi, xi, quantile_cont(ly,0.9) AS z, count(*) AS n FROM c GROUP BY 1,2 HAVING count(*)>=4)"""


@query("f23_quantile_surface", f"WITH {PANEL_SQL}, {_SURF} SELECT wi, xi, n, round(max(z) OVER (PARTITION BY wi ORDER BY xi),8) AS z FROM z")
def f23(spark, d):
    """Cells on a common grid; the running maximum goes along the input only."""
    s = panel(spark, d).select(F.ln("x_m").alias("lx"), (F.col("x_k") / F.col("x_l")).alias("w"), F.ln("y").alias("ly")).withColumn("all", F.lit(1))
    b = O.bins_by_width(s, "lx", 4, ["all"], 0.01, 0.99).withColumnRenamed("bin", "xi")
    b = O.bins_by_width(b, "w", 3, ["all"], 0.01, 0.99).withColumnRenamed("bin", "wi")
    z = b.groupBy("wi", "xi").agg(F.percentile("ly", F.lit(0.9)).alias("z"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    return z.select("wi", "xi", "n", F.round(F.max("z").over(Window.partitionBy("wi").orderBy("xi").rowsBetween(Window.unboundedPreceding, 0)), 8).alias("z"))


_WB = "s AS (SELECT x_k/x_l AS w, ln(y) AS ly FROM panel), q AS (SELECT list_sort(list_distinct(quantile_cont(w,[0.0,0.2,0.4,0.6,0.8,1.0]))) AS e FROM s), b AS (SELECT CAST(greatest(0,least(len(list_filter(e, lambda x: x <= w))-1, len(e)-2)) AS INT) AS bin, w, ly FROM s CROSS JOIN q), k AS (SELECT bin, median(w) AS w, quantile_cont(ly,0.9) AS q90, count(*) AS n FROM b GROUP BY bin HAVING count(*)>=5)"


@query("f24_weather_boundary", f"WITH {PANEL_SQL}, {_WB} SELECT bin, round(w,8) AS w, round(q90,8) AS q90, n, q90 = max(q90) OVER () AND bin > min(bin) OVER () AND bin < max(bin) OVER () AS interior_peak FROM k")
def f24(spark, d):
    s = panel(spark, d).select((F.col("x_k") / F.col("x_l")).alias("w"), F.ln("y").alias("ly"))
    e = P.edges(s, "w", 5)
    k = s.join(F.broadcast(e)).groupBy(P.left_closed_bin("w", F.col("edges")).alias("bin")).agg(F.median("w").alias("w"), F.percentile("ly", F.lit(0.9)).alias("q90"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    ends = k.agg(F.max("q90").alias("top"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    peak = (F.col("q90") == F.col("top")) & (F.col("bin") > F.col("lo")) & (F.col("bin") < F.col("hi"))
    return rounded(k.join(F.broadcast(ends)).select("bin", "w", "q90", "n", peak.alias("interior_peak")))


@query("f25_replication_frontier", f"WITH {PANEL_SQL}, q AS (SELECT list_sort(list_distinct(quantile_cont(x_m,[0.0,0.2,0.4,0.6,0.8,1.0]))) AS e FROM panel), b AS (SELECT greatest(0,least(len(list_filter(e, lambda x: x <= x_m))-1, len(e)-2)) AS bin, x_m, y FROM panel CROSS JOIN q), p AS (SELECT median(x_m) AS x, quantile_cont(y,0.95) AS y FROM b GROUP BY bin HAVING count(*)>=5), v AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.x<=a.x AND b.y>=a.y AND (b.x<a.x OR b.y>a.y)) AND NOT EXISTS (SELECT 1 FROM p b JOIN p c ON b.x<a.x AND c.x>a.x AND b.y+(c.y-b.y)*(a.x-b.x)/(c.x-b.x) >= a.y)) SELECT round(x,2) AS x, round(y,2) AS y FROM v")
def f25(spark, d):
    r = panel(spark, d)
    e = P.edges(r, "x_m", 5)
    pts = r.join(F.broadcast(e)).groupBy(P.left_closed_bin("x_m", F.col("edges")).alias("bin")).agg(F.median("x_m").alias("x"), F.percentile("y", F.lit(0.95)).alias("y"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return rounded(O.vertices(pts.withColumn("all", F.lit(1)), ["all"], "x", "y", "vrs").select("x", "y"), 2)


@query("f26_sector_path", f"WITH {PANEL_SQL} SELECT region, year, round(sum(y*ln(x_m))/sum(y),8) AS lx, round(sum(y*x_k/x_l)/sum(y),8) AS w, round(sum(y*ln(y))/sum(y),8) AS ly FROM panel GROUP BY 1,2")
def f26(spark, d):
    mean = lambda c: F.round(F.sum(F.col("y") * c) / F.sum("y"), 8)
    return panel(spark, d).groupBy("region", "year").agg(mean(F.ln("x_m")).alias("lx"), mean(F.col("x_k") / F.col("x_l")).alias("w"), mean(F.ln("y")).alias("ly"))


@query("j12_dominance_pairs", f"WITH {HOLES_SQL} SELECT a.unit AS unit, a.year AS year, {_N} AS beaten_by FROM holes a JOIN holes b ON b.year=a.year AND b.unit<>a.unit AND b.y>=a.y AND b.x_m<=a.x_m GROUP BY 1,2")
def j12(spark, d):
    """How many units of the year do as well with as little: counted, the pairs are not kept."""
    return O.dominated_by(rows(spark, d), ["year"], "unit", "x_m", "y").select("unit", "year", "beaten_by")
