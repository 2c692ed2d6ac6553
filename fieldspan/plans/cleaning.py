"""Cleaning queries on the dirtied panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspan.operators import cleaning as C
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import DIRTY_SQL, VARS, deflator, dirtied, hundredths, panel, table

_NEAR = "year-py=1 AND ny-year=1"
_SLIP = DIRTY_SQL + f""", n AS (SELECT *, lag(y) OVER w AS yp, lead(y) OVER w AS yn, lag(x_m) OVER w AS mp, lead(x_m) OVER w AS mn, lag(year) OVER w AS py, lead(year) OVER w AS ny FROM dirty WINDOW w AS (PARTITION BY unit ORDER BY year)),
 s AS (SELECT *, coalesce({_NEAR} AND y>0 AND yp>0 AND yn>0 AND x_m>0 AND mp>0 AND mn>0 AND sqrt(yp*yn)/nullif(y,0) > 2000 AND sqrt(yp*yn)/nullif(y,0) < 50000 AND sqrt(mp*mn)/nullif(x_m,0) > 2000 AND sqrt(mp*mn)/nullif(x_m,0) < 50000, false) AS slip FROM n),
 fixed AS (SELECT unit, sid, region, year, CASE WHEN slip THEN y*10000 ELSE y END AS y, x_l, x_s, x_k, CASE WHEN slip THEN x_m*10000 ELSE x_m END AS x_m, slip FROM s)"""


def fixed(spark, d):
    return C.unit_slips(dirtied(panel(spark, d)), ("y", "x_m"), ("y", "x_m"))


@query("c01_unit_slips", f"WITH {_SLIP} SELECT unit, year, slip, round(y,6) AS y, round(x_m,6) AS x_m FROM fixed")
def c01(spark, d):
    return rounded(fixed(spark, d).select("unit", "year", "slip", "y", "x_m"), 6)


@query("c02_deflated", f"WITH {_SLIP} SELECT unit, year, round(y/(1+0.03*(year-1995)+sid/1000.0),6) AS real_y FROM fixed")
def c02(spark, d):
    return fixed(spark, d).select("unit", "year", F.round(F.col("y") / deflator(), 6).alias("real_y"))


@query("c03_raw_snapshot", f"WITH {DIRTY_SQL} SELECT unit, year, {', '.join(f'{v}, {v} AS {v}_raw, false AS {v}_imp' for v in VARS)} FROM dirty")
def c03(spark, d):
    return C.snapshot(dirtied(panel(spark, d)).select("unit", "year", *VARS), VARS)


_VALID = ", ".join(f"CASE WHEN {v}<>0 AND NOT ({v}>0 AND {v}<1) THEN {v} END AS {v}" for v in VARS)


@query("c04_invalid_to_null", f"WITH {DIRTY_SQL} SELECT unit, year, {_VALID} FROM dirty")
def c04(spark, d):
    return C.invalid_to_null(dirtied(panel(spark, d)).select("unit", "year", *VARS), VARS)


@query("c06_placeholders", f"WITH {DIRTY_SQL}, c AS (SELECT region, year, x_k, count(*) AS n FROM dirty GROUP BY 1,2,3), t AS (SELECT region, year, sum(n) AS al, max(n) AS top, arg_max(x_k, (n, -x_k)) AS m FROM c GROUP BY 1,2), b AS (SELECT region, year, m FROM t WHERE al>=5 AND top > 0.1*al) SELECT d.unit AS unit, d.year AS year, CASE WHEN m IS NULL OR x_k<>m THEN x_k END AS x_k FROM dirty d LEFT JOIN b ON d.region=b.region AND d.year=b.year")
def c06(spark, d):
    return C.placeholders_to_null(dirtied(panel(spark, d)), "x_k", ("region", "year"), share=0.1).select("unit", "year", "x_k")


_STEPS = " UNION ALL ".join(f"SELECT unit, region, year, '{v}' AS var, {v} AS v FROM dirty" for v in VARS)


@query("c07_caliber_years", f"WITH {DIRTY_SQL}, l AS (SELECT unit, region, year, var, ln(v) AS l FROM ({_STEPS}) WHERE v > 0), s AS (SELECT *, l-lag(l) OVER w AS d, year-lag(year) OVER w AS gap FROM l WINDOW w AS (PARTITION BY unit, var ORDER BY year)), f AS (SELECT region, year, var, count(*) AS n, avg(CASE WHEN abs(d)>0.3 THEN 1.0 ELSE 0.0 END) AS share FROM s WHERE gap=1 GROUP BY 1,2,3 HAVING count(*)>=10 AND avg(CASE WHEN abs(d)>0.3 THEN 1.0 ELSE 0.0 END) > 0.35) SELECT region, year, var, n, round(share,8) AS share, count(*) OVER (PARTITION BY region, year) >= 2 AS strong FROM f")
def c07(spark, d):
    return rounded(C.caliber_years(dirtied(panel(spark, d)), VARS, group="region"))


@query("c10_level_reference", f"WITH {DIRTY_SQL} SELECT sid, year, round(median(CASE WHEN x_m>0 THEN ln(x_m) END),8) AS ref FROM dirty GROUP BY 1,2")
def c10(spark, d):
    return rounded(C.level_reference(dirtied(panel(spark, d)), "x_m"))


_CHAIN = """rows AS (SELECT unit, sid, year, ln(x_m) AS l FROM dirty WHERE x_m > 0),
 steps AS (SELECT *, l-lag(l) OVER w AS d, year-lag(year) OVER w AS gap FROM rows WINDOW w AS (PARTITION BY unit ORDER BY year)),
 med AS (SELECT sid, year, median(d) AS step FROM steps WHERE gap=1 GROUP BY 1,2), level AS (SELECT sid, year, median(l) AS level FROM rows GROUP BY 1,2),
 first AS (SELECT sid, min(year)-1 AS base FROM med GROUP BY 1),
 start AS (SELECT l.sid AS sid, coalesce(max(CASE WHEN year=base THEN level END), arg_min(level, year)) AS start, coalesce(max(base), min(year)) AS base FROM level l LEFT JOIN first f ON l.sid=f.sid GROUP BY l.sid),
 chain AS (SELECT l.sid AS sid, l.year AS year, start + sum(coalesce(step,0)) OVER (PARTITION BY l.sid ORDER BY l.year) AS ref FROM level l LEFT JOIN med m ON l.sid=m.sid AND l.year=m.year JOIN start s ON s.sid=l.sid WHERE l.year >= base)"""


@query("c11_chain_reference", f"WITH {DIRTY_SQL}, {_CHAIN} SELECT sid, year, round(ref,8) AS ref FROM chain")
def c11(spark, d):
    return rounded(C.chain_reference(dirtied(panel(spark, d)), "x_m"))


_IMPUTE = """str AS (SELECT unit, 1995 + unit % 4 AS a, 1995 + unit % 4 + unit % 3 AS b FROM (SELECT DISTINCT unit FROM dirty)),
 yrs AS (SELECT unit, a, b, unnest(range(a, b+1)) AS year FROM str), u AS (SELECT unit, min(sid) AS sid FROM dirty GROUP BY unit),
 j AS (SELECT y.unit AS unit, y.year AS year, a-1 AS t0, b+1 AS t3, p.x_m AS v0, q.x_m AS v3, r0.ref AS r0, r3.ref AS r3, r.ref AS r FROM yrs y JOIN u ON u.unit=y.unit
  LEFT JOIN dirty p ON p.unit=y.unit AND p.year=a-1 AND p.x_m>0 LEFT JOIN dirty q ON q.unit=y.unit AND q.year=b+1 AND q.x_m>0
  LEFT JOIN chain r0 ON r0.sid=u.sid AND r0.year=a-1 LEFT JOIN chain r3 ON r3.sid=u.sid AND r3.year=b+1 LEFT JOIN chain r ON r.sid=u.sid AND r.year=y.year)"""


@query("c12_anchored_imputation", f"WITH {DIRTY_SQL}, {_CHAIN}, {_IMPUTE} SELECT unit, CAST(year AS INT) AS year, CASE WHEN v0 IS NULL OR v3 IS NULL THEN NULL ELSE round(exp(coalesce(r + (ln(v0)-r0) + ((ln(v3)-r3)-(ln(v0)-r0))*(year-t0)/(t3-t0), ln(v0)+(ln(v3)-ln(v0))*(year-t0)/(t3-t0))),4) END AS imputed, CASE WHEN v0 IS NULL OR v3 IS NULL THEN 'hold' WHEN r IS NOT NULL AND r0 IS NOT NULL AND r3 IS NOT NULL THEN 'reference' ELSE 'log-linear' END AS method FROM j")
def c12(spark, d):
    rows = dirtied(panel(spark, d))
    a = 1995 + F.col("unit") % 4
    stretches = rows.select("unit").distinct().select("unit", a.alias("a"), (a + F.col("unit") % 3).alias("b"))
    return rounded(C.imputed(stretches, rows, C.chain_reference(rows, "x_m"), "x_m"), 4)


@query("c14_drop_empty_units", f"WITH {DIRTY_SQL}, g AS (SELECT *, CASE WHEN unit % 17 <> 3 THEN x_s END AS z FROM dirty) SELECT unit, year, z FROM g WHERE unit IN (SELECT unit FROM g GROUP BY unit HAVING count(z) > 0 AND count(x_m) > 0)")
def c14(spark, d):
    rows = dirtied(panel(spark, d)).withColumn("z", F.when(F.col("unit") % 17 != 3, F.col("x_s")))
    return C.drop_empty_units(rows, ("z", "x_m")).select("unit", "year", "z")


@query("c15_manual_stretches", f"WITH {DIRTY_SQL}, chain AS (SELECT sid, year, median(CASE WHEN x_m>0 THEN ln(x_m) END) AS ref FROM dirty GROUP BY 1,2), {_IMPUTE} SELECT unit, CAST(year AS INT) AS year, round(exp(coalesce(r + (ln(v0)-r0) + ((ln(v3)-r3)-(ln(v0)-r0))*(year-t0)/(t3-t0), ln(v0)+(ln(v3)-ln(v0))*(year-t0)/(t3-t0))),4) AS imputed FROM j WHERE v0 IS NOT NULL AND v3 IS NOT NULL")
def c15(spark, d):
    """Listed stretches; the list holds no two that overlap, so their order is no matter."""
    rows = dirtied(panel(spark, d))
    a = 1995 + F.col("unit") % 4
    stretches = rows.select("unit").distinct().select("unit", a.alias("a"), (a + F.col("unit") % 3).alias("b"))
    return rounded(C.imputed(stretches, rows, C.level_reference(rows, "x_m"), "x_m").where("method <> 'hold'").drop("method"), 4)


@query("c16_low_backstop", f"WITH {DIRTY_SQL}, m AS (SELECT unit, median(y) AS m FROM dirty WHERE y>0 GROUP BY unit) SELECT d.unit AS unit, year, coalesce(y>0 AND y<m/1000, false) AS low, CASE WHEN NOT coalesce(y>0 AND y<m/1000, false) THEN y END AS y FROM dirty d LEFT JOIN m ON d.unit=m.unit")
def c16(spark, d):
    return C.low_backstop(dirtied(panel(spark, d)), "y").select("unit", "year", "low", "y")


@query("c17_cleaning_audit", f"WITH {_SLIP} SELECT year, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE slip) AS BIGINT) AS rescaled, round(avg(CASE WHEN slip OR x_m IS NULL OR x_l=0 OR x_s<1 THEN 1.0 ELSE 0.0 END),8) AS touched FROM fixed GROUP BY year")
def c17(spark, d):
    bad = F.col("slip") | F.col("x_m").isNull() | F.coalesce(F.col("x_l") == 0, F.lit(False)) | F.coalesce(F.col("x_s") < 1, F.lit(False))
    return fixed(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("cells"), F.count_if("slip").alias("rescaled"), F.round(F.avg(bad.cast("double")), 8).alias("touched"))


def quarters(spark, d):
    """unit x quarter sums with planted spikes and leading runs: the scans need more than seven periods."""
    li = table(spark, d, "lineitem")
    q = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    rows = li.groupBy(F.col("l_suppkey").cast("int").alias("unit"), q.cast("int").alias("year")).agg((F.sum(hundredths("l_extendedprice") * (100 - hundredths("l_discount"))) / 10000).alias("y"), F.sum("l_quantity").alias("x_l"))
    code = F.col("unit") * 31 + F.col("year")
    run = (F.col("unit") % 9 == 0) & (F.col("year") < 4)
    return rows.select("unit", "year", F.when(run, F.col("y") / 1000).when(code % 29 == 0, F.col("y") * 60).otherwise(F.col("y")).alias("y"), F.when(code % 31 == 7, F.col("x_l") / 200).otherwise(F.col("x_l")).alias("x_l"))


_QUARTERS = """q0 AS (SELECT CAST(l_suppkey AS INT) AS unit, CAST((year(l_shipdate)-1995)*4+quarter(l_shipdate)-1 AS INT) AS year, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)*(100-CAST(round(l_discount*100) AS BIGINT))) AS DOUBLE)/10000 AS y, sum(l_quantity) AS x_l FROM lineitem GROUP BY 1,2),
 q AS (SELECT unit, year, CASE WHEN unit%9=0 AND year<4 THEN y/1000 WHEN (unit*31+year)%29=0 THEN y*60 ELSE y END AS y, CASE WHEN (unit*31+year)%31=7 THEN x_l/200 ELSE x_l END AS x_l FROM q0)"""

#: Places count from 1. Candidates of one to three years are judged first; the walk then skips what it has found.
_SPIKES = "RECURSIVE " + _QUARTERS + """, long AS (SELECT unit, year, 'y' AS var, y AS v FROM q UNION ALL SELECT unit, year, 'x_l', x_l FROM q),
 s AS (SELECT unit, var, list(year ORDER BY year) AS t, list(CASE WHEN v>0 THEN ln(v) END ORDER BY year) AS l FROM long GROUP BY 1,2),
 c AS (SELECT unit, var, t, l, i, n FROM (SELECT *, unnest(range(2, len(t))) AS i FROM s) CROSS JOIN (VALUES (1),(2),(3)) k(n)
  WHERE i+n <= len(t) AND t[i+n]-t[i-1] = n+1 AND list_count(l[i-1:i+n]) = n+2 AND (n<2 OR abs(l[i+1]-l[i]) < ln(2.0)) AND (n<3 OR abs(l[i+2]-l[i+1]) < ln(2.0))
   AND abs(l[i]-l[i-1]) > ln(4.0) AND abs(l[i+n]-l[i+n-1]) > ln(4.0) AND (l[i]-l[i-1])*(l[i+n]-l[i+n-1]) < 0),
 m AS (SELECT *, [x FOR x IN l[greatest(1,i-5):i+n+4] IF x IS NOT NULL] AS near FROM c),
 d AS (SELECT *, list_aggregate(near, 'median') AS level, abs(list_aggregate(l[i:i+n-1], 'median')-list_aggregate(near, 'median')) AS off, abs((l[i-1]+l[i+n])/2-list_aggregate(near, 'median')) AS anchors FROM m),
 ok AS (SELECT unit, var, i, min(n) AS n FROM d WHERE len(near) < 5 OR off > anchors GROUP BY 1,2,3),
 walk(unit, var, last, i, n) AS (SELECT s.unit, s.var, len(t)-1, 2, ok.n FROM s LEFT JOIN ok ON ok.unit=s.unit AND ok.var=s.var AND ok.i=2
  UNION ALL SELECT w.unit, w.var, w.last, w.i+coalesce(w.n,1), ok.n FROM walk w LEFT JOIN ok ON ok.unit=w.unit AND ok.var=w.var AND ok.i=w.i+coalesce(w.n,1) WHERE w.i+coalesce(w.n,1) <= w.last),
 found AS (SELECT d.unit AS unit, d.var AS var, t[d.i] AS a, t[d.i+d.n-1] AS b, d.n AS n, level, off, anchors FROM walk w JOIN d ON d.unit=w.unit AND d.var=w.var AND d.i=w.i AND d.n=w.n)"""

_RUNS = _QUARTERS + """, s AS (SELECT unit, list(year ORDER BY year) AS t, list(y ORDER BY year) AS v FROM q WHERE y > 0 GROUP BY unit HAVING count(*) >= 8),
 j AS (SELECT *, unnest(range(1, least(len([x FOR x IN t IF x < 8]), len(t)-3)+1)) AS j FROM s),
 core AS (SELECT *, list_aggregate(v[j+1:j+5], 'median') AS mid FROM j WHERE abs(ln(v[j+1])-ln(v[j])) > ln(4.0)),
 off AS (SELECT *, [k FOR k IN range(1, j+1) IF abs(ln(v[k])-ln(mid)) > ln(4.0)] AS off FROM core),
 best AS (SELECT unit, max(j) AS j FROM off WHERE len(off) > 0 AND off[1] = 1 GROUP BY unit),
 f AS (SELECT o.*, mid/list_aggregate([v[k] FOR k IN off], 'median') AS r FROM off o JOIN best b ON b.unit=o.unit AND b.j=o.j),
 run AS (SELECT unit, t, v, unnest(off) AS k, CASE WHEN abs(log10(r)-round(log10(r))) <= 0.10 THEN pow(10.0, round(log10(r))) END AS factor FROM f)"""


@query("c05_leading_run_splice", f"WITH {_RUNS} SELECT unit, t[k] AS year, CASE WHEN factor IS NULL THEN 'null' ELSE 'rescale' END AS action, factor, round(v[k],4) AS value_before, round(v[k]*factor,4) AS value_after FROM run")
def c05(spark, d):
    return rounded(C.spliced(quarters(spark, d), "y", before=8).drop("var"), 4)


@query("c05b_two_series_splice", f"WITH {_RUNS}, c AS (SELECT unit, t[k] AS year, factor FROM run), q2 AS (SELECT unit, year, y, y/(1+year/97) AS z FROM q) SELECT q2.unit AS unit, q2.year AS year, round(CASE WHEN c.unit IS NULL THEN y WHEN factor IS NOT NULL THEN y*factor END,4) AS y, round(CASE WHEN c.unit IS NULL THEN z WHEN factor IS NOT NULL THEN z*factor END,4) AS z FROM q2 LEFT JOIN c ON c.unit=q2.unit AND c.year=q2.year")
def c05b(spark, d):
    """The run is found in the nominal series; both it and the deflated one are rescaled, or NULL."""
    two = quarters(spark, d).select("unit", "year", "y", (F.col("y") / (1 + F.col("year") / 97)).alias("z"))
    return rounded(C.spliced_in(two, C.spliced(two, "y", ("z",), before=8)), 4)


@query("c08_spike_scan", f"WITH {_SPIKES} SELECT unit, var, a AS start, b AS end, CAST(n AS INT) AS length FROM found")
def c08(spark, d):
    return C.scan(quarters(spark, d), ("y", "x_l")).select("unit", "var", "start", "end", "length")


@query("c09_arbitrated_spikes", f"WITH {_SPIKES} SELECT unit, a AS start, b AS end, round(level,8) AS level, round(off,8) AS off, round(anchors,8) AS anchors FROM found WHERE var='y'")
def c09(spark, d):
    """Spike stretches with what settled them: the local level, and the distances of stretch and anchors."""
    return rounded(C.scan(quarters(spark, d), ("y",)).drop("var", "length"))


_LOG = _SPIKES + ", dirty AS (SELECT unit, 0 AS sid, year, y AS x_m FROM q), " + _CHAIN + ", str AS (SELECT unit, a, b FROM found WHERE var='y'), " + _IMPUTE[_IMPUTE.index("yrs AS") :]


@query("c13_anomaly_log", f"WITH {_LOG} SELECT j.unit AS unit, j.year AS year, round(q.y,4) AS original, CASE WHEN v0 IS NULL OR v3 IS NULL THEN NULL ELSE round(exp(coalesce(r + (ln(v0)-r0) + ((ln(v3)-r3)-(ln(v0)-r0))*(j.year-t0)/(t3-t0), ln(v0)+(ln(v3)-ln(v0))*(j.year-t0)/(t3-t0))),4) END AS imputed, CASE WHEN v0 IS NULL OR v3 IS NULL THEN 'hold' WHEN r IS NOT NULL AND r0 IS NOT NULL AND r3 IS NOT NULL THEN 'reference' ELSE 'log-linear' END AS method FROM j JOIN q ON q.unit=j.unit AND q.year=j.year")
def c13(spark, d):
    """Each stretch's years with original and imputed value; ``hold`` where an anchor is missing."""
    rows = quarters(spark, d).withColumn("sid", F.lit(0))
    found = C.scan(rows, ("y",)).select("unit", F.col("start").alias("a"), F.col("end").alias("b"))
    out = C.imputed(found, rows, C.chain_reference(rows, "y"), "y")
    return rounded(out.join(rows.select("unit", "year", F.col("y").alias("original")), ["unit", "year"]).select("unit", "year", "original", "imputed", "method"), 4)
