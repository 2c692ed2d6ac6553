"""Projections, joins, aggregations, sorts, set operations and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from fieldspan.functions.expr import circular_month, clip, half_month, inside, log_positive, ratio, significant
from fieldspan.operators import index as I, panel as P, spread
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.tables import DIRTY_SQL, HOLES_SQL, PANEL_SQL, VARS, deflator, dirtied, panel, table, with_holes

_N = "CAST(count(*) AS BIGINT)"


@query("p03_year_range", f"WITH {PANEL_SQL} SELECT unit, year, y FROM panel WHERE year BETWEEN 1996 AND 1999")
def p03(spark, d):
    return panel(spark, d).where(F.col("year").between(1996, 1999)).select("unit", "year", "y")


@query("p04_exclusion_list", f"WITH {PANEL_SQL}, gone AS (SELECT CAST(s_suppkey AS INT) AS unit FROM supplier WHERE s_acctbal < 0) SELECT unit, year, y FROM panel WHERE unit NOT IN (SELECT unit FROM gone)")
def p04(spark, d):
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("int").alias("unit"))
    return panel(spark, d).join(gone, "unit", "left_anti").select("unit", "year", "y")


@query("p05_coalesced_metadata", "SELECT CAST(coalesce(a.k, b.k) AS BIGINT) AS k, coalesce(a.nm, b.nm) AS nm FROM (SELECT s_suppkey AS k, s_name AS nm FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_name AS nm FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
def p05(spark, d):
    a = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nm"))
    b = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("nm2"))
    return a.join(b, "k", "full").select("k", F.coalesce("nm", "nm2").alias("nm"))


@query("p06_safe_numeric", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, TRY_CAST(p_type AS DOUBLE) AS type_no FROM part")
def p06(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double").alias("brand_no"), F.col("p_type").try_cast("double").alias("type_no")
    )


@query("p07_log_of_positives", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal),8) END AS ln_bal FROM customer")
def p07(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(log_positive("c_acctbal"), 8).alias("ln_bal"))


@query("p08_infinite_to_null", f"WITH {DIRTY_SQL} SELECT unit, year, round(y/nullif(x_l,0),8) AS r FROM dirty")
def p08(spark, d):
    return dirtied(panel(spark, d)).select("unit", "year", F.round(ratio("y", "x_l"), 8).alias("r"))


@query("p09_digit_rows_and_enum", f"SELECT CASE lower(substr(o_orderpriority,3)) WHEN 'urgent' THEN 'top' WHEN 'high' THEN 'top' WHEN 'medium' THEN 'mid' ELSE 'rest' END AS level, {_N} AS n, CAST(count(*) FILTER (WHERE NOT regexp_matches(substr(o_orderpriority,1,1), '^[0-9]+$')) AS BIGINT) AS rejected FROM orders GROUP BY 1")
def p09(spark, d):
    names = {"urgent": "top", "high": "top", "medium": "mid"}
    key = F.lower(F.substring("o_orderpriority", 3, 100))
    level = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), list(names.items())[1:], F.when(key == "urgent", "top")).otherwise("rest")
    bad = ~F.substring("o_orderpriority", 1, 1).rlike("^[0-9]+$")
    return table(spark, d, "orders").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("rejected"))


@query("p11_province_key", "SELECT c_custkey, CAST(c_custkey // 100 AS BIGINT) AS prov, c_custkey % 100 = 0 AS is_total FROM customer")
def p11(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr("c_custkey div 100").alias("prov"), (F.col("c_custkey") % 100 == 0).alias("is_total"))


@query("p12_suffix_label", "SELECT p_partkey, (ends_with(p_type,'BRASS') OR ends_with(p_type,'STEEL') OR ends_with(p_type,'TIN')) AS flagged FROM part")
def p12(spark, d):
    ends = [F.col("p_type").endswith(x) for x in ("BRASS", "STEEL", "TIN")]
    return table(spark, d, "part").select("p_partkey", reduce(lambda a, b: a | b, ends).alias("flagged"))


@query("p14_region_label", f"WITH {PANEL_SQL}, map AS (SELECT CAST(n_nationkey AS INT) AS sid, r_name AS label FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey % 7 <> 0) SELECT label, {_N} AS n, CAST(count(DISTINCT unit) AS BIGINT) AS units FROM panel LEFT JOIN map ON panel.sid = map.sid GROUP BY label")
def p14(spark, d):
    regions = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("label"))
    names = table(spark, d, "nation").where("n_nationkey % 7 <> 0").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("int").alias("sid"), "label")
    return panel(spark, d).join(names, "sid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units"))


@query("p15_flag_not_filter", f"WITH {PANEL_SQL}, ag AS (SELECT DISTINCT unit FROM panel WHERE year = 1997 AND y > 200000) SELECT panel.unit AS unit, year, CAST(CASE WHEN ag.unit IS NULL THEN 0 ELSE 1 END AS INT) AS flag FROM panel LEFT JOIN ag ON panel.unit = ag.unit")
def p15(spark, d):
    rows = panel(spark, d)
    ag = rows.where("year = 1997 and y > 200000").select("unit").distinct().withColumn("f", F.lit(1))
    return rows.join(ag, "unit", "left").select("unit", "year", F.coalesce("f", F.lit(0)).alias("flag"))


@query("p16_clip", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5.0), 40.0) AS clipped, CASE WHEN l_quantity BETWEEN 5.0 AND 40.0 THEN l_quantity END AS nulled FROM lineitem")
def p16(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clip("l_quantity", 5.0, 40.0).alias("clipped"), inside("l_quantity", 5.0, 40.0).alias("nulled"))


@query("p17_centred_logs", f"WITH {PANEL_SQL} SELECT unit, year, round(ln(x_l)-(SELECT avg(ln(x_l)) FROM panel),8) AS c FROM panel")
def p17(spark, d):
    rows = panel(spark, d)
    mean = rows.agg(F.avg(F.ln("x_l")).alias("m"))
    return rows.join(F.broadcast(mean)).select("unit", "year", F.round(F.ln("x_l") - F.col("m"), 8).alias("c"))


@query("j01_full_outer_coalesce", f"WITH {HOLES_SQL}, a AS (SELECT unit, year, y FROM holes WHERE unit % 2 = 0), b AS (SELECT unit, year, x_l FROM holes WHERE year > 1997) SELECT CAST(coalesce(a.unit,b.unit) AS INT) AS unit, CAST(coalesce(a.year,b.year) AS INT) AS year, y, x_l FROM a FULL JOIN b ON a.unit=b.unit AND a.year=b.year")
def j01(spark, d):
    rows = with_holes(panel(spark, d))
    a = rows.where("unit % 2 = 0").select("unit", "year", "y").dropDuplicates(["unit", "year"])
    b = rows.where("year > 1997").select("unit", "year", "x_l").dropDuplicates(["unit", "year"])
    return a.join(b, ["unit", "year"], "full")


@query("j02_left_dimension", f"WITH {PANEL_SQL}, ppi AS (SELECT DISTINCT sid, year, 1+0.03*(year-1995)+sid/1000.0 AS p FROM panel WHERE sid % 6 <> 0) SELECT unit, panel.year AS year, round(y/p,6) AS real_y FROM panel LEFT JOIN ppi ON panel.sid=ppi.sid AND panel.year=ppi.year")
def j02(spark, d):
    rows = panel(spark, d)
    ppi = rows.where("sid % 6 <> 0").select("sid", "year", deflator().alias("p")).distinct()
    return rows.join(ppi, ["sid", "year"], "left").select("unit", "year", F.round(F.col("y") / F.col("p"), 6).alias("real_y"))


def unique_join(left, right, keys):
    """Inner join in which a repeated key on either side is an error at run time."""
    once = lambda df: df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_twice")), keys, "left").where(F.when(F.col("_twice"), F.raise_error(F.lit("a key is repeated")).cast("boolean")).otherwise(F.lit(True))).drop("_twice")
    return once(left).join(once(right), keys)


@query("j03_one_to_one", f"WITH {HOLES_SQL}, a AS (SELECT unit, year, y FROM holes WHERE year<=1999), b AS (SELECT unit, year, x_m FROM holes WHERE unit%3<>1) SELECT a.unit AS unit, a.year AS year, y, x_m FROM a JOIN b ON a.unit=b.unit AND a.year=b.year")
def j03(spark, d):
    rows = with_holes(panel(spark, d))
    return unique_join(rows.where("year <= 1999").select("unit", "year", "y"), rows.where("unit % 3 <> 1").select("unit", "year", "x_m"), ["unit", "year"])


@query("j04_lag_self_join", f"WITH {HOLES_SQL} SELECT a.unit AS unit, a.year AS year, a.y AS y, b.y AS y0 FROM holes a JOIN holes b ON a.unit=b.unit AND a.year=b.year+1")
def j04(spark, d):
    return I.lagged(with_holes(panel(spark, d)).select("unit", "year", "y"), "y")


@query("j05_semi_join", f"WITH {PANEL_SQL} SELECT unit, year, y FROM panel WHERE unit IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def j05(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("int").alias("unit"))
    return panel(spark, d).join(rich, "unit", "left_semi").select("unit", "year", "y")


@query("j06_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)")
def j06(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j07_adjacent_matching", f"WITH {HOLES_SQL} SELECT b.year AS year, {_N} AS matched FROM holes a JOIN holes b ON a.unit=b.unit AND b.year=a.year+1 GROUP BY b.year")
def j07(spark, d):
    return I.lagged(with_holes(panel(spark, d)).select("unit", "year", "y"), "y").groupBy("year").agg(F.count(F.lit(1)).alias("matched"))


@query("j10_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label FROM orders")
def j10(spark, d):
    names = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.col("o_orderstatus")).alias("label"))


@query("j11_dense_grid", f"WITH {HOLES_SQL} SELECT i.unit AS unit, t.year AS year, y FROM (SELECT DISTINCT unit FROM holes) i CROSS JOIN (SELECT DISTINCT year FROM holes) t LEFT JOIN holes h ON h.unit=i.unit AND h.year=t.year")
def j11(spark, d):
    """Every unit in every year between the panel's first and last that any unit has."""
    rows = with_holes(panel(spark, d))
    years = rows.select("year").distinct().agg(F.array_sort(F.collect_set("year")).alias("years"))
    grid = rows.select("unit").distinct().join(F.broadcast(years)).select("unit", F.explode("years").alias("year"))
    return grid.join(rows.select("unit", "year", "y"), ["unit", "year"], "left")


@query("j13_stretch_expansion", f"WITH {PANEL_SQL}, s AS (SELECT unit, 1996 + unit % 3 AS a, 1996 + unit % 3 + unit % 2 AS b FROM (SELECT DISTINCT unit FROM panel)), e AS (SELECT unit, a, b, unnest(range(a, b+1)) AS year FROM s) SELECT e.unit AS unit, CAST(e.year AS INT) AS year, p.y AS y, l.y AS before, r.y AS after FROM e JOIN panel p ON p.unit=e.unit AND p.year=e.year LEFT JOIN panel l ON l.unit=e.unit AND l.year=e.a-1 LEFT JOIN panel r ON r.unit=e.unit AND r.year=e.b+1")
def j13(spark, d):
    rows = panel(spark, d).select("unit", "year", "y")
    s = rows.select("unit").distinct().select("unit", (1996 + F.col("unit") % 3).alias("a"), (1996 + F.col("unit") % 3 + F.col("unit") % 2).alias("b"))
    e = s.withColumn("year", F.explode(F.sequence("a", "b")))
    left = rows.select("unit", (F.col("year") + 1).alias("a"), F.col("y").alias("before"))
    right = rows.select("unit", (F.col("year") - 1).alias("b"), F.col("y").alias("after"))
    return e.join(rows, ["unit", "year"]).join(left, ["unit", "a"], "left").join(right, ["unit", "b"], "left").select("unit", "year", "y", "before", "after")


@query("j15_many_to_one", f"WITH {PANEL_SQL}, m AS (SELECT unit // 3 AS poly, unit, avg(y) AS m FROM panel GROUP BY 1, 2) SELECT CAST(poly AS BIGINT) AS poly, round(avg(m),1) AS y, {_N} AS sources FROM m GROUP BY poly")
def j15(spark, d):
    means = panel(spark, d).groupBy(F.expr("cast(unit div 3 as bigint)").alias("poly"), "unit").agg(F.avg("y").alias("m"))
    return means.groupBy("poly").agg(F.round(F.avg("m"), 1).alias("y"), F.count(F.lit(1)).alias("sources"))


@query("a01_null_preserving_sum", f"WITH {DIRTY_SQL} SELECT CAST(unit // 2 AS BIGINT) AS target, year, round(sum(x_m),4) AS x_m FROM (SELECT unit, year, CASE WHEN unit % 10 < 2 THEN NULL ELSE x_m END AS x_m FROM dirty) GROUP BY 1, 2")
def a01(spark, d):
    rows = dirtied(panel(spark, d)).select(F.expr("cast(unit div 2 as bigint)").alias("target"), "year", F.when(F.col("unit") % 10 >= 2, F.col("x_m")).alias("x_m"))
    return rows.groupBy("target", "year").agg(F.round(F.sum("x_m"), 4).alias("x_m"))


@query("a02_moments_by_key", f"WITH {PANEL_SQL} SELECT sid, {_N} AS n, round(avg(y),1) AS mean_y, round(median(y),1) AS med_y, min(y) AS min_y, max(y) AS max_y, round(stddev_samp(y),4) AS sd_y FROM panel GROUP BY sid")
def a02(spark, d):
    return panel(spark, d).groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 1).alias("mean_y"), F.round(F.median("y"), 1).alias("med_y"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.round(F.stddev_samp("y"), 4).alias("sd_y")
    )


@query("a03_last_non_empty", "SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'F') AS last_open FROM orders GROUP BY o_custkey")
def a03(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", at).alias("first_status"), F.max_by("o_orderpriority", F.when(F.col("o_orderstatus") != "F", at)).alias("last_open"))


@query("a04_distinct_counts", "SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds, CAST(count(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM orders GROUP BY o_custkey")
def a04(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"), F.count_distinct(F.year("o_orderdate")).alias("years"))


_ABOVE = "(SELECT unit, year, y > 150000 AS above FROM panel)"


@query("a05_conditional_min_max", f"WITH {PANEL_SQL} SELECT unit, CAST(min(CASE WHEN above THEN year END) AS INT) AS first_above, CAST(max(CASE WHEN above THEN year END) AS INT) AS last_above FROM {_ABOVE} GROUP BY unit")
def a05(spark, d):
    year = F.when(F.col("y") > 150000, F.col("year"))
    return panel(spark, d).groupBy("unit").agg(F.min(year).alias("first_above"), F.max(year).alias("last_above"))


@query("a06_membership_rules", f"WITH {PANEL_SQL} SELECT unit, bool_or(above) AS in_union, bool_and(above) AS in_all, count(*) FILTER (WHERE above) >= 3 AS in_three FROM {_ABOVE} GROUP BY unit")
def a06(spark, d):
    above = F.col("y") > 150000
    return panel(spark, d).groupBy("unit").agg(F.bool_or(above).alias("in_union"), F.bool_and(above).alias("in_all"), (F.count_if(above) >= 3).alias("in_three"))


@query("a07_modal_value", "SELECT p_size, arg_max(p_brand, (n, -rk)) AS mode, round(max(n)/sum(n),8) AS share FROM (SELECT p_size, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_size ORDER BY p_brand) AS rk FROM part GROUP BY 1,2) GROUP BY p_size")
def a07(spark, d):
    counts = table(spark, d, "part").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("n"), "p_brand")))
    return best.groupBy("p_size").agg(F.max(F.when(F.col("r") == 1, F.col("p_brand"))).alias("mode"), F.round(F.max("n") / F.sum("n"), 8).alias("share"))


@query("a08_sorted_strings", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY n_regionkey")
def a08(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("names"))


@query("a09_quantile_vector", f"WITH {PANEL_SQL} SELECT year, round(quantile_cont(y,0.1),6) AS p10, round(quantile_cont(y,0.25),6) AS p25, round(quantile_cont(y,0.5),6) AS p50, round(quantile_cont(y,0.75),6) AS p75, round(quantile_cont(y,0.9),6) AS p90 FROM panel GROUP BY year")
def a09(spark, d):
    at = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = spread.quantiles(panel(spark, d), "y", ["year"], list(at))
    return q.select("year", *[F.round(F.col("q")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(at)])


@query("a10_weighted_mean", f"WITH {DIRTY_SQL} SELECT year, round(sum(x_m*y)/sum(CASE WHEN x_m IS NOT NULL THEN y END),6) AS wm FROM dirty GROUP BY year")
def a10(spark, d):
    w = F.when(F.col("x_m").isNotNull(), F.col("y"))
    return dirtied(panel(spark, d)).groupBy("year").agg(F.round(F.sum(F.col("x_m") * w) / F.sum(w), 6).alias("wm"))


@query("a11_moment_table", f"WITH {PANEL_SQL}, z AS (SELECT region, y, avg(y) OVER (PARTITION BY region) AS m, var_pop(y) OVER (PARTITION BY region) AS v FROM panel) SELECT region, {_N} AS n, round(avg(y),1) AS mean_y, round(stddev_samp(y),4) AS sd_y, round(stddev_samp(y)/avg(y),8) AS cv, round(avg(((y-m)/sqrt(v))**3)*sqrt(count(*)*(count(*)-1.0))/(count(*)-2),6) AS skew, round(avg(((y-m)/sqrt(v))**4),6) AS kurt FROM z GROUP BY region")
def a11(spark, d):
    """Skewness with the small-sample correction, kurtosis as the plain fourth moment."""
    n = F.count(F.lit(1))
    return panel(spark, d).groupBy("region").agg(
        n.alias("n"),
        F.round(F.avg("y"), 1).alias("mean_y"),
        F.round(F.stddev_samp("y"), 4).alias("sd_y"),
        F.round(F.stddev_samp("y") / F.avg("y"), 8).alias("cv"),
        F.round(F.skewness("y") * F.sqrt(n * (n - F.lit(1.0))) / F.nullif(n - 2, F.lit(0)), 6).alias("skew"),
        F.round(F.kurtosis("y") + 3, 6).alias("kurt"),
    )


@query("a12_correlations", f"WITH {PANEL_SQL} SELECT year, round(corr(y,x_l),8) AS c_l, round(corr(y,x_m),8) AS c_m, round(corr(ln(y),ln(x_k)),8) AS c_lnk FROM panel GROUP BY year")
def a12(spark, d):
    return panel(spark, d).groupBy("year").agg(F.round(F.corr("y", "x_l"), 8).alias("c_l"), F.round(F.corr("y", "x_m"), 8).alias("c_m"), F.round(F.corr(F.ln("y"), F.ln("x_k")), 8).alias("c_lnk"))


@query("a13_geometric_mean", f"WITH {PANEL_SQL} SELECT year, round(exp(avg(ln(x_k))),6) AS gm FROM panel GROUP BY year")
def a13(spark, d):
    return panel(spark, d).groupBy("year").agg(F.round(F.exp(F.avg(log_positive("x_k"))), 6).alias("gm"))


@query("a14_ols_by_group", f"WITH {HOLES_SQL} SELECT sid, round(regr_slope(ln(y), year)*10,6) AS per_decade, round(regr_intercept(ln(y), year-1995),6) AS start FROM holes GROUP BY sid HAVING count(*) >= 10")
def a14(spark, d):
    rows = with_holes(panel(spark, d)).groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(F.ln("y"), F.col("year")) * 10, 6).alias("per_decade"), F.round(F.regr_intercept(F.ln("y"), F.col("year") - 1995), 6).alias("start")
    )
    return rows.where("n >= 10").drop("n")


@query("a15_value_counts", f"SELECT l_returnflag, l_linestatus, {_N} AS n FROM lineitem GROUP BY 1,2")
def a15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("a16_shares", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END),8) AS share FROM lineitem GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 8).alias("share"))


_BAND = "CASE WHEN bad = 0 THEN '0' WHEN bad = 1 THEN '1' WHEN bad <= 3 THEN '2-3' ELSE '4+' END"


@query("a17_concentration", f"WITH {DIRTY_SQL}, c AS (SELECT unit, sum(CAST(x_m IS NULL AS INT)+CAST(x_l = 0 AS INT)+CAST(x_s < 1 AS INT)) AS bad FROM dirty GROUP BY unit) SELECT {_BAND} AS band, {_N} AS units, CAST(sum(bad) AS BIGINT) AS cells FROM c GROUP BY 1")
def a17(spark, d):
    bad = F.col("x_m").isNull().cast("int") + (F.col("x_l") == 0).cast("int") + (F.col("x_s") < 1).cast("int")
    units = dirtied(panel(spark, d)).groupBy("unit").agg(F.sum(bad).alias("bad"))
    band = F.when(F.col("bad") == 0, "0").when(F.col("bad") == 1, "1").when(F.col("bad") <= 3, "2-3").otherwise("4+")
    return units.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("units"), F.sum("bad").alias("cells"))


@query("a18_two_stage_mean", f"WITH {HOLES_SQL} SELECT sid, round(avg(m),1) AS mean_of_means FROM (SELECT sid, unit, avg(y) AS m FROM holes GROUP BY 1,2) GROUP BY sid")
def a18(spark, d):
    return with_holes(panel(spark, d)).groupBy("sid", "unit").agg(F.avg("y").alias("m")).groupBy("sid").agg(F.round(F.avg("m"), 1).alias("mean_of_means"))


@query("a19_pivot", f"WITH {PANEL_SQL} SELECT region, round(sum(CASE WHEN year=1996 THEN y END),4) AS y1996, round(sum(CASE WHEN year=1998 THEN y END),4) AS y1998, round(sum(CASE WHEN year=2000 THEN y END),4) AS y2000 FROM panel GROUP BY region")
def a19(spark, d):
    wide = panel(spark, d).groupBy("region").pivot("year", [1996, 1998, 2000]).agg(F.round(F.sum("y"), 4))
    return wide.withColumnsRenamed({str(k): f"y{k}" for k in (1996, 1998, 2000)})


@query("a20_drift", f"WITH {PANEL_SQL}, m AS (SELECT year, median(x_k/nullif(x_l,0)) AS r FROM panel GROUP BY year) SELECT round(arg_max(r,year)/arg_min(r,year),8) AS end_start, round(max(r)/min(r),8) AS max_min, CAST(arg_min(year,r) AS INT) AS low_year, CAST(arg_max(year,r) AS INT) AS high_year FROM m")
def a20(spark, d):
    m = panel(spark, d).groupBy("year").agg(F.median(ratio("x_k", "x_l")).alias("r"))
    return m.agg(F.round(F.max_by("r", "year") / F.min_by("r", "year"), 8).alias("end_start"), F.round(F.max("r") / F.min("r"), 8).alias("max_min"), F.min_by("year", "r").alias("low_year"), F.max_by("year", "r").alias("high_year"))


@query("a21_panel_structure", f"WITH {HOLES_SQL} SELECT CAST(count(DISTINCT unit) AS BIGINT) AS units, CAST(count(DISTINCT year) AS BIGINT) AS years, {_N} AS n, round(100.0*count(*)/(count(DISTINCT unit)*count(DISTINCT year)),6) AS balance FROM holes")
def a21(spark, d):
    u, t, n = F.count_distinct("unit"), F.count_distinct("year"), F.count(F.lit(1))
    return with_holes(panel(spark, d)).agg(u.alias("units"), t.alias("years"), n.alias("n"), F.round(F.lit(100.0) * n / (u * t), 6).alias("balance"))


_TOTALS = ", ".join(f"sum({v}) AS {v}" for v in VARS)


@query("a22_national_accounts", f"WITH {PANEL_SQL}, t AS (SELECT year, {_TOTALS}, sum(y/(1+0.03*(year-1995)+sid/1000.0)) AS ry FROM panel GROUP BY year), l AS (SELECT year, ln(y)-0.20*ln(x_l)-0.25*ln(x_s)-0.15*ln(x_k)-0.40*ln(x_m) AS a, ln(y/ry) AS p FROM t) SELECT year, round(a-lag(a) OVER (ORDER BY year),8) AS d_tfp, round(p-lag(p) OVER (ORDER BY year),8) AS d_price FROM l")
def a22(spark, d):
    t = panel(spark, d).groupBy("year").agg(*[F.sum(v).alias(v) for v in VARS], F.sum(F.col("y") / deflator()).alias("ry"))
    w = Window.orderBy("year")  # a row per year
    a, p = I.solow(), F.ln(F.col("y") / F.col("ry"))
    return t.select("year", F.round(a - F.lag(a).over(w), 8).alias("d_tfp"), F.round(p - F.lag(p).over(w), 8).alias("d_price"))


_STATE = "CASE WHEN v IS NULL THEN 'missing' WHEN v = 0 THEN 'zero' WHEN v < 1 THEN 'under one' ELSE 'ok' END"
_LONG = " UNION ALL ".join(f"SELECT unit, year, '{v}' AS var, {v} AS v FROM dirty" for v in VARS)


@query("a23_footprint", f"WITH {DIRTY_SQL}, l AS ({_LONG}) SELECT var, {_STATE} AS state, {_N} AS cells, CAST(count(DISTINCT unit) AS BIGINT) AS units FROM l GROUP BY 1, 2")
def a23(spark, d):
    long = dirtied(panel(spark, d)).unpivot(["unit", "year"], list(VARS), "var", "v")
    state = F.when(F.col("v").isNull(), "missing").when(F.col("v") == 0, "zero").when(F.col("v") < 1, "under one").otherwise("ok")
    return long.groupBy("var", state.alias("state")).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("unit").alias("units"))


@query("a24_row_wise", f"WITH {DIRTY_SQL} SELECT unit, year, CASE WHEN x_l IS NULL AND x_m IS NULL THEN NULL ELSE round(coalesce(x_l,0)+coalesce(x_m,0),6) END AS s, (coalesce(x_l=0,false) OR coalesce(x_s<1,false) OR coalesce(x_m<1,false)) AS any_bad, (x_l IS NOT NULL AND x_s IS NOT NULL AND x_m IS NOT NULL) AS all_there FROM dirty")
def a24(spark, d):
    bad = [F.coalesce(t, F.lit(False)) for t in (F.col("x_l") == 0, F.col("x_s") < 1, F.col("x_m") < 1)]
    there = [F.col(v).isNotNull() for v in ("x_l", "x_s", "x_m")]
    return dirtied(panel(spark, d)).select("unit", "year", F.round(I.named_sum("x_l", "x_m"), 6).alias("s"), reduce(lambda a, b: a | b, bad).alias("any_bad"), reduce(lambda a, b: a & b, there).alias("all_there"))


@query("t01_multi_key_sort", f"WITH {HOLES_SQL} SELECT sid, unit, year, CAST(row_number() OVER (ORDER BY sid, unit, year) AS BIGINT) AS place FROM holes")
def t01(spark, d):
    """Places in a global order: each leading key's rows are sorted apart, after the counts before them."""
    rows = with_holes(panel(spark, d)).select("sid", "unit", "year")
    counts = rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("sid", (F.sum("n").over(Window.orderBy("sid")) - F.col("n")).alias("before"))  # a row per sid
    own = F.row_number().over(Window.partitionBy("sid").orderBy("unit", "year"))
    return rows.join(before, "sid").select("sid", "unit", "year", (own + F.col("before")).alias("place"))


@query("t02_custom_order", f"SELECT o_orderpriority, {_N} AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 99 END AS place FROM orders GROUP BY 1")
def t02(spark, d):
    order = {"5-LOW": 1, "4-NOT SPECIFIED": 2, "1-URGENT": 3}
    place = F.create_map(*[x for kv in order.items() for x in map(F.lit, kv)])
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.coalesce(F.try_element_at(place, F.col("o_orderpriority")), F.lit(99))).orderBy("place", "o_orderpriority")


@query("t03_top_by_abs", f"WITH {HOLES_SQL}, g AS (SELECT unit, year, y - lag(y) OVER w AS dy, year - lag(year) OVER w AS gap FROM holes WINDOW w AS (PARTITION BY unit ORDER BY year)) SELECT unit, year, round(dy,6) AS dy FROM g WHERE gap = 1 ORDER BY abs(dy) DESC, unit, year LIMIT 20")
def t03(spark, d):
    g = P.adjacent_change(with_holes(panel(spark, d)), "y", name="dy").select("unit", "year", "dy")
    return rounded(g.orderBy(F.desc(F.abs("dy")), "unit", "year").limit(20), 6)


@query("t04_argmax_argmin", f"WITH {PANEL_SQL} SELECT unit, CAST(arg_max(year, y) AS INT) AS best_year, CAST(arg_min(year, y) AS INT) AS worst_year FROM panel GROUP BY unit")
def t04(spark, d):
    return panel(spark, d).groupBy("unit").agg(F.max_by("year", "y").alias("best_year"), F.min_by("year", "y").alias("worst_year"))


@query("t05_head_and_tail", f"WITH {PANEL_SQL}, m AS (SELECT unit, avg(y) AS m FROM panel GROUP BY unit) SELECT 'head' AS part, unit, round(m,1) AS m FROM (SELECT * FROM m ORDER BY m DESC, unit LIMIT 5) UNION ALL SELECT 'tail', unit, round(m,1) FROM (SELECT * FROM m ORDER BY m, unit LIMIT 5)")
def t05(spark, d):
    m = panel(spark, d).groupBy("unit").agg(F.avg("y").alias("m"))
    head, tail = m.orderBy(F.desc("m"), "unit").limit(5), m.orderBy("m", "unit").limit(5)
    return rounded(head.select(F.lit("head").alias("part"), "unit", "m").unionByName(tail.select(F.lit("tail").alias("part"), "unit", "m")), 1)


@query("t06_decile_comparison", f"WITH {PANEL_SQL}, q AS (SELECT year, quantile_cont(y,0.9) AS hi, quantile_cont(y,0.1) AS lo FROM panel GROUP BY year) SELECT panel.year AS year, round(avg(CASE WHEN y >= hi THEN x_m/y END),8) AS top, round(avg(CASE WHEN y <= lo THEN x_m/y END),8) AS bottom FROM panel JOIN q ON panel.year = q.year GROUP BY panel.year")
def t06(spark, d):
    rows = panel(spark, d)
    q = spread.quantiles(rows, "y", ["year"], [0.1, 0.9])
    r = ratio("x_m", "y")
    return rows.join(q, "year").groupBy("year").agg(F.round(F.avg(F.when(F.col("y") >= F.col("q")[1], r)), 8).alias("top"), F.round(F.avg(F.when(F.col("y") <= F.col("q")[0], r)), 8).alias("bottom"))


@query("u01_ragged_union", f"WITH {PANEL_SQL} SELECT unit, year, y, NULL::DOUBLE AS x_l FROM panel WHERE year=1996 UNION ALL SELECT unit, year, NULL, x_l FROM panel WHERE year=1997")
def u01(spark, d):
    rows = panel(spark, d)
    return rows.where("year = 1996").select("unit", "year", "y").unionByName(rows.where("year = 1997").select("unit", "year", "x_l"), allowMissingColumns=True)


@query("u02_intersect_except", f"WITH {HOLES_SQL}, a AS (SELECT unit FROM holes WHERE year=1996), b AS (SELECT unit FROM holes WHERE year=1997) SELECT 'both' AS part, unit FROM (SELECT unit FROM a INTERSECT SELECT unit FROM b) UNION ALL SELECT 'gone', unit FROM (SELECT unit FROM a EXCEPT SELECT unit FROM b)")
def u02(spark, d):
    rows = with_holes(panel(spark, d))
    a, b = rows.where("year = 1996").select("unit"), rows.where("year = 1997").select("unit")
    name = lambda df, x: df.select(F.lit(x).alias("part"), "unit")
    return name(a.intersect(b), "both").union(name(a.subtract(b), "gone"))


@query("u03_distinct_keys", "SELECT DISTINCT l_suppkey, CAST(year(l_shipdate) AS INT) AS year FROM lineitem")
def u03(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year")).distinct()


@query("u04_progressive_outer_merge", f"WITH {PANEL_SQL}, a AS (SELECT year, round(avg(y),1) AS a FROM panel WHERE year<1999 GROUP BY year), b AS (SELECT year, round(avg(x_l),1) AS b FROM panel WHERE year>1996 GROUP BY year), c AS (SELECT year, round(avg(x_m),1) AS c FROM panel WHERE year%2=0 GROUP BY year) SELECT CAST(coalesce(a.year,b.year,c.year) AS INT) AS year, a, b, c FROM a FULL JOIN b ON a.year=b.year FULL JOIN c ON c.year=coalesce(a.year,b.year)")
def u04(spark, d):
    rows = panel(spark, d)
    parts = [rows.where(t).groupBy("year").agg(F.round(F.avg(v), 1).alias(n)) for t, v, n in (("year < 1999", "y", "a"), ("year > 1996", "x_l", "b"), ("year % 2 = 0", "x_m", "c"))]
    return reduce(lambda x, y: x.join(y, "year", "full"), parts)


@query("x01_string_functions", "SELECT p_partkey, trim(p_type) AS trimmed, (contains(p_type,'STEEL') OR contains(p_type,'COPPER')) AS has_any, regexp_replace(p_type, '(STEEL|TIN)$', '') AS stem, substr(p_name,1,2) AS pre, lower(p_brand) AS low, regexp_matches(replace(p_brand,'Brand#',''), '^[0-9]+$') AS digits FROM part")
def x01(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.trim(t).alias("trimmed"), (t.contains("STEEL") | t.contains("COPPER")).alias("has_any"), F.regexp_replace(t, "(STEEL|TIN)$", "").alias("stem"),
        F.substring("p_name", 1, 2).alias("pre"), F.lower("p_brand").alias("low"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).rlike("^[0-9]+$").alias("digits"),
    )


@query("x03_date_functions", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, CAST(month(o_orderdate) AS INT) AS m, CAST((month(o_orderdate)-1)*2 + CAST(day(o_orderdate)>15 AS INT) AS INT) AS hm, (year(o_orderdate)%4=0 AND (year(o_orderdate)%100<>0 OR year(o_orderdate)%400=0)) AS leap FROM orders")
def x03(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"), F.month("o_orderdate").alias("m"), half_month("o_orderdate").alias("hm"), ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).alias("leap")
    )


@query("x04_math_functions", "SELECT c_custkey, round(log10(abs(c_acctbal)+1),8) AS lg, round(exp(c_acctbal/10000),8) AS e, round(expm1_,8) AS em1, round(sqrt(abs(c_acctbal)),8) AS sq, CAST(sign(c_acctbal) AS DOUBLE) AS sg, round(asin(c_acctbal/20000),8) AS asn, round(cos(radians(c_acctbal/100)),8) AS cs, CAST(floor(c_acctbal/7) AS BIGINT) AS fl FROM (SELECT *, exp(c_acctbal/100000)-1 AS expm1_ FROM customer)")
def x04(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.round(F.log10(F.abs(b) + 1), 8).alias("lg"), F.round(F.exp(b / 10000), 8).alias("e"), F.round(F.expm1(b / 100000), 8).alias("em1"), F.round(F.sqrt(F.abs(b)), 8).alias("sq"),
        F.signum(b).alias("sg"), F.round(F.asin(b / 20000), 8).alias("asn"), F.round(F.cos(F.radians(b / 100)), 8).alias("cs"), F.floor(b / 7).cast("long").alias("fl"),
    )


@query("x05_grid_interpolation", f"WITH {PANEL_SQL}, pts AS (SELECT CAST(year AS DOUBLE) AS x, avg(y) AS v FROM panel GROUP BY year), seg AS (SELECT x AS x0, v AS v0, lead(x) OVER (ORDER BY x) AS x1, lead(v) OVER (ORDER BY x) AS v1 FROM pts), ends AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(v,x) AS vlo, arg_max(v,x) AS vhi FROM pts), grid AS (SELECT 1994.5 + k*0.25 AS g FROM (SELECT unnest(range(0,32)) AS k)) SELECT CAST(g AS DOUBLE) AS g, round(CASE WHEN g<=lo THEN vlo WHEN g>=hi THEN vhi ELSE v0+(v1-v0)*(g-x0)/(x1-x0) END,1) AS v FROM grid CROSS JOIN ends LEFT JOIN seg ON g>=x0 AND g<x1")
def x05(spark, d):
    """Linear interpolation on an even grid, the end values held outside."""
    pts = panel(spark, d).groupBy(F.col("year").cast("double").alias("x")).agg(F.avg("y").alias("v")).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("p"))
    rows = pts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: 1994.5 + k * 0.25)).alias("g"), "p")
    below = F.try_element_at(F.filter("p", lambda s: s["x"] <= F.col("g")), F.lit(-1))
    above = F.try_element_at(F.filter("p", lambda s: s["x"] > F.col("g")), F.lit(1))
    line = below["v"] + (above["v"] - below["v"]) * (F.col("g") - below["x"]) / (above["x"] - below["x"])
    return rows.select("g", F.round(F.coalesce(line, above["v"], below["v"]), 1).alias("v"))


@query("x06_circular_months", "SELECT o_orderkey, CAST((((month(o_orderdate)-1-2)%12)+12)%12+1 AS INT) AS two_before, CAST((month(o_orderdate)-1+2)%12+1 AS INT) AS two_after FROM orders")
def x06(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", circular_month(m, -2).cast("int").alias("two_before"), circular_month(m, 2).cast("int").alias("two_after"))


@query("x08_significant_digits", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE round(c_acctbal * pow(10.0, 2 - floor(log10(abs(c_acctbal)))), 0) / pow(10.0, 2 - floor(log10(abs(c_acctbal)))) END AS s3 FROM customer")
def x08(spark, d):
    return table(spark, d, "customer").select("c_custkey", significant("c_acctbal", 3).alias("s3"))


@query("s18_dense_json", f"WITH {HOLES_SQL}, g AS (SELECT i.unit AS unit, t.year AS year, y FROM (SELECT DISTINCT unit FROM holes) i CROSS JOIN (SELECT DISTINCT year FROM holes) t LEFT JOIN holes h ON h.unit=i.unit AND h.year=t.year) SELECT unit, '[' || string_agg(coalesce(CAST(CAST(round(y,0) AS BIGINT) AS VARCHAR),'null'), ',' ORDER BY year) || ']' AS payload FROM g GROUP BY unit")
def s18(spark, d):
    """One flat array per unit over the years, missing years null."""
    cell = F.struct("year", F.coalesce(F.round("y", 0).cast("long").cast("string"), F.lit("null")).alias("v"))
    rows = j11(spark, d).groupBy("unit").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("unit", F.concat(F.lit("["), F.array_join(F.col("cells.v"), ","), F.lit("]")).alias("payload"))


@query("s18b_json_payload", f"WITH {HOLES_SQL}, g AS (SELECT i.unit AS unit, t.year AS year, y FROM (SELECT DISTINCT unit FROM holes) i CROSS JOIN (SELECT DISTINCT year FROM holes) t LEFT JOIN holes h ON h.unit=i.unit AND h.year=t.year) SELECT unit, year, CASE WHEN y IS NOT NULL THEN round(y*pow(10.0, 5-floor(log10(abs(y)))),0)/pow(10.0, 5-floor(log10(abs(y)))) END AS y FROM g")
def s18b(spark, d):
    """A unit's years and values, to six digits, as one JSON object; read again, a row per year, missing ones null."""
    sent = payloads(j11(spark, d), "unit", "year", {"y": "y"})
    back = sent.select(F.from_json("payload", "id int, years array<int>, vars array<struct<label string, z array<double>>>").alias("p"))
    return back.select(F.col("p.id").alias("unit"), F.explode(F.arrays_zip("p.years", F.col("p.vars")[0]["z"].alias("z"))).alias("c")).select("unit", F.col("c.years").alias("year"), F.col("c.z").alias("y"))


def payloads(dense, key: str, time: str, variables: dict[str, str], digits: int = 6):
    """key and ``payload``: {id, years, vars: [{label, z}]}, arrays in the order of time, values to so many digits."""
    cells = F.array_sort(F.collect_list(F.struct(time, *[significant(c, digits).alias(c) for c in variables])))
    held = dense.groupBy(key).agg(cells.alias("c"))
    shown = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"c.{c}").alias("z")) for c, label in variables.items()])
    one = F.struct(F.col(key).alias("id"), F.col(f"c.{time}").alias("years"), shown.alias("vars"))
    return held.select(key, F.to_json(one, {"ignoreNullFields": "false"}).alias("payload"))


@query("s10_dissolve_first", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS name, CAST(count(*) AS BIGINT) AS parts FROM customer GROUP BY c_nationkey")
def s10(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("name"), F.count(F.lit(1)).alias("parts"))
