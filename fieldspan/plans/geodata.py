"""Polygons, rasters and their files. Zones are suppliers' star-shaped polygons, some with a hole; cells hold sums of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldspan.functions.expr import half_month
from fieldspan.operators import geometry as G, weather as W
from fieldspan.plans.registry import query, rounded
from fieldspan.sources.arrays import extend_arrays, read_arrays, write_arrays
from fieldspan.sources.netcdf import read_netcdf, write_netcdf
from fieldspan.sources.rasters import read_rasters, write_rasters
from fieldspan.sources.shapes import read_shapes, write_shapes
from fieldspan.sources.stata import read_stata, write_stata
from fieldspan.sources.tables import HOLES_SQL, PANEL_SQL, hundredths, panel, stage_path, table, with_holes

#: Twelve directions, clockwise, each of length one.
DIRECTIONS = [(1.0, 0.0), (0.8, -0.6), (0.6, -0.8), (0.0, -1.0), (-0.6, -0.8), (-0.8, -0.6), (-1.0, 0.0), (-0.8, 0.6), (-0.6, 0.8), (0.0, 1.0), (0.6, 0.8), (0.8, 0.6)]
CELL = 0.5


def _corner(k: int, scale: str) -> str:
    far = f"({scale})*(0.6+(s_suppkey%5)*0.3)*(0.7+((s_suppkey*7+{k * 3})%4)*0.15)"
    x, y = DIRECTIONS[k]
    return f"((s_suppkey%37)*1.7+5.03+s_acctbal/10000)+{far}*({x})", f"((s_suppkey%23)*1.3+4.11)+{far}*({y})"


def zones(spark, d) -> DataFrame:
    """code and rings of each supplier's polygon; every third has a hole."""
    dx, dy = (", ".join(f"{p[i]}D" for p in DIRECTIONS) for i in (0, 1))
    far = "0.6D+(s_suppkey%5)*0.3D"
    corner = "named_struct('x', cx+scale*({0})*(0.7D+((s_suppkey*7+k*3)%4)*0.15D)*dx[k], 'y', cy+scale*({0})*(0.7D+((s_suppkey*7+k*3)%4)*0.15D)*dy[k])".format(far)
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "(s_suppkey%37)*1.7D+5.03D+s_acctbal/10000 AS cx", "(s_suppkey%23)*1.3D+4.11D AS cy", f"array({dx}) AS dx", f"array({dy}) AS dy")
    ring = lambda scale, order: f"transform({order}, k -> {corner.replace('scale', scale)})"
    whole, hole = ring("1.0D", "sequence(0, 11)"), ring("0.3D", "sequence(11, 0, -1)")
    return rows.selectExpr("CAST(s_suppkey AS INT) AS code", f"CASE WHEN s_suppkey%3=0 THEN array({whole}, {hole}) ELSE array({whole}) END AS rings")


def _edges_sql() -> str:
    rows = []
    for scale, order, where in (("1.0", list(range(12)), ""), ("0.3", list(range(11, -1, -1)), " WHERE s_suppkey%3=0")):
        points = ["{{'x':{},'y':{}}}".format(*_corner(k, scale)) for k in order]
        rows.append(f"SELECT CAST(s_suppkey AS INT) AS code, [{','.join(points)}] AS ring FROM supplier{where}")
    return f"""rings AS ({' UNION ALL '.join(rows)}),
 nth AS (SELECT code, ring, unnest(range(1,13)) AS i FROM rings),
 edge AS (SELECT code, ring[i].x AS x0, ring[i].y AS y0, ring[i%12+1].x AS x1, ring[i%12+1].y AS y1 FROM nth)"""


#: Another way to the same shares: the height of each edge clamped to a cell, integrated in closed form.
COVER_SQL = _edges_sql() + f""",
 box AS (SELECT code, CAST(floor(min(x0)/{CELL}) AS BIGINT) AS a, CAST(floor(max(x0)/{CELL}) AS BIGINT) AS b, CAST(floor(min(y0)/{CELL}) AS BIGINT) AS c, CAST(floor(max(y0)/{CELL}) AS BIGINT) AS e FROM edge GROUP BY code),
 rowed AS (SELECT code, a, b, unnest(range(c,e+1)) AS r FROM box), grid AS (SELECT code, r, unnest(range(a,b+1)) AS q FROM rowed),
 cut AS (SELECT g.code AS code, q, r, CASE WHEN x1>x0 THEN 1 ELSE -1 END AS way, r*{CELL} AS lo, (r+1)*{CELL} AS hi, (y1-y0)/(x1-x0) AS m,
   greatest(least(x0,x1), q*{CELL}) AS l, least(greatest(x0,x1), (q+1)*{CELL}) AS h, x0, y0 FROM grid g JOIN edge ON edge.code=g.code WHERE x0<>x1 AND least(x0,x1) < (q+1)*{CELL} AND greatest(x0,x1) > q*{CELL}),
 ends AS (SELECT *, y0+(l-x0)*m AS yl, y0+(h-x0)*m AS yh FROM cut),
 under AS (SELECT code, q, r, way*CASE WHEN abs(m) < 1e-9 THEN (least(greatest((yl+yh)/2,lo),hi)-lo)*(h-l) ELSE
   ((CASE WHEN yh<lo THEN lo*yh WHEN yh<=hi THEN yh*yh/2+lo*lo/2 ELSE hi*yh-hi*hi/2+lo*lo/2 END) - (CASE WHEN yl<lo THEN lo*yl WHEN yl<=hi THEN yl*yl/2+lo*lo/2 ELSE hi*yl-hi*hi/2+lo*lo/2 END))/m - lo*(h-l) END AS part FROM ends),
 cover AS (SELECT code, q AS col, r AS row, sum(part)/({CELL}*{CELL}) AS share FROM under GROUP BY 1,2,3 HAVING abs(sum(part)) > 1e-9)"""


def cover(spark, d) -> DataFrame:
    return G.cover(G.edges(zones(spark, d), ["code"]), ["code"], CELL)


@query("j14b_cover_of_cells", f"WITH {COVER_SQL} SELECT code, col, row, round(share+1e-9,6) AS share FROM cover WHERE share > 5e-6")
def j14b(spark, d):
    """The share of each grid cell that each polygon covers."""
    return rounded(cover(spark, d).where("share > 5e-6").withColumn("share", F.col("share") + 1e-9), 6)


_CELLS = "cells AS (SELECT l_partkey%70*2+l_linenumber%2 AS col, l_orderkey%40*2+l_linenumber//2%2 AS row, CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/1e8 AS v, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1,2,3)"


def cells(spark, d) -> DataFrame:
    """col, row, year, v and w of grid cells; not all cells have every year."""
    li = table(spark, d, "lineitem")
    col, row = F.col("l_partkey") % 70 * 2 + F.col("l_linenumber") % 2, F.col("l_orderkey") % 40 * 2 + F.floor(F.col("l_linenumber") / 2) % 2
    return li.groupBy(col.alias("col"), row.alias("row"), F.year("l_shipdate").cast("int").alias("year")).agg((F.sum(hundredths("l_extendedprice")) / 1e8).alias("v"), F.count(F.lit(1)).cast("double").alias("w"))


@query("g16b_zonal_from_geometry", f"WITH {COVER_SQL}, {_CELLS} SELECT code, year, round(sum(share*v)/sum(share),5) AS mean, round(sum(share*w*v)/sum(share*w),5) AS weighted_mean, round(sum(share*v),4) AS total FROM cover JOIN cells ON cells.col=cover.col AND cells.row=cover.row GROUP BY code, year HAVING sum(share) > 1e-3")
def g16b(spark, d):
    """Means of cells over polygons by covered area, alone and times the cells' own weight, and sums."""
    return rounded(W.area_zonal(cells(spark, d), cover(spark, d), "v", "w", ["col", "row"], ["code", "year"]), 5, total=4)


@query("s10c_polygon_areas", f"WITH {_edges_sql()} SELECT code, round(sum((x1-x0)*(y0+y1)/2),6) AS area FROM edge GROUP BY code")
def s10c(spark, d):
    """Areas as the sums of the cells' shares; the SQL sums the edges' trapezia."""
    return rounded(cover(spark, d).groupBy("code").agg((F.sum("share") * CELL * CELL).alias("area")), 6)


@query("s10b_shapefile_dissolve", f"WITH {_edges_sql()}, a AS (SELECT code, sum((x1-x0)*(y0+y1)/2) AS area, count(*) AS n FROM edge GROUP BY code) SELECT code, s_name AS name, CAST(n AS BIGINT) AS n_edges, round(area,6) AS area FROM a JOIN supplier ON s_suppkey=code")
def s10b(spark, d):
    """Each polygon is stored as two halves with one code, in web map metres; read back, moved to degrees, and dissolved.

    The cut is an edge of both halves, once each way, and goes; holes lie on both sides of it, so they stay with the first half.
    """
    path = stage_path(spark, "shapes")
    whole = zones(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("code"), F.col("s_name").alias("name")), "code")
    halves = whole.selectExpr("code", "name", "explode(array(concat(array(slice(rings[0], 1, 7)), slice(rings, 2, 9)), array(concat(slice(rings[0], 7, 6), slice(rings[0], 1, 1))))) AS rings")
    web = lambda p: F.struct(*[c.alias(n) for c, n in zip(G.degrees_to_web(p["x"], p["y"]), ("x", "y"))])
    write_shapes(halves.withColumn("rings", F.transform("rings", lambda r: F.transform(r, web))), path)
    back = read_shapes(spark, path, 64 << 10)
    edge = G.reprojected(G.dissolved(G.edges(back, ["code"]), ["code"]))
    names = back.groupBy("code").agg(F.min("name").alias("name"))
    sums = edge.groupBy("code").agg(F.count(F.lit(1)).alias("n_edges"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2).alias("area"))
    return rounded(sums.join(names, "code").select(F.col("code").cast("int").alias("code"), "name", "n_edges", "area"), 6)


ROWS, COLS = 80, 140


@query("s07b_rasters_in_archives", f"WITH {_CELLS} SELECT CAST(year AS VARCHAR) AS archive, 'v.tif' AS member, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(10+0.5*(col+0.5),6) AS x, round(60-0.5*(row+0.5),6) AS y, v AS value FROM cells WHERE v >= 0.005 UNION ALL SELECT CAST(year AS VARCHAR), 'w.tif', CAST(row AS INT), CAST(col AS INT), round(10+0.5*(col+0.5),6), round(60-0.5*(row+0.5),6), w FROM cells")
def s07b(spark, d):
    """Two rasters a year in an archive a year, read back window by window; cells under a bound are stored as NoData."""
    path = stage_path(spark, "rasters")
    two = cells(spark, d).selectExpr("CAST(year AS STRING) AS archive", "CAST(row AS INT) AS row", "CAST(col AS INT) AS col", "stack(2, 'v.tif', CASE WHEN v >= 0.005 THEN v END, 'w.tif', w) AS (member, value)")
    write_rasters(two, path, ROWS, COLS, left=10.0, top=60.0, cell=0.5)
    back = read_rasters(spark, path, splits=2).where("value is not null and not failed")
    return rounded(back.select("archive", "member", "row", "col", "x", "y", "value"), 6, value=15)


@query("s06b_zones_by_windows", f"WITH {COVER_SQL}, {_CELLS} SELECT code, year, round(100*sum(share*CASE WHEN v > 0.02 THEN 1 ELSE 0 END)/sum(share),5) AS pct, round(sum(share),5) AS valid FROM cover JOIN cells ON cells.col=cover.col AND cells.row=cover.row GROUP BY code, year HAVING sum(share) > 1e-3")
def s06b(spark, d):
    """Shares of polygons' area on cells over a bound: windows of stored rasters meet the polygons' cells in a join."""
    path = stage_path(spark, "windows")
    write_rasters(cells(spark, d).selectExpr("CAST(year AS STRING) AS archive", "'v.tif' AS member", "row", "col", "v AS value"), path, ROWS, COLS, tile=32)
    back = read_rasters(spark, path).where("value is not null").selectExpr("CAST(archive AS INT) AS year", "CAST(row AS BIGINT) AS row", "CAST(col AS BIGINT) AS col", "CASE WHEN value > 0.02 THEN 100D ELSE 0D END AS v", "1D AS w")
    zonal = W.area_zonal(back, cover(spark, d), "v", "w", ["col", "row"], ["code", "year"])
    valid = back.join(cover(spark, d), ["col", "row"]).groupBy("code", "year").agg(F.sum("share").alias("valid"))
    return rounded(zonal.join(valid, ["code", "year"]).select("code", "year", F.col("mean").alias("pct"), "valid"), 5)


_DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS time, CAST(o_custkey%4 AS INT) AS row, CAST(o_orderkey%3 AS INT) AS col, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT)//count(*) AS v FROM orders GROUP BY 1,2,3)"


def daily(spark, d) -> DataFrame:
    """time, row, col and value (whole numbers) of cells by order date; many cells have no row on a day."""
    o = table(spark, d, "orders")
    rows = o.groupBy(F.col("o_orderdate").cast("date").alias("time"), (F.col("o_custkey") % 4).cast("int").alias("row"), (F.col("o_orderkey") % 3).cast("int").alias("col")).agg(F.sum(hundredths("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select("time", "row", "col", F.expr("cast(s div n as double)").alias("value"))


@query("s08b_netcdf_half_months", f"WITH {_DAILY}, y AS (SELECT row, col, year(time) AS year, CAST((month(time)-1)*2+CAST(day(time)>15 AS INT) AS INT) AS hm, sum(v)//count(*) AS v FROM daily GROUP BY 1,2,3,4) SELECT round(5-0.25*(row+0.5),6) AS lat, round(70+0.25*(col+0.5),6) AS lon, hm, CAST(sum(v) AS DOUBLE) AS total, count(*) AS years FROM y GROUP BY row, col, hm")
def s08b(spark, d):
    """Daily grids in a file a year, read back in slabs of a few days; means by half-month of each year, summed over years."""
    path = stage_path(spark, "netcdf")
    write_netcdf(daily(spark, d).withColumn("file", F.year("time").cast("string")), path, "price", 4, 3, left=70.0, top=5.0, cell=0.25)
    back = read_netcdf(spark, path, "price", 96 * 50).where("value is not null")
    years = back.groupBy("lat", "lon", F.year("time").alias("year"), half_month("time").alias("hm")).agg(F.expr("cast(sum(value) as bigint) div count(1)").alias("v"))
    out = years.groupBy("lat", "lon", "hm").agg(F.sum("v").cast("double").alias("total"), F.count(F.lit(1)).alias("years"))
    return out.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "hm", "total", "years")


@query("s01b_stata_base_panel", f"WITH {HOLES_SQL}, a AS (SELECT unit, year, y FROM holes WHERE unit%5<>0), b AS (SELECT unit, year, x_m, CASE WHEN year<>1998 THEN x_l END AS x_l FROM holes WHERE (unit+year)%4<>0) SELECT coalesce(a.unit,b.unit) AS unit, coalesce(a.year,b.year) AS year, round(y,4) AS y, round(x_l,4) AS x_l, s_name AS name FROM a FULL JOIN b ON a.unit=b.unit AND a.year=b.year JOIN supplier ON s_suppkey=coalesce(a.unit,b.unit)")
def s01b(spark, d):
    """Two accounts in Stata files, scanned with the columns that are needed, and joined in full."""
    rows = with_holes(panel(spark, d)).join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("unit"), F.col("s_name").alias("name")), "unit")
    one, two = stage_path(spark, "account"), stage_path(spark, "inputs")
    write_stata(rows.where("unit % 5 <> 0").select("unit", "year", "sid", "y", "name"), one)
    write_stata(rows.where("(unit + year) % 4 <> 0").select("unit", "year", "name", "x_m", F.when(F.col("year") != 1998, F.col("x_l")).alias("x_l")), two)
    a, b = read_stata(spark, one, ["unit", "year", "y", "name"], 2000), read_stata(spark, two, ["unit", "year", "x_l", "name"], 2000)
    both = a.withColumnRenamed("name", "n1").join(b.withColumnRenamed("name", "n2"), ["unit", "year"], "full")
    return rounded(both.select("unit", "year", "y", "x_l", F.coalesce("n1", "n2").alias("name")), 4)


@query("s15b_stata_sink", f"WITH {PANEL_SQL} SELECT unit, year, sid, round(y,4) AS y, CASE WHEN year%2=0 THEN round(x_k,4) END AS x_k FROM panel")
def s15b(spark, d):
    """The panel as Stata files, with the same values and missing ones when read again."""
    path = stage_path(spark, "stata")
    write_stata(panel(spark, d).select("unit", "year", "sid", "y", F.when(F.col("year") % 2 == 0, F.col("x_k")).alias("x_k")), path)
    return rounded(read_stata(spark, path), 4)


_QUARTERLY = "quarterly AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS file, CAST(quarter(l_shipdate)-1 AS INT) AS layer, CAST(l_orderkey%40*2+l_linenumber//2%2 AS INT) AS row, CAST(l_partkey%70*2+l_linenumber%2 AS INT) AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1,2,3,4)"


@query("s16b_array_archives", f"WITH {_QUARTERLY} SELECT file, layer, row, col, value FROM quarterly WHERE row>=10 AND row<50 AND col>=20 AND col<100")
def s16b(spark, d):
    """Layers by quarter in an archive a year; later years are added to the folder; a window is read from the chunks that it meets."""
    li = table(spark, d, "lineitem")
    row, col = F.col("l_orderkey") % 40 * 2 + F.floor(F.col("l_linenumber") / 2) % 2, F.col("l_partkey") % 70 * 2 + F.col("l_linenumber") % 2
    rows = li.groupBy(F.year("l_shipdate").cast("string").alias("file"), (F.quarter("l_shipdate") - 1).alias("layer"), row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.sum("l_quantity").alias("value")).withColumn("name", F.lit("quantity"))
    path = stage_path(spark, "arrays")
    write_arrays(rows.where("file < '1998'"), path, 4, 32)
    extend_arrays(rows.withColumn("value", F.when(F.col("file") >= "1998", F.col("value")).otherwise(-1.0)), path, 4, 32)
    return read_arrays(spark, path, ["quantity"], (10, 50, 20, 100)).where("value is not null").drop("name")
