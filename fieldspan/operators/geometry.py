"""Polygons as tables of directed edges: areas, dissolving, reprojection, and exact shares of grid cells.

Rings are closed lists of points, outer rings clockwise and holes counter-clockwise, as shapefiles have
them. All sums are over edges, so a polygon of any size is spread over tasks, and holes and parts need
no case of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EARTH = 6378137.0  #: radius of the sphere of web maps, in metres
_TINY = 1e-12


def edges(polygons: DataFrame, key: list[str], rings: str = "rings") -> DataFrame:
    """key, x0, y0, x1, y1 of every edge; an open ring is closed, null rings and points of no length give none."""
    ring = polygons.select(*key, F.explode(rings).alias("_ring")).where(F.size("_ring") > 2)
    nth = F.posexplode("_ring").alias("_i", "_a")
    pair = ring.select(*key, "_ring", nth).withColumn("_b", F.element_at("_ring", F.when(F.col("_i") + 1 < F.size("_ring"), F.col("_i") + 2).otherwise(1)))
    out = pair.select(*key, F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1"))
    return out.where("x0 <> x1 or y0 <> y1")


def areas(edge: DataFrame, key: list[str]) -> DataFrame:
    """key and area, by the sum of the edges' trapezia."""
    return edge.groupBy(*key).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2).alias("area"))


def dissolved(edge: DataFrame, key: list[str]) -> DataFrame:
    """The edges of the union of each key's polygons: an edge that two of them share, once each way, goes.

    Neighbours must meet in the same points, as a map's borders do.
    """
    ahead = F.struct("x0", "y0") < F.struct("x1", "y1")
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("ax", "x0", "x1"), ("ay", "y0", "y1"), ("bx", "x1", "x0"), ("by", "y1", "y0"))]
    net = edge.select(*key, *ends, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy(*key, "ax", "ay", "bx", "by").agg(F.sum("way").alias("way"))
    left = net.where("way <> 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.abs("way").cast("int"))))
    turned = lambda a, b: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b))
    return left.select(*key, turned("ax", "bx").alias("x0"), turned("ay", "by").alias("y0"), turned("bx", "ax").alias("x1"), turned("by", "ay").alias("y1"))


def web_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of web map metres."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.pi() / 2)


def degrees_to_web(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * EARTH


def reprojected(edge: DataFrame) -> DataFrame:
    """Edges in degrees instead of web map metres."""
    first, second = web_to_degrees(F.col("x0"), F.col("y0")), web_to_degrees(F.col("x1"), F.col("y1"))
    return edge.withColumns({"x0": first[0], "y0": first[1], "x1": second[0], "y1": second[1]})


def cover(edge: DataFrame, key: list[str], cell: float, left: float = 0.0, bottom: float = 0.0) -> DataFrame:
    """key, col, row and share: how much of each grid cell the polygon covers, for all cells it touches.

    An edge is cut at the grid's lines. A piece inside a cell covers, by its height and sign, the part of
    the cell on its right, and all of the cells further right in the row; sums of these along a row
    are the shares. Cells between two that edges touch are wholly in or out. Rows of a polygon are
    apart from each other, so a large one is many groups, each of as many rows as edges cross it.
    """
    to = lambda c, origin: ((F.col(c) - origin) / cell).alias(c)
    up = F.col("y1") > F.col("y0")
    low, high = (lambda n: F.when(up, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))), (lambda n: F.when(up, F.col(f"{n}1")).otherwise(F.col(f"{n}0")))
    grid = edge.where("y0 <> y1").select(*key, to("x0", left), to("y0", bottom), to("x1", left), to("y1", bottom))
    grid = grid.select(*key, F.when(up, 1.0).otherwise(-1.0).alias("_way"), low("x").alias("_ua"), high("x").alias("_ub"), low("y").alias("_va"), high("y").alias("_vb"))
    grid = grid.withColumn("_slope", (F.col("_ub") - F.col("_ua")) / (F.col("_vb") - F.col("_va")))
    bands = grid.withColumn("row", F.explode(F.sequence(F.floor("_va"), F.greatest(F.ceil("_vb") - 1, F.floor("_va")))))
    bands = bands.withColumns({"_v0": F.greatest(F.col("_va"), F.col("row").cast("double")), "_v1": F.least(F.col("_vb"), F.col("row") + F.lit(1.0))}).where("_v1 > _v0")
    bands = bands.withColumns({f"_p{i}": F.col("_ua") + (F.col(f"_v{i}") - F.col("_va")) * F.col("_slope") for i in (0, 1)})
    bands = bands.select(*key, "row", "_way", (F.col("_v1") - F.col("_v0")).alias("_h"), F.least("_p0", "_p1").alias("_u0"), F.greatest("_p0", "_p1").alias("_u1"))
    cells = bands.withColumn("col", F.explode(F.sequence(F.floor("_u0"), F.greatest(F.ceil("_u1") - 1, F.floor("_u0")))))
    cells = cells.withColumns({"_a": F.greatest(F.col("_u0"), F.col("col").cast("double")), "_b": F.least(F.col("_u1"), F.col("col") + F.lit(1.0)), "_wide": F.col("_u1") > F.col("_u0")})
    cells = cells.where("not _wide or _b > _a").withColumn("_down", F.col("_way") * F.col("_h") * F.when(F.col("_wide"), (F.col("_b") - F.col("_a")) / (F.col("_u1") - F.col("_u0"))).otherwise(1.0))
    cells = cells.select(*key, "row", "col", "_down", (F.col("_down") * (F.col("col") + 1 - (F.col("_a") + F.col("_b")) / 2)).alias("_part"))
    touched = cells.groupBy(*key, "row", "col").agg(F.sum("_down").alias("_down"), F.sum("_part").alias("_part"))
    along = Window.partitionBy(*key, "row").orderBy("col")
    before = F.coalesce(F.sum("_down").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = touched.select(*key, "row", "col", (before + F.col("_part")).alias("_own"), (before + F.col("_down")).alias("_after"), F.lead("col").over(along).alias("_next"))
    one = F.array(F.struct(F.col("col").alias("col"), F.col("_own").alias("share")))
    between = F.transform(F.sequence(F.col("col") + 1, F.col("_next") - 1), lambda c: F.struct(c.alias("col"), F.col("_after").alias("share")))
    inside = (F.col("_next") > F.col("col") + 1) & (F.abs("_after") > _TINY)
    every = run.select(*key, "row", F.explode(F.when(inside, F.concat(one, between)).otherwise(one)).alias("_c"))
    return every.select(*key, F.col("_c.col").alias("col"), "row", F.col("_c.share").alias("share")).where(F.abs("share") > _TINY)
