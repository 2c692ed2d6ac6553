"""Polygons over grids, and the sources and sinks of shapefiles and rasters."""

import io
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.operators import geometry as G
from fieldspan.sources import rasters as RA, shapes as SH, tables as S

RINGS = "array<array<struct<x:double,y:double>>>"


def polygons(spark, rows):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings] if rings is not None else None) for k, rings in rows], f"code int, rings {RINGS}")


def inside(x, y, rings):
    hit = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
    return hit


def test_cover_against_fine_sampling(spark):
    rng = random.Random(1)
    star = lambda cx, cy, r, n: [(cx + rng.uniform(0.4, 1) * r * math.sin(2 * math.pi * k / n), cy + rng.uniform(0.4, 1) * r * math.cos(2 * math.pi * k / n)) for k in range(n)]
    given = [
        (1, [star(3.3, 2.1, 2.5, 9)]), (2, [star(-4, -3.7, 3, 7), star(5, 5, 0.3, 5)]), (3, [[(0, 0), (0, 4), (4, 4), (4, 0)], [(1, 1), (3, 1), (3, 3), (1, 3)]]),
        (4, [[(0.2, 0.2), (0.3, 0.7), (0.6, 0.3)]]), (5, [[(0.5, 0.25), (0.5, 3.75), (9.5, 3.75), (9.5, 0.25)]]), (6, None), (7, []), (8, [[(1, 1), (2, 2)]]),
    ]
    edge = G.edges(polygons(spark, given), ["code"])
    got = {(r.code, r["col"], r["row"]): r.share for r in G.cover(edge, ["code"], 1.0).collect()}
    area = {r.code: r.area for r in G.areas(edge, ["code"]).collect()}
    assert set(area) == {1, 2, 3, 4, 5} == {k for k, _, _ in got} and area[3] == 12 and area[5] == 31.5
    n = 40
    for code, rings in given[:5]:
        own = {k[1:]: v for k, v in got.items() if k[0] == code}
        assert sum(own.values()) == pytest.approx(area[code], rel=1e-12) and max(own.values()) <= 1 + 1e-12 and min(own.values()) > 0
        for q in range(-8, 11):
            for r in range(-8, 8):
                sampled = sum(inside(q + (i + 0.503) / n, r + (j + 0.507) / n, rings) for i in range(n) for j in range(n)) / n**2
                assert own.get((q, r), 0.0) == pytest.approx(sampled, abs=0.03)
    # other cells and another origin
    moved = G.cover(edge, ["code"], 0.7, -3.1, 2.2).groupBy("code").agg((F.sum("share") * 0.49).alias("a")).collect()
    assert all(r.a == pytest.approx(area[r.code], rel=1e-9) for r in moved)


def test_dissolving_and_reprojection(spark):
    squares = [(1, [[(0, 0), (0, 1), (1, 1), (1, 0)]]), (1, [[(1, 0), (1, 1), (2, 1), (2, 0)]]), (1, [[(0, 1), (0, 2), (1, 2), (1, 1)]]), (2, [[(1, 0), (1, 1), (2, 1), (2, 0)]])]
    edge = G.edges(polygons(spark, squares), ["code"])
    out = G.dissolved(edge, ["code"])
    assert {r.code: r["count"] for r in out.groupBy("code").count().collect()} == {1: 8, 2: 4}
    assert {r.code: r.area for r in G.areas(out, ["code"]).collect()} == {1: 3.0, 2: 1.0}
    points = spark.createDataFrame([(x, y) for x in (-179.5, 0.0, 104.25) for y in (-60.0, 0.0, 31.5)], "x double, y double")
    web = G.degrees_to_web(F.col("x"), F.col("y"))
    back = points.select("x", "y", web[0].alias("a"), web[1].alias("b"))
    there = G.web_to_degrees(F.col("a"), F.col("b"))
    assert all(abs(r.x - r.lon) < 1e-9 and abs(r.y - r.lat) < 1e-9 for r in back.select("x", "y", there[0].alias("lon"), there[1].alias("lat")).collect())
    assert back.where("x = 104.25 and y = 31.5").first().a == pytest.approx(11605056.9, abs=1) and back.where("x = 104.25 and y = 31.5").first().b == pytest.approx(6378137 * math.atanh(math.sin(math.radians(31.5))), abs=1e-6)


def test_shapefiles(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(i, 10.0 ** (i % 20) / 3, None if i == 3 else f"Ñame {i}", None if i == 5 else [[{"x": i + 0.1, "y": 0.0}, {"x": i + 0.1, "y": 1.0}, {"x": i + 1.0, "y": 0.5}], [{"x": 0.3, "y": 0.3}, {"x": 0.4, "y": 0.3}, {"x": 0.4, "y": 0.5}]]) for i in range(700)]
    df = spark.createDataFrame(rows, f"code int, size double, name string, rings {RINGS}").repartition(3)
    SH.write_shapes(df, path)
    back = SH.read_shapes(spark, path, partition_bytes=20_000)
    assert back.schema.simpleString().startswith("struct<code:bigint,size:double,name:string,rings:") and back.rdd.getNumPartitions() > 5
    got = {r.code: r for r in back.collect()}
    assert len(got) == 700 and got[3].name is None and got[5].rings is None
    for i, size, name, rings in rows:
        assert (got[i].size, got[i].name) == (size, name)
        if rings is not None:
            assert [[(p.x, p.y) for p in r[:-1]] for r in got[i].rings] == [[(p["x"], p["y"]) for p in r] for r in rings] and all(r[0] == r[-1] for r in got[i].rings)
    (table,) = list((tmp_path / "s").glob("part-00000*.dbf"))
    raw = bytearray(table.read_bytes())
    n, before, width, _ = SH.attributes(io.BytesIO(raw))
    raw[before] = ord("*")
    table.write_bytes(raw)
    assert back.count() == 699
    with pytest.raises(Exception, match="more than ten bytes"):
        SH.write_shapes(df.withColumnRenamed("name", "a_long_name"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="254"):
        SH.write_shapes(df.withColumn("name", F.repeat(F.lit("x"), 300)), str(tmp_path / "u"))
    assert not list((tmp_path / "u").glob("*.shp"))
    SH.write_shapes(df.limit(0), str(tmp_path / "v"))
    assert (tmp_path / "v" / "_SUCCESS").exists()


def tiff(values, order="<", kind="<u2", strip=3, predictor=1, deflate=True, nodata=None):
    """A small TIFF in strips."""
    rows, cols = values.shape
    strips = []
    for a in range(0, rows, strip):
        v = values[a : a + strip].astype(kind)
        if predictor == 2:
            v = np.concatenate([v[:, :1], np.diff(v, axis=1)], 1).astype(kind)
        strips.append(zlib.compress(v.tobytes()) if deflate else v.tobytes())
    body, at = b"", []
    for s in strips:
        at.append(8 + len(body))
        body += s
    code = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    tags = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [np.dtype(kind).itemsize * 8]), (259, 3, [8 if deflate else 1]), (273, 4, at), (278, 4, [strip]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [code])]
    extra, entries = b"", []
    start = 8 + len(body)
    if nodata is not None:
        tags.append((42113, 2, nodata.encode() + b"\0"))
    for tag, t, v in tags:
        raw = v if t == 2 else struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
        count = len(v)
        if len(raw) > 4:
            entries.append(struct.pack(f"{order}HHII", tag, t, count, start + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack(f"{order}HHI", tag, t, count) + raw.ljust(4, b"\0"))
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, start + len(extra)) + body + extra + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0" * 4


@pytest.mark.parametrize("order,kind,predictor,deflate", [("<", "<u2", 2, True), (">", ">i4", 1, False), ("<", "<f4", 1, True), (">", ">u1", 2, True)])
def test_strips_of_other_writers(order, kind, predictor, deflate):
    values = (np.arange(77).reshape(11, 7) * 3) % 250
    file = io.BytesIO(tiff(values, order, kind, 4, predictor, deflate, "6"))
    own = RA.layout(file)
    whole = np.concatenate([RA.window(file, own, k)[2] for k in range(len(own.at))])
    assert own.rows == 11 and np.array_equal(np.isnan(whole), values == 6) and np.array_equal(np.nan_to_num(whole, nan=6), values)
    with pytest.raises(ValueError):
        RA.layout(io.BytesIO(file.getvalue()[:2] + b"\0\0" + file.getvalue()[4:]))


def test_rasters_by_windows_and_failed_ones(spark, tmp_path):
    path = tmp_path / "r"
    rng = np.random.default_rng(2)
    want = {(str(y), f"{m}.tif", r, c): (None if rng.random() < 0.1 else float(rng.normal())) for y in (1999, 2000) for m in "ab" for r in range(37) for c in range(50) if not (r < 16 and c < 16)}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], "archive string, member string, row int, col int, value double").repartition(3)
    RA.write_rasters(df, str(path), 37, 50, left=100.0, top=40.0, cell=0.1, tile=16)
    for how in ({}, {"splits": 5}, {"members": 1}):
        rows = RA.read_rasters(spark, str(path), **how).collect()
        assert len(rows) == 4 * 37 * 50 and not any(r.failed for r in rows)
        assert {(r.archive, r.member, r["row"], r["col"]): r.value for r in rows if r.value is not None} == {k: v for k, v in want.items() if v is not None}
        assert all(abs(r.x - (100.05 + 0.1 * r["col"])) < 1e-9 and abs(r.y - (39.95 - 0.1 * r["row"])) < 1e-9 for r in rows)
    # one tile of one year is damaged
    with zipfile.ZipFile(path / "2000.zip") as z:
        members = {n: bytearray(z.read(n)) for n in z.namelist()}
    own = RA.layout(io.BytesIO(members["b.tif"]))
    members["b.tif"][own.at[5] : own.at[5] + 20] = b"\xff" * 20
    members["c.tif"] = bytearray(b"no raster")
    with zipfile.ZipFile(path / "2000.zip", "w") as z:
        for n, raw in members.items():
            z.writestr(n, bytes(raw))
    rows = RA.read_rasters(spark, str(path), splits=2).collect()
    lost = [r for r in rows if r.failed]
    assert {(r.archive, r.member, r.window) for r in lost} == {("2000", "b.tif", 5), ("2000", "c.tif", None)} and all(r.value is None for r in lost) and len(lost) == 257
    assert {(r.archive, r.member, r["row"], r["col"]): r.value for r in rows if r.value is not None} == {k: v for k, v in want.items() if v is not None and not (k[:2] == ("2000", "b.tif") and 16 <= k[2] < 32 and 16 <= k[3] < 32)}
    back = RA.read_rasters(spark, str(path))
    out = str(tmp_path / "years")
    assert [y for y in ("1999", "2000") if S.write_complete(back.where(F.col("archive") == y), f"{out}/{y}", F.col("failed"))] == ["1999"]
