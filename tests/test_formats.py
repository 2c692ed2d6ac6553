"""NetCDF, Stata and array archives: against files of other writers and readers, and round trips."""

import datetime as dt
import io
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspan.sources import arrays as A, netcdf as N, stata as ST


def classic(version=1, records=3, streamed=False):
    """A hand-made file: a scaled short with fill over (record time, y), a byte record variable, a fixed float (y, x)."""
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda text: struct.pack(">i", len(text)) + pad(text.encode())
    text = lambda k, v: name(k) + struct.pack(">i", 2) + name(v)
    short = lambda k, v: name(k) + struct.pack(">iih2x", 3, 1, v)
    double = lambda k, v: name(k) + struct.pack(">iid", 6, 1, v)
    begin = [0] * 4
    for _ in range(2):
        head = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streamed else records)
        head += struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("y") + struct.pack(">i", 3) + name("x") + struct.pack(">i", 2)
        head += struct.pack(">ii", 12, 1) + text("title", "hand made") + struct.pack(">ii", 11, 4)
        for k, (n, dims, attributes, kind, size) in enumerate([
            ("fixed", (1, 2), [], 5, 24), ("time", (0,), [text("units", "hours since 2001-03-01 06:00")], 4, 4),
            ("t2m", (0, 1), [short("_FillValue", -7), double("scale_factor", 0.5), double("add_offset", 100.0)], 3, 8), ("flag", (0,), [], 1, 4),
        ]):
            head += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + (struct.pack(">ii", 12, len(attributes)) + b"".join(attributes) if attributes else struct.pack(">ii", 0, 0))
            head += struct.pack(">ii", kind, size) + struct.pack(">q" if version == 2 else ">i", begin[k])
        begin = [len(head), len(head) + 24, len(head) + 28, len(head) + 36]
    out = head + struct.pack(">6f", *range(6))
    for r in range(records):
        out += struct.pack(">i", 24 * r) + pad(struct.pack(">3h", r, -7 if r == 1 else 10 * r, -r)) + pad(struct.pack(">b", r))
    return out


@pytest.mark.parametrize("version,streamed", [(1, False), (2, False), (1, True)])
def test_netcdf_of_another_writer(spark, tmp_path, version, streamed):
    (tmp_path / "a.nc").write_bytes(classic(version, streamed=streamed))
    df = N.read_netcdf(spark, str(tmp_path), "t2m", partition_bytes=6)
    assert df.schema.simpleString() == "struct<time:timestamp,y:double,value:double>" and df.rdd.getNumPartitions() == 3
    got = {(r.time, r.y): r.value for r in df.collect()}
    start = dt.datetime(2001, 3, 1, 6)
    want = {(start + dt.timedelta(days=r), float(y)): (None if (r, y) == (1, 1) else 100 + 0.5 * [r, 10 * r, -r][y]) for r in range(3) for y in range(3)}
    assert got == want
    assert [(r.y, r.x, r.value) for r in N.read_netcdf(spark, str(tmp_path), "fixed").orderBy("value").collect()] == [(k // 2, k % 2, k) for k in range(6)]
    assert [r.value for r in N.read_netcdf(spark, str(tmp_path), "flag").orderBy("time").collect()] == [0, 1, 2]
    (tmp_path / "a.nc").write_bytes(b"HDF" + classic()[3:])
    with pytest.raises(Exception, match="classic"):
        N.read_netcdf(spark, str(tmp_path), "t2m").collect()


def test_netcdf_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(str(y), dt.date(y, 2, 27) + dt.timedelta(days=k), r, c, None if rng.random() < 0.2 else float(rng.normal())) for y in (2000, 2001) for k in range(5) for r in range(3) for c in range(4) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "file string, time date, row int, col int, value double").repartition(4)
    N.write_netcdf(df, str(tmp_path / "n"), "v", 3, 4, left=10.0, top=9.0, cell=2.0)
    got = {(r.time.date(), r.lat, r.lon): r.value for r in N.read_netcdf(spark, str(tmp_path / "n"), "v", 200).where("value is not null").collect()}
    assert got == {(t, 8.0 - 2 * r, 11.0 + 2 * c): v for _, t, r, c, v in rows if v is not None}
    assert (tmp_path / "n" / "2000.nc").exists() and (tmp_path / "n" / "_SUCCESS").exists() and not (tmp_path / "n" / "_parts").exists()
    assert N.since("days since 1900-1-1") == (dt.datetime(1900, 1, 1), 86400) and N.since("K") is None


@pytest.mark.parametrize("version", [117, 118])
def test_stata_of_another_writer(spark, tmp_path, version):
    frame = pd.DataFrame({"id": np.arange(50, dtype=np.int32), "b": np.arange(50, dtype=np.int8), "s": np.arange(50, dtype=np.int16) * 600, "f": np.linspace(0, 1, 50).astype(np.float32), "x": [np.nan if i % 7 == 0 else i / 3 for i in range(50)], "name": [f"n{i}" if version == 117 else f"名{i}" for i in range(50)]})
    frame.to_stata(tmp_path / "a.dta", version=version, write_index=False)
    df = ST.read_stata(spark, str(tmp_path), partition_bytes=300)
    assert df.rdd.getNumPartitions() > 3 and df.schema.simpleString() == "struct<id:int,b:int,s:int,f:float,x:double,name:string>"
    got = df.orderBy("id").collect()
    for r, w in zip(got, frame.itertuples()):
        assert (r.id, r.b, r.s, r.f, r.name) == (w.id, w.b, w.s, w.f, w.name) and (r.x is None if w.x != w.x else r.x == w.x)
    assert ST.read_stata(spark, str(tmp_path), ["name", "x"]).columns == ["name", "x"]


def test_stata_sink_is_read_by_another_reader(spark, tmp_path):
    rows = [(i, 1 << 40, None if i % 5 == 0 else i / 7, None if i == 3 else "é" * (i % 9)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, big bigint, x double, name string").coalesce(1)
    ST.write_stata(df, str(tmp_path / "s"))
    (file,) = (tmp_path / "s").glob("*.dta")
    other = pd.read_stata(file)
    assert other["id"].tolist() == list(range(30)) and other["big"].tolist() == [float(1 << 40)] * 30
    assert [None if x != x else x for x in other["x"]] == [r[2] for r in rows] and other["name"].tolist() == [r[3] or "" for r in rows]
    assert sorted((r.id, r.x) for r in ST.read_stata(spark, str(tmp_path / "s")).where("x is not null").collect()) == [(r[0], r[2]) for r in rows if r[2] is not None]
    for bad in (df.withColumn("name", F.repeat(F.lit("x"), 3000)), df.withColumn("big", F.lit((1 << 60) + 1)), df.withColumnRenamed("name", "no name")):
        with pytest.raises(Exception):
            ST.write_stata(bad, str(tmp_path / "t"))
    assert not list((tmp_path / "t").glob("*.dta"))


def test_array_archives(spark, tmp_path):
    rng = np.random.default_rng(3)
    path = tmp_path / "a"
    want = {(str(y), n, k, r, c): float(rng.normal()) for y in (1981, 1982, 1983) for n in ("gdd", "hdd") for k in range(3) for r in range(20) for c in range(11) if not (r < 8 and c < 8)}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], A.CELLS).repartition(3)
    A.write_arrays(df.where("file < '1983'"), str(path), 3, 8)
    before = (path / "1981.npz").read_bytes()
    assert A.extend_arrays(df.withColumn("value", F.when(F.col("file") == "1983", F.col("value"))), str(path), 3, 8) == ["1983"] and A.extend_arrays(df, str(path), 3, 8) == []
    assert (path / "1981.npz").read_bytes() == before
    read = lambda **how: {tuple(r)[:5]: r.value for r in A.read_arrays(spark, str(path), **how).where("value is not null").collect()}
    assert read() == want and read(chunks=1) == want
    assert read(names=["hdd"], window=(7, 10, 5, 9)) == {k: v for k, v in want.items() if k[1] == "hdd" and 7 <= k[3] < 10 and 5 <= k[4] < 9}
    assert A.read_arrays(spark, str(path), names=["hdd"], window=(16, 20, 0, 3), chunks=1).rdd.getNumPartitions() == 3
    with np.load(io.BytesIO(before)) as z:
        assert sorted(z.files) == sorted(f"{n}/{r}.{c}" for n in ("gdd", "hdd") for r in (0, 8, 16) for c in (0, 8) if (r, c) != (0, 0)) and z["gdd/8.8"][1, 2, 0] == want["1981", "gdd", 1, 10, 8]
