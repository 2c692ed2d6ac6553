"""Shapefiles of polygons as a Spark source and sink: format ``fieldspan_shapes``.

The source cuts each file into ranges of records by its index (.shx), so a task reads its bytes of the
shapes (.shp) and its rows of the attributes (.dbf), and nothing else. Columns are the attributes, and
``rings``: lists of points, outer rings clockwise. A shape of type null has NULL rings; deleted rows
are left out. Attributes are long, double or string; blank ones are NULL.

The sink takes int, long, float, double and string columns and ``rings``; each task writes one
file of three parts. Names of more than ten bytes and strings of more than 254 are errors, as the
format has no room for them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldspan.sources.files import PARTITION_BYTES, FolderSink, Span, listed, opened, piece, temporary

NAME = "fieldspan_shapes"
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
_NULL, _POLYGONS = 0, (5, 15, 25)


def attributes(file: IO[bytes]) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(rows, bytes before them, bytes a row, fields as name, kind, width, decimals) of a .dbf file."""
    rows, before, width = struct.unpack("<IHH", piece(file, 4, 8))
    raw = piece(file, 32, before - 32)
    fields = [raw[a : a + 32] for a in range(0, len(raw) - 1, 32) if raw[a] != 0x0D]
    return rows, before, width, [(f[:11].split(b"\0")[0].decode(), chr(f[11]), f[16], f[17]) for f in fields]


def _kind(kind: str, decimals: int) -> T.DataType:
    return T.StringType() if kind not in "NF" else T.DoubleType() if decimals or kind == "F" else T.LongType()


def _value(raw: bytes, kind: T.DataType):
    text = raw.decode().strip(" \0")
    if not text or set(text) == {"*"}:
        return None
    return text if isinstance(kind, T.StringType) else float(text) if isinstance(kind, T.DoubleType) else int(float(text)) if "." in text else int(text)


def rings_of(record: bytes) -> list[list[tuple[float, float]]] | None:
    kind, *_ = struct.unpack("<i", record[:4])
    if kind == _NULL:
        return None
    if kind not in _POLYGONS:
        raise ValueError(f"shapes of type {kind} are no polygons")
    n_parts, n_points = struct.unpack("<ii", record[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", record[44 : 44 + 4 * n_parts]), n_points]
    flat = struct.unpack(f"<{2 * n_points}d", record[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
    points = list(zip(flat[::2], flat[1::2]))
    return [points[a:b] for a, b in zip(starts, starts[1:])]


def record_of(rings: list | None) -> bytes:
    if rings is None:
        return struct.pack("<i", _NULL)
    points = [[(p["x"], p["y"]) for p in ring] for ring in rings]
    points = [[*r, r[0]] if r and r[0] != r[-1] else r for r in points]
    flat = [c for r in points for p in r for c in p]
    xs, ys = flat[::2] or [0.0], flat[1::2] or [0.0]
    starts = [sum(map(len, points[:i])) for i in range(len(points))]
    return struct.pack(f"<i4d2i{len(points)}i{len(flat)}d", 5, min(xs), min(ys), max(xs), max(ys), len(points), len(flat) // 2, *starts, *flat)


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = listed(self.options["path"], ".dbf")
        if not files:
            raise ValueError(f"no shapefile in {self.options['path']}")
        with opened(files[0][0]) as f:
            fields = attributes(f)[3]
        return T.StructType([*[T.StructField(n, _kind(k, d)) for n, k, _, d in fields], T.StructField("rings", RINGS)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderSink:
        return _Sink(self.options["path"], overwrite, schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes

    def partitions(self) -> list[Span]:
        out = []
        for path, size in listed(self.path, ".shp"):
            with opened(path[:-4] + ".shx") as index:
                n = (index.seek(0, 2) - 100) // 8
            parts = max(1, min(n, -(-size // self.partition_bytes)))
            out += [Span(path, n * k // parts, n * (k + 1) // parts) for k in range(parts)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if span.start == span.stop:
            return
        with opened(span.path[:-4] + ".shx") as index, opened(span.path) as shapes, opened(span.path[:-4] + ".dbf") as table:
            _, before, width, fields = attributes(table)
            places = [f.dataType for f in self.schema if f.name != "rings"]
            for k in range(span.start, span.stop, 256):
                n = min(256, span.stop - k)
                at = struct.unpack(f">{2 * n}i", piece(index, 100 + 8 * k, 8 * n))
                rows = piece(table, before + width * k, width * n)
                for i in range(n):
                    row = rows[i * width : (i + 1) * width]
                    if row[:1] == b"*":
                        continue
                    values, start = [], 1
                    for (_, _, size, _), kind in zip(fields, places):
                        values.append(_value(row[start : start + size], kind))
                        start += size
                    yield (*values, rings_of(piece(shapes, 2 * at[2 * i] + 8, 2 * at[2 * i + 1])))


class _Sink(FolderSink):
    def __init__(self, path: str, overwrite: bool, schema: T.StructType):
        super().__init__(path, overwrite)
        self.fields = []
        for f in schema:
            if f.name == "rings":
                continue
            if len(f.name.encode()) > 10:
                raise ValueError(f"the name {f.name} has more than ten bytes")
            kinds = {"int": ("N", 11, 0), "bigint": ("N", 20, 0), "float": ("F", 25, 16), "double": ("F", 25, 16), "string": ("C", 254, 0)}
            self.fields.append((f.name, *kinds[f.dataType.simpleString()]))

    def _row(self, row) -> bytes:
        out = [b" "]
        for name, kind, width, _ in self.fields:
            value = row[name]
            raw = b"" if value is None else value.encode() if kind == "C" else repr(value).encode()
            if len(raw) > width:
                raise ValueError(f"{name} takes {len(raw)} bytes, there are {width}")
            out.append(raw.ljust(width) if kind == "C" else raw.rjust(width))
        return b"".join(out)

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        shp, shx, dbf = temporary(), temporary(), temporary()
        width = 1 + sum(f[2] for f in self.fields)
        before = 32 + 32 * len(self.fields) + 1
        shp.seek(100), shx.seek(100), dbf.seek(before)
        at, n = 50, 0  # places and lengths are in words of two bytes
        for row in rows:
            record = record_of(row["rings"])
            shp.write(struct.pack(">ii", n + 1, len(record) // 2) + record)
            shx.write(struct.pack(">ii", at, len(record) // 2))
            dbf.write(self._row(row))
            at += 4 + len(record) // 2
            n += 1
        if not n:
            return
        dbf.write(b"\x1a")
        for file, words in ((shp, at), (shx, 50 + 4 * n)):
            file.seek(0)
            file.write(struct.pack(">i20xi", 9994, words) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8))
        dbf.seek(0)
        dbf.write(struct.pack("<B3BIHH20x", 3, 100, 1, 1, n, before, width))
        for name, kind, size, decimals in self.fields:
            dbf.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, decimals))
        dbf.write(b"\r")
        yield "", {".shp": shp, ".shx": shx, ".dbf": dbf}


def write_shapes(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(Shapes)
    df.write.format(NAME).mode("append").save(path)


def read_shapes(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Shapes)
    return spark.read.format(NAME).option("partitionBytes", partition_bytes).load(path)
