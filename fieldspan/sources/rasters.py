"""GeoTIFF rasters inside ZIP archives as a Spark source and sink: format ``fieldspan_rasters``.

A row of the source is a cell: archive, member, window, row, col, x and y of its centre, value (NULL for
NoData), failed. Tasks take a few members each, or, with ``splits``, a share of the windows (tiles or
strips) of one; a task reads the tile directory, then tile by tile. The grid is each member's own,
never assumed. A window that can't be read is tried again with the archive opened anew; if it still
fails, its cells have NULL values and ``failed`` is true, and a member without a readable directory
gives one failed row without cell. Uncompressed and deflated tiles of whole numbers or floats, with or
without horizontal differencing, are known; other codings are failures too.

The sink takes archive, member, row, col and value, and writes an archive per name, tile by tile, as
``write_rasters`` deals the rows; cells without a row are NoData, tiles without one aren't stored.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldspan.sources.files import FolderSink, Span, listed, opened, temporary

NAME = "fieldspan_rasters"
CELLS = "archive string, member string, window int, row int, col int, x double, y double, value double, failed boolean"
#: Fixed values of the TIFF format: sizes and codes of field types; the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE, SCALE, TIE, GEO_KEYS, NODATA = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_ERRORS = (OSError, EOFError, ValueError, KeyError, IndexError, struct.error, zlib.error, zipfile.BadZipFile)


@dataclass
class Layout:
    """A raster's grid and where its windows lie."""

    order: str
    rows: int
    cols: int
    high: int
    wide: int
    kind: np.dtype
    compression: int
    predictor: int
    at: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None
    left: float
    top: float
    cell: tuple[float, float]

    @property
    def across(self) -> int:
        return -(-self.cols // self.wide)


def layout(file: IO[bytes]) -> Layout:
    file.seek(0)
    head = file.read(8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    magic, at = struct.unpack(f"{order}HI", head[2:])
    if magic != 42:
        raise ValueError("not a TIFF of 32-bit places")
    file.seek(at)
    (n,) = struct.unpack(f"{order}H", file.read(2))
    raw = file.read(12 * n)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", raw[12 * k : 12 * k + 8])
        if kind not in _CODES:
            continue
        size, value = _SIZES[kind] * count, raw[12 * k + 8 : 12 * k + 12]
        if size > 4:
            file.seek(struct.unpack(f"{order}I", value)[0])
            value = file.read(size)
        tags[tag] = (value[:size].rstrip(b"\0").decode(),) if kind == 2 else struct.unpack(f"{order}{count}{_CODES[kind]}", value[:size])
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    cols, rows = one(WIDTH), one(HEIGHT)
    tiled = TILE_AT in tags
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE, 1)] }{one(BITS) // 8}")
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    nodata = one(NODATA, "")
    return Layout(
        order, rows, cols, one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, rows), rows), one(TILE_WIDTH) if tiled else cols, kind, one(COMPRESSION, 1), one(PREDICTOR, 1),
        tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], float(nodata) if nodata.strip() else None, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], (scale[0], scale[1]),
    )


def window(file: IO[bytes], own: Layout, k: int) -> tuple[int, int, np.ndarray]:
    """(first row, first col, values as floats, NaN for NoData) of a window, cut to the grid."""
    row, col = k // own.across * own.high, k % own.across * own.wide
    high, wide = min(own.high, own.rows - row), min(own.wide, own.cols - col)
    if own.sizes[k] == 0:
        return row, col, np.full((high, wide), np.nan)
    file.seek(own.at[k])
    raw = file.read(own.sizes[k])
    if own.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif own.compression != 1:
        raise ValueError(f"compression {own.compression}")
    stored = own.high if len(raw) == own.high * own.wide * own.kind.itemsize else high  # a last strip may be short
    values = np.frombuffer(raw, own.kind, stored * own.wide).reshape(stored, own.wide)
    if own.predictor == 2:
        values = np.cumsum(values, 1, dtype=own.kind.newbyteorder("="))
    elif own.predictor != 1:
        raise ValueError(f"predictor {own.predictor}")
    out = values[:high, :wide].astype(np.float64)
    if own.nodata is not None:
        out[values[:high, :wide] == np.array(own.nodata).astype(own.kind)] = np.nan
    return row, col, out


class Rasters(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("members", 8)), int(o.get("splits", 1)), int(o.get("retries", 3)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderSink:
        o = self.options
        return _Sink(o["path"], overwrite, *(int(o[k]) for k in ("rows", "cols", "tile")), *(float(o[k]) for k in ("left", "top", "cell", "nodata")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, members: int, splits: int, retries: int):
        self.path, self.members, self.splits, self.retries = path, members, splits, retries

    def partitions(self) -> list[Span]:
        out = []
        for path, _ in listed(self.path, ".zip"):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                n = sum(x.lower().endswith((".tif", ".tiff")) for x in z.namelist())
            step = 1 if self.splits > 1 else self.members
            out += [Span(path, a, min(a + step, n), (k,)) for a in range(0, n, step) for k in range(self.splits)]
        return out or [Span("", 0, 0, (0,))]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        archive = span.path.rsplit("/", 1)[-1][:-4]
        with opened(span.path) as f, zipfile.ZipFile(f) as z:
            names = sorted(x for x in z.namelist() if x.lower().endswith((".tif", ".tiff")))[span.start : span.stop]
        for name in names:
            yield from self._member(span, archive, name)

    def _tried(self, path: str, name: str, what):
        """``what`` of the opened member, None if it fails each time; each time all is opened anew."""
        for _ in range(self.retries):
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z, z.open(name) as member:
                    return what(member)
            except _ERRORS:
                continue
        return None

    def _member(self, span: Span, archive: str, name: str) -> Iterator[pa.RecordBatch]:
        own = self._tried(span.path, name, layout)
        (k,) = span.more
        if own is None:
            if k == 0:
                yield _batch(archive, name, None, None, None, None, None)
            return
        todo = list(range(len(own.at) * k // self.splits, len(own.at) * (k + 1) // self.splits))
        with opened(span.path) as f, zipfile.ZipFile(f) as z, z.open(name) as member:
            for i in todo:
                try:
                    got = window(member, own, i)
                except _ERRORS:
                    got = self._tried(span.path, name, lambda m, i=i: window(m, own, i))
                failed = got is None
                if failed:
                    row, col = i // own.across * own.high, i % own.across * own.wide
                    got = row, col, np.full((min(own.high, own.rows - row), min(own.wide, own.cols - col)), np.nan)
                yield _batch(archive, name, own, i, got[0], got[1], got[2], failed)


def _batch(archive: str, name: str, own: Layout | None, k, row, col, values, failed: bool = True) -> pa.RecordBatch:
    names = [c.split()[0] for c in CELLS.split(", ")]
    if own is None:
        nothing = [pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), *nothing, pa.array([True])], names)
    n = values.size
    r, c = (x.ravel() for x in np.indices(values.shape))
    r, c, v = (r + row).astype(np.int32), (c + col).astype(np.int32), values.ravel()
    same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(n, np.int32)))
    columns = [same(archive, pa.string()), same(name, pa.string()), same(k, pa.int32()), pa.array(r), pa.array(c)]
    columns += [pa.array(own.left + (c + 0.5) * own.cell[0]), pa.array(own.top - (r + 0.5) * own.cell[1]), pa.array(v, mask=np.isnan(v)), same(failed, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names)


class _Sink(FolderSink):
    def __init__(self, path: str, overwrite: bool, rows: int, cols: int, tile: int, left: float, top: float, cell: float, nodata: float):
        super().__init__(path, overwrite)
        self.rows, self.cols, self.tile, self.left, self.top, self.cell, self.nodata = rows, cols, tile, left, top, cell, nodata

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        across = -(-self.cols // self.tile)
        for archive, own in groupby(rows, key=lambda r: r["archive"]):
            out = temporary()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for member, cells in groupby(own, key=lambda r: r["member"]):
                    with temporary() as file:
                        self._raster(file, groupby(cells, key=lambda r: r["row"] // self.tile * across + r["col"] // self.tile))
                        file.seek(0)
                        with z.open(member, "w") as to:
                            while got := file.read(1 << 20):
                                to.write(got)
            yield str(archive), {".zip": out}

    def _raster(self, file: IO[bytes], tiles) -> None:
        across, down = -(-self.cols // self.tile), -(-self.rows // self.tile)
        at, sizes = [0] * (across * down), [0] * (across * down)
        file.write(b"\0" * 8)
        for k, cells in tiles:
            if at[k]:
                raise ValueError("tiles must come one after another")
            values = np.full((self.tile, self.tile), self.nodata)
            for r in cells:
                if r["value"] is not None:
                    values[r["row"] % self.tile, r["col"] % self.tile] = r["value"]
            raw = zlib.compress(values.astype("<f8").tobytes(), 6)
            at[k], sizes[k] = file.tell(), len(raw)
            file.write(raw)
        nodata = repr(self.nodata).encode() + b"\0"
        keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)  # degrees
        tags = [
            (WIDTH, 4, (self.cols,)), (HEIGHT, 4, (self.rows,)), (BITS, 3, (64,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (277, 3, (1,)), (TILE_WIDTH, 4, (self.tile,)), (TILE_HEIGHT, 4, (self.tile,)),
            (TILE_AT, 4, tuple(at)), (TILE_BYTES, 4, tuple(sizes)), (SAMPLE, 3, (3,)), (SCALE, 12, (self.cell, self.cell, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, self.left, self.top, 0.0)), (GEO_KEYS, 3, keys), (NODATA, 2, (nodata,)),
        ]
        entries = []
        for tag, kind, values in tags:
            raw = values[0] if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                where = file.tell()
                file.write(raw)
                raw, count = struct.pack("<I", where), len(raw) // _SIZES[kind]
            else:
                count, raw = len(raw) // _SIZES[kind], raw.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, count) + raw)
        directory = file.tell()
        file.write(struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4)
        file.seek(0)
        file.write(struct.pack("<2sHI", b"II", 42, directory))


def write_rasters(df: DataFrame, path: str, rows: int, cols: int, left: float = 0.0, top: float = 0.0, cell: float = 1.0, tile: int = 64, nodata: float = -9999.0) -> None:
    """An archive of rasters per value of ``archive``; from archive, member, row, col, value, one row a cell."""
    df.sparkSession.dataSource.register(Rasters)
    place = F.floor(F.col("row") / tile) * (-(-cols // tile)) + F.floor(F.col("col") / tile)
    dealt = df.select("archive", "member", "row", "col", "value").repartition("archive").sortWithinPartitions("archive", "member", place, "row", "col")
    options = {"rows": rows, "cols": cols, "left": left, "top": top, "cell": cell, "tile": tile, "nodata": nodata}
    dealt.write.format(NAME).options(**options).mode("append").save(path)


def read_rasters(spark: SparkSession, path: str, members: int = 8, splits: int = 1, retries: int = 3) -> DataFrame:
    spark.dataSource.register(Rasters)
    return spark.read.format(NAME).options(members=members, splits=splits, retries=retries).load(path)
