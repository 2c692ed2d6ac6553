"""Archives of chunked arrays (NPZ) as a Spark source and sink: format ``fieldspan_arrays``.

An archive holds named arrays of layers x rows x cols, cut into square chunks; a chunk is a member
``name/row.col.npy``, so the ZIP directory is the index, and NumPy opens the file as it is. The source
reads only the chunks of the asked arrays that meet the asked window, some to a task. NaN is NULL.

The sink takes file, name, layer, row, col and value and writes an archive per file name, a chunk at a
time, as ``write_arrays`` deals the rows. ``extend_arrays`` adds the archives that a folder lacks and
touches none that it has.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import groupby
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldspan.sources.files import FolderSink, Span, listed, opened, temporary

NAME = "fieldspan_arrays"
CELLS = "file string, name string, layer int, row int, col int, value double"


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        window = tuple(int(x) for x in o["window"].split(",")) if o.get("window") else None
        return _Reader(o["path"], set(o["names"].split(",")) if o.get("names") else None, window, int(o.get("chunks", 64)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderSink:
        return _Sink(self.options["path"], overwrite, int(self.options["layers"]), int(self.options["tile"]))


def _place(member: str) -> tuple[str, int, int]:
    name, _, at = member[:-4].rpartition("/")
    row, col = at.split(".")
    return name, int(row), int(col)


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: set[str] | None, window: tuple[int, ...] | None, chunks: int):
        self.path, self.names, self.window, self.chunks = path, names, window, chunks

    def _members(self, path: str) -> list[str]:
        with opened(path) as f, zipfile.ZipFile(f) as z:
            found = [n for n in z.namelist() if n.endswith(".npy")]
            if self.names is not None:
                found = [n for n in found if _place(n)[0] in self.names]
            if self.window is None or not found:
                return sorted(found)
            with z.open(found[0]) as member:
                tile = np.load(member).shape[1]
        low, high, left, right = self.window
        return sorted(n for n in found if low - tile < _place(n)[1] < high and left - tile < _place(n)[2] < right)

    def partitions(self) -> list[Span]:
        out = []
        for path, _ in listed(self.path, ".npz"):
            n = len(self._members(path))
            out += [Span(path, a, min(a + self.chunks, n)) for a in range(0, n, self.chunks)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.start == span.stop:
            return
        file = span.path.rsplit("/", 1)[-1][:-4]
        members = self._members(span.path)[span.start : span.stop]
        with opened(span.path) as f, zipfile.ZipFile(f) as z:
            for member in members:
                name, row, col = _place(member)
                with z.open(member) as raw:
                    values = np.load(raw)
                layer, r, c = (x.ravel().astype(np.int32) for x in np.indices(values.shape))
                r, c, v = r + np.int32(row), c + np.int32(col), values.ravel().astype(np.float64)
                if self.window is not None:
                    low, high, left, right = self.window
                    keep = (r >= low) & (r < high) & (c >= left) & (c < right)
                    layer, r, c, v = layer[keep], r[keep], c[keep], v[keep]
                same = lambda x, n=len(v): pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                yield pa.RecordBatch.from_arrays([same(file), same(name), pa.array(layer), pa.array(r), pa.array(c), pa.array(v, mask=np.isnan(v))], [x.split()[0] for x in CELLS.split(", ")])


class _Sink(FolderSink):
    def __init__(self, path: str, overwrite: bool, layers: int, tile: int):
        super().__init__(path, overwrite)
        self.layers, self.tile = layers, tile

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        for file, own in groupby(rows, key=lambda r: r["file"]):
            out = temporary()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for (name, row, col), cells in groupby(own, key=lambda r: (r["name"], r["row"] // self.tile, r["col"] // self.tile)):
                    chunk = np.full((self.layers, self.tile, self.tile), np.nan)
                    for r in cells:
                        if r["value"] is not None:
                            chunk[r["layer"], r["row"] % self.tile, r["col"] % self.tile] = r["value"]
                    member = f"{name}/{row * self.tile}.{col * self.tile}.npy"
                    if member in z.NameToInfo:
                        raise ValueError("chunks must come one after another")
                    with z.open(member, "w") as to:
                        np.save(to, chunk)
            yield str(file), {".npz": out}


def write_arrays(df: DataFrame, path: str, layers: int, tile: int = 64) -> None:
    """An archive per value of ``file``; from file, name, layer, row, col, value, one row a cell."""
    df.sparkSession.dataSource.register(Arrays)
    place = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    dealt = df.select("file", "name", "layer", "row", "col", "value").repartition("file").sortWithinPartitions("file", "name", *place)
    dealt.write.format(NAME).options(layers=layers, tile=tile).mode("append").save(path)


def extend_arrays(df: DataFrame, path: str, layers: int, tile: int = 64) -> list[str]:
    """Write the files of ``df`` that the folder lacks; their names. Those that are there aren't opened."""
    there = [p.rsplit("/", 1)[-1][:-4] for p, _ in listed(path, ".npz")]
    new = df.where(~F.col("file").isin(there)) if there else df
    names = sorted(r[0] for r in new.select("file").distinct().collect())  # a name per archive
    if names:
        write_arrays(new, path, layers, tile)
    return names


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None, window: tuple[int, int, int, int] | None = None, chunks: int = 64) -> DataFrame:
    """Cells of the named arrays within rows and cols (first, behind last) of the window."""
    spark.dataSource.register(Arrays)
    return spark.read.format(NAME).options(names=",".join(names or []), window=",".join(map(str, window or ())), chunks=chunks).load(path)
