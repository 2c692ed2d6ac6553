"""NetCDF files of the classic formats as a Spark source and sink: format ``fieldspan_netcdf``.

The source gives one variable as rows: a column per dimension (its coordinate variable's values, or
places where there is none) and ``value``, NULL for fill and missing values, scaled and offset as
the attributes say. A dimension whose units are days, hours or minutes since a date is a timestamp. A
task reads the header and a slab of steps along the first dimension, a step at a time.

The sink takes file, time (a date), row, col and value, and writes a file per name, with time as the
record dimension: a record is the time and a grid, and cells without a row hold the fill value.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldspan.sources.files import PARTITION_BYTES, FolderSink, Span, listed, opened, temporary

NAME = "fieldspan_netcdf"
FILL = -9999.0
#: Fixed values of the format: external types by number.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


@dataclass
class Variable:
    dims: tuple[str, ...]
    attributes: dict
    kind: np.dtype
    begin: int
    size: int  #: bytes of one record, or of all


@dataclass
class Header:
    dims: dict[str, int]  #: the record dimension with its number of records
    record: str | None
    variables: dict[str, Variable]
    record_bytes: int

    def steps(self, variable: Variable) -> tuple[int, int, int]:
        """(steps along the first dimension, values a step, bytes from step to step)."""
        shape = [self.dims[d] for d in variable.dims]
        each = int(np.prod(shape[1:], dtype=np.int64))
        return shape[0], each, self.record_bytes if variable.dims[0] == self.record else each * variable.kind.itemsize


class _Cursor:
    def __init__(self, file: IO[bytes]):
        self.file = file
        file.seek(0)

    def take(self, form: str):
        got = struct.unpack(f">{form}", self.file.read(struct.calcsize(f">{form}")))
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        n = self.take("i")
        return self.file.read(n + -n % 4)[:n].decode()

    def values(self):
        kind, n = np.dtype(_TYPES[self.take("i")]), self.take("i")
        size = n * kind.itemsize
        raw = self.file.read(size + -size % 4)[:size]
        return raw.decode() if kind.kind == "S" else np.frombuffer(raw, kind).tolist()

    def listed(self, tag: int, one) -> list:
        found, n = self.take("ii")
        if found not in (0, tag):
            raise ValueError(f"list {found} where {tag} should be")
        return [one() for _ in range(n)]

    def attributes(self) -> dict:
        return dict(self.listed(12, lambda: (self.text(), self.values())))


def header(file: IO[bytes]) -> Header:
    c = _Cursor(file)
    magic, version, records = c.take("3sBi")
    if magic != b"CDF" or version not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    dims = c.listed(10, lambda: (c.text(), c.take("i")))
    c.attributes()

    def variable() -> tuple[str, Variable]:
        name, rank = c.text(), c.take("i")
        own = tuple(dims[c.take("i")][0] for _ in range(rank))
        return name, Variable(own, c.attributes(), np.dtype(_TYPES[c.take("i")]), size=c.take("i"), begin=c.take("q" if version == 2 else "i"))

    variables = dict(c.listed(11, variable))
    record = next((n for n, size in dims if size == 0), None)
    by_record = [v for v in variables.values() if v.dims[:1] == (record,)]
    each = lambda v: int(np.prod([dict(dims)[d] for d in v.dims[1:]], dtype=np.int64)) * v.kind.itemsize
    record_bytes = each(by_record[0]) if len(by_record) == 1 else sum(each(v) + -each(v) % 4 for v in by_record)
    if records < 0:  # written as a stream: the file's length tells
        records = (file.seek(0, 2) - min(v.begin for v in by_record)) // record_bytes if by_record else 0
    return Header({n: size or records for n, size in dims}, record, variables, record_bytes)


def values(file: IO[bytes], head: Header, variable: Variable, step: int) -> np.ndarray:
    _, each, stride = head.steps(variable)
    file.seek(variable.begin + step * stride)
    raw = file.read(each * variable.kind.itemsize)
    stored = np.frombuffer(raw, variable.kind, each)
    out = stored.astype(np.float64)
    a = variable.attributes
    for name in ("_FillValue", "missing_value"):
        for v in a.get(name, []):
            out[stored == variable.kind.type(v)] = np.nan
    return out * (a.get("scale_factor") or [1.0])[0] + (a.get("add_offset") or [0.0])[0]


def since(units: str) -> tuple[dt.datetime, int] | None:
    """(start, seconds a unit) of "days since 1900-01-01" and the like."""
    m = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+)(?::(\d+))?)?", units or "")
    return (dt.datetime(*(int(x or 0) for x in m.groups()[1:])), _UNITS[m[1]]) if m else None


def _times(head: Header, dim: str) -> tuple[dt.datetime, int] | None:
    own = head.variables.get(dim)
    if own is None or not isinstance(own.attributes.get("units"), str) or own.dims != (dim,):
        return None
    found = since(own.attributes["units"])
    if found and own.attributes.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {own.attributes['calendar']}")
    return found


class NetCdf(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = listed(self.options["path"], ".nc")
        if not files:
            raise ValueError(f"no NetCDF file in {self.options['path']}")
        with opened(files[0][0]) as f:
            head = header(f)
        dims = head.variables[self.options["variable"]].dims
        kinds = [T.TimestampType() if _times(head, d) else T.DoubleType() for d in dims]
        return T.StructType([*[T.StructField(d, k) for d, k in zip(dims, kinds)], T.StructField("value", T.DoubleType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["variable"], int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderSink:
        o = self.options
        return _Sink(o["path"], overwrite, o["variable"], int(o["rows"]), int(o["cols"]), *(float(o[k]) for k in ("left", "top", "cell")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, variable: str, partition_bytes: int):
        self.path, self.variable, self.partition_bytes = path, variable, partition_bytes

    def partitions(self) -> list[Span]:
        out = []
        for path, _ in listed(self.path, ".nc"):
            with opened(path) as f:
                head = header(f)
            own = head.variables[self.variable]
            n, each, _ = head.steps(own)
            step = max(1, self.partition_bytes // max(1, each * own.kind.itemsize))
            out += [Span(path, a, min(a + step, n)) for a in range(0, n, step)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.start == span.stop:
            return
        with opened(span.path) as f:
            head = header(f)
            own = head.variables[self.variable]
            shape = [head.dims[d] for d in own.dims]
            places = [self._places(f, head, d, range(span.start, span.stop) if not i else range(shape[i])) for i, d in enumerate(own.dims)]
            within = [x.ravel() for x in np.indices(shape[1:])]
            for k in range(span.start, span.stop):
                v = values(f, head, own, k)
                first = np.full(len(v), places[0][k - span.start])
                columns = [pa.array(first, pa.timestamp("us", "UTC") if first.dtype.kind == "M" else pa.float64())]
                columns += [pa.array(p[i], pa.timestamp("us", "UTC") if p.dtype.kind == "M" else pa.float64()) for p, i in zip(places[1:], within)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(v, mask=np.isnan(v))], [*own.dims, "value"])

    def _places(self, file: IO[bytes], head: Header, dim: str, steps: range) -> np.ndarray:
        own = head.variables.get(dim)
        if own is None or own.dims != (dim,):
            return np.array(steps, np.float64)
        found = np.array([values(file, head, own, k)[0] for k in steps])
        times = _times(head, dim)
        if times is None:
            return found
        return np.datetime64(times[0], "us") + np.round(found * times[1] * 1e6).astype("timedelta64[us]")


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attribute(name: str, value) -> bytes:
    if isinstance(value, str):
        return _name(name) + struct.pack(">i", 2) + _name(value)
    return _name(name) + struct.pack(">iid", 6, 1, value)


class _Sink(FolderSink):
    def __init__(self, path: str, overwrite: bool, variable: str, rows: int, cols: int, left: float, top: float, cell: float):
        super().__init__(path, overwrite)
        self.variable, self.rows, self.cols, self.left, self.top, self.cell = variable, rows, cols, left, top, cell

    def _header(self, records: int) -> bytes:
        dims = [("time", 0), ("lat", self.rows), ("lon", self.cols)]
        grid = 8 * self.rows * self.cols
        #: name, dimensions, attributes, bytes
        own = [
            ("lat", (1,), {"units": "degrees_north"}, 8 * self.rows), ("lon", (2,), {"units": "degrees_east"}, 8 * self.cols),
            ("time", (0,), {"units": "days since 1970-01-01", "calendar": "standard"}, 8), (self.variable, (0, 1, 2), {"_FillValue": FILL}, grid),
        ]
        begin, out = 0, b""
        for _ in range(2):  # places of the data depend on the header's length, which doesn't depend on them
            at, out = begin, struct.pack(">3sBiii", b"CDF", 2, records, 10, len(dims))
            out += b"".join(_name(n) + struct.pack(">i", size) for n, size in dims) + struct.pack(">iiii", 0, 0, 11, len(own))
            for name, on, attributes, size in own:
                made = b"".join(_attribute(k, v) for k, v in attributes.items())
                out += _name(name) + struct.pack(f">i{len(on)}iii", len(on), *on, 12, len(attributes)) + made + struct.pack(">iiq", 6, size, at)
                at += size
            begin = len(out)
        return out

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        for file, own in groupby(rows, key=lambda r: r["file"]):
            out, n = temporary(), 0
            out.write(self._header(0))
            out.write((self.top - (np.arange(self.rows) + 0.5) * self.cell).astype(">f8").tobytes())
            out.write((self.left + (np.arange(self.cols) + 0.5) * self.cell).astype(">f8").tobytes())
            for day, cells in groupby(own, key=lambda r: r["time"]):
                grid = np.full((self.rows, self.cols), FILL, ">f8")
                for r in cells:
                    if r["value"] is not None:
                        grid[r["row"], r["col"]] = r["value"]
                out.write(struct.pack(">d", (day - dt.date(1970, 1, 1)).days) + grid.tobytes())
                n += 1
            out.seek(0)
            out.write(self._header(n))
            yield str(file), {".nc": out}


def write_netcdf(df: DataFrame, path: str, variable: str, rows: int, cols: int, left: float = 0.0, top: float = 0.0, cell: float = 1.0) -> None:
    """A file per value of ``file``; from file, time (date), row, col, value, one row a cell and day."""
    df.sparkSession.dataSource.register(NetCdf)
    dealt = df.select("file", "time", "row", "col", "value").repartition("file").sortWithinPartitions("file", "time")
    dealt.write.format(NAME).options(variable=variable, rows=rows, cols=cols, left=left, top=top, cell=cell).mode("append").save(path)


def read_netcdf(spark: SparkSession, path: str, variable: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(NetCdf)
    return spark.read.format(NAME).options(variable=variable, partitionBytes=partition_bytes).load(path)
