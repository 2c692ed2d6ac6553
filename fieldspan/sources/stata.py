"""Stata files of releases 117 and 118 as a Spark source and sink: format ``fieldspan_stata``.

The source reads the file's map and cuts the data, rows of fixed width, into ranges; value labels are not
applied. With ``columns`` only those are decoded. Missing values of any kind are NULL. Long strings
(strL) are an error where they are asked for.

The sink takes int, long, float, double and string columns; longs become doubles, and must be below
2^53 to stay whole. ``write_stata`` measures the strings first; the format has room for 2,045 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from fieldspan.sources.files import PARTITION_BYTES, FolderSink, Span, listed, opened, piece, temporary

NAME = "fieldspan_stata"
#: Fixed values of the format: codes of number types, and the least missing value of each.
_TYPES = {65526: ("f8", 2.0**1023), 65527: ("f4", 2.0**127), 65528: ("i4", 2147483621), 65529: ("i2", 32741), 65530: ("i1", 101)}
_STRL, _MOST = 32768, 2045
_PLACES = ("stata_dta", "map", "variable_types", "varnames", "sortlist", "formats", "value_label_names", "variable_labels", "characteristics", "data", "strls", "value_labels", "end", "eof")


@dataclass
class Layout:
    order: str
    rows: int
    names: list[str]
    kinds: list[int]
    start: int  #: of the first row

    @property
    def record(self) -> np.dtype:
        form = {k: self.order + t for k, (t, _) in _TYPES.items()} | {_STRL: "V8"}
        return np.dtype([(f"c{i}", form.get(k, f"S{k}")) for i, k in enumerate(self.kinds)])

    def type_of(self, i: int) -> T.DataType:
        kind = self.kinds[i]
        return T.StringType() if kind <= _STRL else {"f8": T.DoubleType(), "f4": T.FloatType()}.get(_TYPES[kind][0], T.IntegerType())


def _after(raw: bytes, tag: str, size: int) -> bytes:
    at = raw.index(f"<{tag}>".encode()) + len(tag) + 2
    return raw[at : at + size]


def layout(file: IO[bytes]) -> Layout:
    file.seek(0)
    head = file.read(4096)
    release = int(_after(head, "release", 3))
    if release not in (117, 118):
        raise ValueError(f"release {release}")
    order = {b"LSF": "<", b"MSF": ">"}[_after(head, "byteorder", 3)]
    (k,) = struct.unpack(f"{order}H", _after(head, "K", 2))
    (n,) = struct.unpack(f"{order}{'I' if release == 117 else 'Q'}", _after(head, "N", 4 if release == 117 else 8))
    at = dict(zip(_PLACES, struct.unpack(f"{order}14Q", _after(head, "map", 112))))
    wide = 33 if release == 117 else 129
    kinds = struct.unpack(f"{order}{k}H", piece(file, at["variable_types"] + len("<variable_types>"), 2 * k))
    names = piece(file, at["varnames"] + len("<varnames>"), wide * k)
    code = "latin-1" if release == 117 else "utf-8"
    return Layout(order, n, [names[i * wide : (i + 1) * wide].split(b"\0")[0].decode(code) for i in range(k)], list(kinds), at["data"] + len("<data>"))


class Stata(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = listed(self.options["path"], ".dta")
        if not files:
            raise ValueError(f"no Stata file in {self.options['path']}")
        with opened(files[0][0]) as f:
            own = layout(f)
        wanted = self.options["columns"].split(",") if self.options.get("columns") else own.names
        return T.StructType([T.StructField(c, own.type_of(own.names.index(c))) for c in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderSink:
        return _Sink(self.options["path"], overwrite, schema, self.options.get("widths", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes

    def partitions(self) -> list[Span]:
        out = []
        for path, _ in listed(self.path, ".dta"):
            with opened(path) as f:
                own = layout(f)
            step = max(1, self.partition_bytes // max(1, own.record.itemsize))
            out += [Span(path, a, min(a + step, own.rows)) for a in range(0, own.rows, step)]
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.start == span.stop:
            return
        with opened(span.path) as f:
            own = layout(f)
            record = own.record
            for a in range(span.start, span.stop, 8192):
                n = min(8192, span.stop - a)
                rows = np.frombuffer(piece(f, own.start + a * record.itemsize, n * record.itemsize), record)
                columns = [self._column(own, rows, own.names.index(c.name), c.dataType) for c in self.schema]
                yield pa.RecordBatch.from_arrays(columns, self.schema.names)

    def _column(self, own: Layout, rows: np.ndarray, i: int, kind: T.DataType) -> pa.Array:
        code, raw = own.kinds[i], rows[f"c{i}"]
        if code == _STRL:
            raise ValueError(f"{own.names[i]} holds long strings")
        if code < _STRL:
            return pa.array([x.split(b"\0")[0].decode() for x in raw.tolist()], pa.string())
        to = {T.IntegerType: np.int32, T.FloatType: np.float32, T.DoubleType: np.float64}[type(kind)]
        return pa.array(raw.astype(to), mask=(raw >= _TYPES[code][1]) | np.isnan(raw.astype(np.float64)))


class _Sink(FolderSink):
    def __init__(self, path: str, overwrite: bool, schema: T.StructType, widths: str):
        super().__init__(path, overwrite)
        codes = {"double": 65526, "bigint": 65526, "float": 65527, "int": 65528}
        sizes = dict(zip([f.name for f in schema if isinstance(f.dataType, T.StringType)], map(int, filter(None, widths.split(",")))))
        self.names, self.kinds = schema.names, [sizes[f.name] if f.name in sizes else codes[f.dataType.simpleString()] for f in schema]
        for name, kind in zip(self.names, self.kinds):
            if len(name) > 32 or not name.isidentifier() or not 1 <= kind <= 65530 or _MOST < kind < 65526:
                raise ValueError(f"no Stata column can be {name} of type {kind}")

    def parts(self, rows: Iterator) -> Iterator[tuple[str, dict[str, IO[bytes]]]]:
        body, n = temporary(), 0
        record = Layout("<", 0, self.names, self.kinds, 0).record
        missing = {k: v for k, (_, v) in _TYPES.items()}
        held = []

        def flushed() -> None:
            body.write(np.array(held, record).tobytes())
            held.clear()

        for row in rows:
            values = []
            for name, kind in zip(self.names, self.kinds):
                v = row[name]
                if kind < _STRL:
                    v = (v or "").encode()
                    if len(v) > kind or b"\0" in v:
                        raise ValueError(f"{name} has {len(v)} bytes, or a zero, for {kind}")
                elif v is None or v != v:
                    v = missing[kind]
                elif v >= missing[kind] or kind == 65528 and v < -2147483647 or kind == 65526 and isinstance(v, int) and abs(v) > 1 << 53:
                    raise ValueError(f"{name} can't hold {v}")
                values.append(v)
            held.append(tuple(values))
            n += 1
            if len(held) >= 4096:
                flushed()
        if not n:
            body.close()
            return
        flushed()
        out, k = temporary(), len(self.names)
        formats = [f"%{kind}s" if kind < _STRL else "%12.0g" for kind in self.kinds]
        fixed = lambda texts, size: b"".join(t.encode().ljust(size, b"\0") for t in texts)
        sections = [
            ("variable_types", struct.pack(f"<{k}H", *self.kinds)), ("varnames", fixed(self.names, 129)), ("sortlist", b"\0" * 2 * (k + 1)), ("formats", fixed(formats, 57)),
            ("value_label_names", b"\0" * 129 * k), ("variable_labels", b"\0" * 321 * k), ("characteristics", b""), ("data", None), ("strls", b""), ("value_labels", b""),
        ]
        head = b"<stata_dta><header><release>118</release><byteorder>LSF</byteorder><K>" + struct.pack("<H", k) + b"</K><N>" + struct.pack("<Q", n) + b"</N><label>\0\0</label><timestamp>\0</timestamp></header>"
        at = [0, len(head)]
        place = len(head) + len("<map></map>") + 112
        size = body.tell()
        for name, raw in sections:
            at.append(place)
            place += 2 * len(name) + 5 + (size if raw is None else len(raw))
        at += [place, place + len("</stata_dta>")]
        out.write(head + b"<map>" + struct.pack("<14Q", *at) + b"</map>")
        body.seek(0)
        with body:
            for name, raw in sections:
                out.write(f"<{name}>".encode())
                if raw is None:
                    while got := body.read(1 << 20):
                        out.write(got)
                else:
                    out.write(raw)
                out.write(f"</{name}>".encode())
        out.write(b"</stata_dta>")
        yield "", {".dta": out}


def write_stata(df: DataFrame, path: str) -> None:
    """A file per task; string columns are as wide as their longest value."""
    df.sparkSession.dataSource.register(Stata)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = df.agg(*[F.greatest(F.max(F.octet_length(c)), F.lit(1)) for c in texts]).first() if texts else ()
    df.write.format(NAME).option("widths", ",".join(str(x or 1) for x in found)).mode("append").save(path)


def read_stata(spark: SparkSession, path: str, columns: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Stata)
    return spark.read.format(NAME).options(columns=",".join(columns or []), partitionBytes=partition_bytes).load(path)
