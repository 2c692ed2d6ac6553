"""Shared folder, partition counts and Arrow helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine that names none gets a local one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and a lost
    executor costs a re-read only. Row groups are small, as rows may hold large binary values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that ``written`` has put into the shared folder; frames over it are void then."""
    while _paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, columns) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


MOST_BITS = 1 << 26


def marked(df: DataFrame, key: str, ids: DataFrame, name: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows with a column that is true wherever the key is among ``ids`` (one long column), and
    for about one key in 32 that isn't; nulls are false.

    The ids set bits of hashed bitmaps, which are broadcast: at most ``most_bits`` bits, however many
    ids there are. With many more ids nearly all rows are true, so what follows must still be exact.
    """
    (own,) = ids.columns
    bits = 1 << min(max((32 * ids.count()).bit_length(), 15), most_bits.bit_length() - 1)
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    bucket, bitmap = free("_bucket", df.columns), free("_bitmap", df.columns)
    maps = ids.where(F.col(own).isNotNull()).groupBy(F.bitmap_bucket_number(place(own)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(own))).alias(bitmap))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    joined = df.withColumn(bucket, F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), bucket, "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).select(*df.columns, name)


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session sends rows to Python in Arrow batches of a few MB from now on.

    A batch is built outside the heap, and its buffers double as they grow: batches of the default
    64 MB take hundreds of MB in each executor when rows hold long texts.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", conf.get(name))[0]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The rows joined (inner or left) with a table of distinct keys that is stored.

    One key may hold most rows. Both sides of such a join are plain shuffles of stored rows, not of an
    aggregate that needs a key's rows together, so adaptive execution splits a key's rows over tasks
    and sends the table's part to each.
    """
    return rows.join(table, keys, how)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(off)[~valid] != 0).any():
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
            return text_bytes(column)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def chunks(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of one text column."""
    data, off = text_bytes(batch.column(name))
    for a, b in slices(off, most):
        yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
