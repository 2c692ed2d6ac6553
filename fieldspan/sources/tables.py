"""Reading the driver tables and the panel derived from them; stored stages, their caching, and text sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

VARS = ("y", "x_l", "x_s", "x_k", "x_m")
INPUTS = VARS[1:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers have one mark: NaN becomes NULL in every float column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


_held: dict[tuple[str, str, str], DataFrame] = {}


def held(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A small table of a folder that is met several times, kept until ``release``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = build(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _held[key]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, sid, region, year and five measures: one row per supplier and ship year.

    The queries meet the panel several times each (lags, shares, references), and it is small beside
    the lines it sums, so it is kept, on disk where memory is short, until ``release``.
    """
    return held(spark, sf_dir, "panel", _panel)


def release(spark: SparkSession) -> None:
    """Let go of the panels and other small tables that this session keeps."""
    for key in [k for k in _held if k[0] == spark.sparkContext.applicationId]:
        _held.pop(key).unpersist()


def hundredths(column: str) -> Column:
    """An amount with two decimals as a whole number: such sums are exact, and cheap."""
    return F.round(F.col(column) * 100).cast("long")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    price = hundredths("l_extendedprice")
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    sums = lines.groupBy(F.col("l_suppkey"), F.year("l_shipdate").cast("int").alias("year")).agg(
        (F.sum(price * (100 - hundredths("l_discount"))) / 10000).alias("y"),
        F.sum("l_quantity").alias("x_l"),
        (F.sum(price * hundredths("l_tax")) / 10000).alias("x_s"),
        (F.sum(hundredths("p_retailprice")) / 100).alias("x_k"),
        (F.sum(price * hundredths("l_discount")) / 10000).alias("x_m"),
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    units = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return sums.join(units, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").cast("int").alias("unit"), F.col("s_nationkey").cast("int").alias("sid"), F.col("n_regionkey").cast("int").alias("region"), "year", *VARS
    )


def with_holes(df: DataFrame) -> DataFrame:
    """An unbalanced panel: one unit-year in eleven is missing."""
    return df.where((F.col("unit") * 7 + F.col("year")) % 11 != 0)


def dirtied(df: DataFrame) -> DataFrame:
    """The panel with planted faults: decimal slips, zeros, values under one, and identical cells."""
    code = F.col("unit") * 31 + F.col("year")
    slip = code % 97 == 0
    return df.select(
        "unit",
        "sid",
        "region",
        "year",
        F.when(slip, F.col("y") / 10000).otherwise(F.col("y")).alias("y"),
        F.when(code % 89 == 0, F.col("x_l") * 100).when(code % 83 == 1, F.lit(0.0)).otherwise(F.col("x_l")).alias("x_l"),
        F.when(code % 79 == 2, F.lit(0.5)).otherwise(F.col("x_s")).alias("x_s"),
        F.when((F.col("sid") % 5 == 0) & (F.col("year") == 1997) & (F.col("unit") % 4 != 0), F.lit(12345.0)).otherwise(F.col("x_k")).alias("x_k"),
        F.when(slip, F.col("x_m") / 10000).when(code % 73 == 3, F.lit(None).cast("double")).otherwise(F.col("x_m")).alias("x_m"),
    )


def deflator() -> Column:
    """The price index of (sid, year) as an expression."""
    return 1 + 0.03 * (F.col("year") - 1995) + F.col("sid") / F.lit(1000.0)


#: The same panels for DuckDB, as common table expressions.
PANEL_SQL = """lines AS (
 SELECT l_suppkey, l_partkey, l_shipdate, l_quantity, CAST(round(l_extendedprice*100) AS BIGINT) AS price, CAST(round(l_discount*100) AS BIGINT) AS discount, CAST(round(l_tax*100) AS BIGINT) AS tax FROM lineitem),
 panel AS (
 SELECT CAST(l_suppkey AS INT) AS unit, CAST(s_nationkey AS INT) AS sid, CAST(n_regionkey AS INT) AS region, CAST(year(l_shipdate) AS INT) AS year,
  CAST(sum(price*(100-discount)) AS DOUBLE)/10000 AS y, sum(l_quantity) AS x_l, CAST(sum(price*tax) AS DOUBLE)/10000 AS x_s,
  CAST(sum(CAST(round(p_retailprice*100) AS BIGINT)) AS DOUBLE)/100 AS x_k, CAST(sum(price*discount) AS DOUBLE)/10000 AS x_m
 FROM lines JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4)"""
HOLES_SQL = PANEL_SQL + ", holes AS (SELECT * FROM panel WHERE (unit*7+year) % 11 <> 0)"
DIRTY_SQL = PANEL_SQL + """, dirty AS (SELECT unit, sid, region, year,
 CASE WHEN (unit*31+year)%97=0 THEN y/10000 ELSE y END AS y,
 CASE WHEN (unit*31+year)%89=0 THEN x_l*100 WHEN (unit*31+year)%83=1 THEN 0.0 ELSE x_l END AS x_l,
 CASE WHEN (unit*31+year)%79=2 THEN 0.5 ELSE x_s END AS x_s,
 CASE WHEN sid%5=0 AND year=1997 AND unit%4<>0 THEN 12345.0 ELSE x_k END AS x_k,
 CASE WHEN (unit*31+year)%97=0 THEN x_m/10000 WHEN (unit*31+year)%73=3 THEN NULL ELSE x_m END AS x_m FROM panel)"""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV file under a stated schema; a byte-order mark before the first name is no matter."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)


def write_years(df: DataFrame, path: str, key: str = "year") -> None:
    """Replace only the years that ``df`` holds; the others stay as they are."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def extend_years(df: DataFrame, path: str, key: str = "year") -> DataFrame:
    """Append the years of ``df`` that the stage at ``path`` lacks, and return them."""
    there = df.sparkSession.read.parquet(path).select(key).distinct()
    new = df.join(there, key, "left_anti")
    new.repartition(key).write.mode("append").partitionBy(key).parquet(path)
    return new


def write_complete(df: DataFrame, path: str, failed: Column) -> bool:
    """Write all rows, or none if ``failed`` holds for any; whether it wrote."""
    if df.where(failed).limit(1).count():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage under ``spark.checkpoint.dir``; one machine may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stages-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage has been written whole: Spark's mark of success is there."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stage at ``path``; it is built and written only if it isn't there whole, or if forced."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def probed(df: DataFrame, key: list[str], step: float) -> DataFrame:
    """least, most and cells of a grid's key columns as the data have them; it must be regular and hold each cell once."""
    ends = [f(k).alias(f"{n}_{k}") for k in key for n, f in (("least", F.min), ("most", F.max))]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*key).alias("cells"), *ends).first()
    off = df.where(" or ".join(f"abs(({k} - {found[f'least_{k}']}) / {step} - round(({k} - {found[f'least_{k}']}) / {step})) > 1e-6" for k in key)) if found["n"] else df
    if found["n"] != found["cells"] or found["n"] and off.limit(1).count():
        raise ValueError(f"the grid of {', '.join(key)} is not regular")
    return df.agg(F.count(F.lit(1)).alias("cells"), *ends)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Headed CSV files whose rows are in order from file to file; NULL is an empty field."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def accumulate(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """Append a fit's rows (equation, term, coefficient) to the table at ``path``."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
