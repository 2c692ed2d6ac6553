"""Panel cleaning in its fixed order; the order-dependent scans take one unit's series at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldspan.functions.expr import log_positive
from fieldspan.operators.panel import by_year

UP = math.log(4.0)  #: a step into a spike, up or down
PLATEAU = math.log(2.0)  #: most that years of one plateau differ
LOCAL = 5  #: rows on each side for the local median
FIRST_FREE_YEAR = 1990
DECADE_SLACK = 0.10


def unit_slips(df: DataFrame, pair: tuple[str, str], scaled: tuple[str, ...], factor: float = 10_000.0) -> DataFrame:
    """Multiply a row's values where both series of ``pair`` dip by about ``factor`` against both neighbours."""
    w = by_year()
    near = (F.col("year") - F.lag("year").over(w) == 1) & (F.lead("year").over(w) - F.col("year") == 1)

    def dip(v: str) -> Column:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        r = F.sqrt(before * after) / F.nullif(F.col(v), F.lit(0.0))
        return (F.col(v) > 0) & (before > 0) & (after > 0) & (r > factor / 5) & (r < factor * 5)

    flagged = df.withColumn("slip", F.coalesce(near & dip(pair[0]) & dip(pair[1]), F.lit(False)))
    return flagged.withColumns({v: F.when(F.col("slip"), F.col(v) * factor).otherwise(F.col(v)) for v in scaled})


def invalid_to_null(df: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """Zero and values between zero and one are missing."""
    return df.withColumns({v: F.when((F.col(v) != 0) & ~((F.col(v) > 0) & (F.col(v) < 1)), F.col(v)) for v in variables})


def snapshot(df: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"{v}_raw": F.col(v) for v in variables} | {f"{v}_imp": F.lit(False) for v in variables})


def placeholders_to_null(df: DataFrame, variable: str, group: tuple[str, ...] = ("sid", "year"), least: int = 5, share: float = 0.5) -> DataFrame:
    """NULL for the modal value of a group of ``least`` or more units when it has over ``share`` of them."""
    counts = df.where(F.col(variable).isNotNull()).groupBy(*group, variable).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_top"), F.max_by(variable, F.struct("_n", -F.col(variable))).alias("_mode"))
    bad = total.where((F.col("_all") >= least) & (F.col("_top") > share * F.col("_all"))).select(*group, "_mode")
    return df.join(bad, list(group), "left").withColumn(variable, F.when(F.col("_mode").isNull() | (F.col(variable) != F.col("_mode")), F.col(variable))).drop("_mode")


def caliber_years(df: DataFrame, variables: tuple[str, ...], step: float = 0.30, share: float = 0.35, least: int = 10, group: str = "sid") -> DataFrame:
    """(group, year, var) where many units step at once; ``strong`` if two variables or more do."""
    long = df.unpivot(["unit", group, "year"], list(variables), "var", "v").withColumn("l", log_positive("v")).where("l is not null")
    w = Window.partitionBy("unit", "var").orderBy("year")
    steps = long.withColumns({"d": F.col("l") - F.lag("l").over(w), "gap": F.col("year") - F.lag("year").over(w)}).where("gap = 1")
    found = steps.groupBy(group, "year", "var").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs("d") > step).cast("double")).alias("share")).where((F.col("n") >= least) & (F.col("share") > share))
    many = found.groupBy(group, "year").agg(F.count(F.lit(1)).alias("_v"))
    return found.join(many, [group, "year"]).withColumn("strong", F.col("_v") >= 2).drop("_v")


def level_reference(df: DataFrame, value: str, group: str = "sid") -> DataFrame:
    """Median log by (group, year)."""
    return df.groupBy(group, "year").agg(F.median(log_positive(value)).alias("ref"))


def chain_reference(df: DataFrame, value: str, group: str = "sid") -> DataFrame:
    """Median yearly log change by (group, year), cumulated from the level before the first step.

    A year without a step adds nothing; where no unit has two years in a row, the first level stands.
    """
    rows = df.select("unit", group, "year", log_positive(value).alias("l")).where("l is not null")
    w = by_year()
    steps = rows.withColumns({"d": F.col("l") - F.lag("l").over(w), "gap": F.col("year") - F.lag("year").over(w)}).where("gap = 1")
    med = steps.groupBy(group, "year").agg(F.median("d").alias("step"))
    level = rows.groupBy(group, "year").agg(F.median("l").alias("level"))
    first = med.groupBy(group).agg((F.min("year") - 1).alias("base"))
    start = level.join(first, group, "left").groupBy(group).agg(
        F.coalesce(F.max(F.when(F.col("year") == F.col("base"), F.col("level"))), F.min_by("level", "year")).alias("start"), F.coalesce(F.max("base"), F.min("year")).alias("base")
    )
    years = level.select(group, "year").join(med, [group, "year"], "left").join(start, group).where(F.col("year") >= F.col("base"))
    total = F.sum(F.coalesce("step", F.lit(0.0))).over(Window.partitionBy(group).orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    return years.select(group, "year", (F.col("start") + total).alias("ref"))


def imputed(stretches: DataFrame, panel: DataFrame, reference: DataFrame, value: str, group: str = "sid") -> DataFrame:
    """Values for the years of stretches (unit, a, b) from their anchors at a-1 and b+1.

    With the reference at both anchors and the year: the anchors' gap to it, interpolated, on top of
    it. Else log-linear between the anchors. NULL (``hold``) where an anchor is missing.
    """
    years = stretches.withColumn("year", F.explode(F.sequence("a", "b")))
    base = panel.select("unit", "year", F.col(group), F.when(F.col(value) > 0, F.col(value)).alias("v"))
    units = panel.groupBy("unit").agg(F.min(group).alias(group))
    at = lambda df, name, shift: df.select("unit", (F.col("year") + shift).alias("a" if shift > 0 else "b"), F.col("v").alias(name))
    rows = years.join(at(base, "v0", 1), ["unit", "a"], "left").join(at(base, "v3", -1), ["unit", "b"], "left").join(units, "unit")
    ref = lambda name, year: reference.select(group, F.col("year").alias(year), F.col("ref").alias(name))
    rows = rows.withColumns({"t0": F.col("a") - 1, "t3": F.col("b") + 1})
    rows = rows.join(ref("r0", "t0"), [group, "t0"], "left").join(ref("r3", "t3"), [group, "t3"], "left").join(ref("r", "year"), [group, "year"], "left")
    w = (F.col("year") - F.col("t0")) / (F.col("t3") - F.col("t0"))
    l0, l3 = F.ln("v0"), F.ln("v3")
    d0, d3 = l0 - F.col("r0"), l3 - F.col("r3")
    shaped = F.col("r") + d0 + (d3 - d0) * w
    has = F.col("v0").isNotNull() & F.col("v3").isNotNull()
    full = shaped.isNotNull()
    out = F.when(has, F.exp(F.when(full, shaped).otherwise(l0 + (l3 - l0) * w)))
    method = F.when(~has, "hold").when(full, "reference").otherwise("log-linear")
    return rows.select("unit", "year", out.alias("imputed"), method.alias("method"))


def drop_empty_units(df: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """Units without any value in some variable go."""
    kept = df.groupBy("unit").agg(*[F.count(v).alias(f"_{v}") for v in variables])
    for v in variables:
        kept = kept.where(F.col(f"_{v}") > 0)
    return df.join(kept.select("unit"), "unit", "left_semi")


def low_backstop(df: DataFrame, variable: str, part: float = 1000.0) -> DataFrame:
    """NULL for positive values under the unit's positive median over ``part``."""
    m = df.where(F.col(variable) > 0).groupBy("unit").agg(F.median(variable).alias("_m"))
    low = (F.col(variable) > 0) & (F.col(variable) < F.col("_m") / part)
    return df.join(m, "unit", "left").withColumns({"low": F.coalesce(low, F.lit(False)), variable: F.when(~F.coalesce(low, F.lit(False)), F.col(variable))}).drop("_m")


# Scans of one unit's series


class Spike(NamedTuple):
    first: int  #: places of the stretch's first and last year
    last: int
    level: float  #: median log near the stretch, itself among the values
    off: float  #: distance of the stretch's median log from it
    anchors: float  #: distance of the two anchors' median


def _windows(series: np.ndarray, before: int, width: int, n: int) -> np.ndarray:
    """A row per place: the ``width`` values from ``before`` places earlier on, NaN beyond the ends."""
    padded = np.concatenate([np.full(before, math.nan), series, np.full(width, math.nan)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[:n]


def _medians(windows: np.ndarray) -> np.ndarray:
    """Row medians of the values that are there; NaN where none is."""
    there = np.sort(windows, 1)  # NaN comes last
    n = np.isfinite(there).sum(1)
    row, middle = np.arange(len(there)), np.maximum(n - 1, 0)
    return (there[row, middle // 2] + there[row, (middle + 1) // 2]) / 2 if there.shape[1] else np.full(len(there), math.nan)


class Judged(NamedTuple):
    """Stretches of one length, by their first place."""

    level: np.ndarray
    off: np.ndarray
    anchors: np.ndarray
    counts: np.ndarray  #: farther from the local level than the anchors, or under five values near


def judged(logs: np.ndarray, length: int, width: int = LOCAL) -> Judged:
    """What settles the stretches of ``length`` years that begin at each place; the first and last places have no anchors."""
    n = len(logs)
    near = _windows(logs, width, 2 * width + length, n)
    level = _medians(near)
    off = np.abs(_medians(_windows(logs, 0, length, n)) - level)
    ends = _windows(logs, 1, length + 2, n)[:, [0, -1]]
    anchors = np.abs(ends.mean(1) - level)
    return Judged(level, off, anchors, (np.isfinite(near).sum(1) < 5) | (off > anchors))


def spikes(years: np.ndarray, values: np.ndarray, up: float = UP, down: float = UP, plateau: float = PLATEAU, width: int = LOCAL) -> list[Spike]:
    """Stretches of one to three years that jump away and come back.

    Left to right, the shortest stretch that fits first; the search goes on behind its last year. All
    years from anchor to anchor are consecutive with positive values, steps inside a stretch are
    small, the steps into and out of it exceed ``up`` (or ``down``, if it lies below), and ``judged`` counts it.
    """
    n = len(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        logs = np.where(values > 0, np.log(np.where(values > 0, values, 1.0)), math.nan)
    stepped = np.where(np.diff(years) == 1, np.diff(logs), math.nan)  # NaN where a year or a value is missing
    step = _windows(stepped, 1, 4, n)  # into a place, and the three after
    verdicts = {k: judged(logs, k, width) for k in (1, 2, 3)}
    length = np.zeros(n, np.int64)
    for k in (3, 2, 1):
        into, out = step[:, 0], step[:, k]
        least = np.where(into > 0, up, down)
        small = (np.abs(step[:, 1:k]) < plateau).all(1)
        fits = small & (np.sign(into) * np.sign(out) < 0) & (np.abs(into) > least) & (np.abs(out) > least)
        length[fits & verdicts[k].counts] = k
    found: list[Spike] = []
    behind = 0
    for i in np.flatnonzero(length).tolist():
        if i >= behind:
            k = int(length[i])
            v = verdicts[k]
            found.append(Spike(i, i + k - 1, float(v.level[i]), float(v.off[i]), float(v.anchors[i])))
            behind = i + k
    return found


def leading_run(years: np.ndarray, values: np.ndarray, mode: str = "decimal", before: int = FIRST_FREE_YEAR, step: float = UP) -> tuple[np.ndarray, float, str]:
    """(places of off years, factor, action) of a run at the start that is on another scale.

    Eight positive values are needed. Each early step over ``step`` may begin the core: its level is
    the median of the core's first five values, off years are earlier ones farther than ``step`` from
    it, and the first year must be one of them. The last step that fits counts. The factor is the ratio
    of the medians of core and off years; ``decimal`` takes it only near a power of ten, and that power.
    """
    at = np.flatnonzero(np.isfinite(values) & (values > 0))
    nothing = np.zeros(0, np.int64), math.nan, "keep"
    if mode == "keep" or len(at) < 8:
        return nothing
    v = values[at]
    logs, places = np.log(v), np.arange(len(v))
    core = _medians(_windows(v, 0, 5, len(v)))
    early = (places >= 1) & (places <= min(np.count_nonzero(years[at] < before), len(v) - 3))
    far = (np.abs(logs[None, :] - np.log(core)[:, None]) > step) & (places[None, :] < places[:, None])  # a row per core's start
    begins = early & (np.abs(np.diff(logs, prepend=logs[0])) > step) & far[:, 0]
    if not begins.any():
        return nothing
    start = int(places[begins].max())
    off = np.flatnonzero(far[start])
    factor = float(core[start] / np.median(v[off]))
    power = round(math.log10(factor))
    if mode == "decimal":
        factor = 10.0**power if abs(math.log10(factor) - power) <= DECADE_SLACK else math.nan
    keeps = mode != "na" and factor == factor
    return at[off], factor if keeps else math.nan, "rescale" if keeps else "null"


def by_unit(df: DataFrame, columns: list[str], scanned: Callable[[int, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``scanned`` gives for each unit's columns in order of years; nulls are NaN.

    Units are sorted within partitions and read one after another; a task holds one unit at a time.
    """
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        unit, out = None, []

        def done() -> None:
            if unit is not None:
                out.extend(scanned(unit, {c: np.concatenate(x) for c, x in held.items()}))
            for x in held.values():
                x.clear()

        for batch in batches:
            units = batch.column("unit").to_numpy()
            data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            cuts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])) if len(units) else []
            for a, b in zip(cuts, [*cuts[1:], len(units)]):
                if units[a] != unit:
                    done()
                    unit = int(units[a])
                for c in columns:
                    held[c].append(data[c][a:b])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)

    rows = df.where("unit is not null").select("unit", *columns)
    return rows.repartition("unit").sortWithinPartitions("unit", "year").mapInArrow(run, schema)


def scan(df: DataFrame, variables: tuple[str, ...], up: float = UP, down: float = UP) -> DataFrame:
    """Spike stretches of every unit and variable: unit, var, start, end, length, and what settled
    them: the local level and the distances of stretch and anchors from it."""

    def one(unit: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        years = rows["year"]
        return [(unit, v, int(years[s.first]), int(years[s.last]), s.last - s.first + 1, s.level, s.off, s.anchors) for v in variables for s in spikes(years, rows[v].astype(float), up, down)]

    return by_unit(df, ["year", *variables], one, "unit int, var string, start int, end int, length int, level double, off double, anchors double")


def spliced(df: DataFrame, detect: str, also: tuple[str, ...] = (), mode: str = "decimal", before: int = FIRST_FREE_YEAR) -> DataFrame:
    """unit, year, var, action, factor, value_before, value_after of every value a leading run changes.

    The run is found in ``detect``, a nominal series say; its years change there and in ``also``, by one factor.
    """

    def one(unit: int, rows: dict[str, np.ndarray]) -> list[tuple]:
        off, factor, action = leading_run(rows["year"], rows[detect].astype(float), mode, before)
        scaled = action == "rescale"
        out = []
        for var in (detect, *also):
            for k, value in zip(off.tolist(), rows[var][off].astype(float).tolist()):
                known = value == value
                out.append((unit, int(rows["year"][k]), var, action, factor if scaled else None, value if known else None, value * factor if scaled and known else None))
        return out

    return by_unit(df, ["year", detect, *also], one, "unit int, year int, var string, action string, factor double, value_before double, value_after double")


def spliced_in(df: DataFrame, found: DataFrame) -> DataFrame:
    """The series with the values that ``spliced`` gives; those it couldn't rescale are NULL."""
    changed = found.groupBy("unit", "year").pivot("var", [c for c in df.columns if c not in ("unit", "year")])
    new = changed.agg(F.first(F.struct("value_after")))
    names = [c for c in new.columns if c not in ("unit", "year")]
    joined = df.join(new.select("unit", "year", *[F.col(c).alias(f"_{c}") for c in names]), ["unit", "year"], "left")
    return joined.select(*[F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}.value_after")).alias(c) if c in names else F.col(c) for c in df.columns])
