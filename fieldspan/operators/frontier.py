"""Production frontiers with one input: concave hulls, quantile frontiers, efficiency and Malmquist.

Hulls are found in two rounds: of salted parts of a group, then of what the parts leave. That is exact,
as a vertex of the whole is one of its part, and few rows are left. Skylines leave many rows where there
are several inputs; those of large groups meet in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.functions.expr import col
from fieldspan.operators import spread
from fieldspan.sources.tables import cached, stage_path

PARTS = 16
SLACK = 1e-9  #: of comparisons between points
BLOCK = 4_000  #: points of a skyline's block


def concave(x: np.ndarray, y: np.ndarray, form: str = "nirs") -> np.ndarray:
    """Places of the vertices of the smallest concave non-decreasing frontier over the points.

    ``nirs`` starts at the origin, ``vrs`` at the smallest input, ``crs`` is the best ray.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    if form == "crs":
        return np.array([int(np.argmax(y / x))])
    order = np.lexsort((-y, x))
    top: list[int] = []
    points = [(0.0, 0.0)] if form == "nirs" else []
    for i in order.tolist():
        px, py = float(x[i]), float(y[i])
        if points and (py <= points[-1][1] or px == points[-1][0]):
            continue
        while len(points) > 1 and (points[-1][1] - points[-2][1]) * (px - points[-2][0]) <= (py - points[-2][1]) * (points[-1][0] - points[-2][0]):
            points.pop()
            top.pop()
        points.append((px, py))
        top.append(i)
    return np.array(top, np.int64)


def _in_order(x: np.ndarray, y: np.ndarray, ties: list[np.ndarray]) -> np.ndarray:
    """Places from the most output on; of equal output the least inputs first, then ``ties``: only earlier points can beat later ones."""
    return np.lexsort((*ties[::-1], *x.T[::-1], x.sum(1), -y))


def beaten(x: np.ndarray, y: np.ndarray, by_x: np.ndarray, by_y: np.ndarray, slack: float = SLACK, most: int = 1 << 22) -> np.ndarray:
    """True for points that one of the others beats: as much output from as little of every input."""
    out = np.zeros(len(y), bool)
    step = max(1, most // max(1, len(by_y)))
    for a in range(0, len(y), step):
        wins = by_y[None, :] >= y[a : a + step, None] - slack
        for k in range(x.shape[1]):
            wins &= by_x[None, :, k] <= x[a : a + step, k, None] + slack
        out[a : a + step] = wins.any(1)
    return out


def skyline(x: np.ndarray, y: np.ndarray, slack: float = SLACK, ties: list[np.ndarray] | None = None, step: int = 64) -> np.ndarray:
    """True for points that no other beats; of equal points the first of ``ties`` stays."""
    order = _in_order(x, y, ties if ties is not None else [np.arange(len(y))])
    kept = np.zeros(0, np.int64)
    for a in range(0, len(order), step):
        new = order[a : a + step]
        new = new[~beaten(x[new], y[new], x[kept], y[kept], slack)] if len(kept) else new
        own: list[int] = []
        for i in new.tolist():
            if not own or not beaten(x[[i]], y[[i]], x[own], y[own], slack)[0]:
                own.append(i)
        kept = np.concatenate([kept, np.array(own, np.int64)])
    out = np.zeros(len(y), bool)
    out[kept] = True
    return out


def _two_rounds(df: DataFrame, by: list[str], choose, names: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*by, *names])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[choose(rows), [*by, *names]]

    rows = df.select(*by, *names, F.pmod(F.xxhash64(*names), F.lit(PARTS)).alias("_part"))
    return rows.groupBy(*by, "_part").applyInPandas(run, schema).groupBy(*by).applyInPandas(run, schema)


def vertices(df: DataFrame, by: list[str], x: str, y: str, form: str = "nirs", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per vertex of each group's frontier: by, x, y and the columns of ``keep``."""

    def choose(rows: pd.DataFrame) -> np.ndarray:
        found = np.zeros(len(rows), bool)
        found[concave(rows[x].to_numpy(float), rows[y].to_numpy(float), form)] = True
        return found

    return _two_rounds(df.where((F.col(x) > 0) & (F.col(y) > 0)), by, choose, [x, y, *keep])


def non_dominated(df: DataFrame, by: list[str], inputs: list[str], y: str, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The points of each group that no other beats (by, inputs, y, keep); of equal ones the first by ``keep`` stays.

    Parts of a group prune themselves first. What they leave is one block, or, in a larger group, blocks
    of neighbouring outputs: a block meets those of as much output or more whose least inputs can beat
    it, pair by pair, and points that none of them beats stay.
    """
    names = [*inputs, y, *keep]
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*by, *names])

    def choose(rows: pd.DataFrame) -> np.ndarray:
        return skyline(rows[inputs].to_numpy(float), rows[y].to_numpy(float), ties=[rows[c].to_numpy() for c in keep] or None)

    if spread.largest(df, by) <= block:
        return _two_rounds(df, by, choose, names)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[choose(rows), [*by, *names]]

    parts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / (block / 2)).alias("_parts"))
    dealt = df.select(*by, *names).join(parts, by).withColumn("_part", F.pmod(F.xxhash64(*names), F.col("_parts"))).drop("_parts")
    left = cached(df.sparkSession, stage_path(df.sparkSession, "skyline"), lambda: dealt.groupBy(*by, "_part").applyInPandas(own, schema))
    rows = spread.bucketed(left, y, by)
    before = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor((F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - 1) / (block / 2))).drop("_n")
    rows = rows.join(before, [*by, "_b"]).drop("_b")
    box = rows.groupBy(*by, "_block").agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(inputs) for n, f in (("least", F.min), ("most", F.max))])
    other = box.select(*by, F.col("_block").alias("_by"), *[F.col(f"_least{i}").alias(f"_few{i}") for i in range(len(inputs))])
    can = F.col("_by") >= F.col("_block")  # more output comes first, and equal outputs are in one block
    for i in range(len(inputs)):
        can &= F.col(f"_few{i}") <= F.col(f"_most{i}") + SLACK
    pairs = box.join(other, by).where(can).select(*by, "_block", "_by")

    def met(asked: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        if len(asked) and asked["_block"].iloc[0] == asked["_by"].iloc[0]:
            return asked.loc[~choose(asked), [*by, *names]]
        lost = beaten(asked[inputs].to_numpy(float), asked[y].to_numpy(float), against[inputs].to_numpy(float), against[y].to_numpy(float))
        return asked.loc[lost, [*by, *names]]

    asked = rows.join(pairs, [*by, "_block"])
    against = rows.withColumnRenamed("_block", "_by").join(pairs, [*by, "_by"])
    against = against.select(*[F.col(c).alias(c) for c in against.columns])  # columns of its own, as the frame meets itself
    key = [*by, "_block", "_by"]
    lost = asked.groupBy(*key).cogroup(against.groupBy(*key)).applyInPandas(met, schema).distinct()
    return left.join(lost, [*by, *names], "left_anti")


def dominators(x: np.ndarray, y: np.ndarray, strict: bool = False) -> np.ndarray:
    """How many points have as much y with as little x, each itself included; or, if ``strict``, with less x.

    In the order of x, and from the most y on, halves of growing blocks are met: the left half's points, ordered
    by y, are counted for each of the right half.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    both, at, times = np.unique(np.column_stack([x, -y]), axis=0, return_inverse=True, return_counts=True)
    n, rank = len(both), np.unique(both[:, 1], return_inverse=True)[1].ravel()
    out, place, width = times.astype(np.int64), np.arange(len(both)), 1
    while width < n:
        right = place // width % 2 == 1
        pair = place // (2 * width) * n
        left, asked = np.flatnonzero(~right), np.flatnonzero(right)
        order = left[np.argsort(pair[left] + rank[left])]
        sums, known = np.append(0, np.cumsum(times[order])), pair[order] + rank[order]
        out[asked] += sums[np.searchsorted(known, pair[asked] + rank[asked], "right")] - sums[np.searchsorted(known, pair[asked])]
        width *= 2
    if strict:
        first = np.flatnonzero(np.append(True, np.diff(both[:, 0]) != 0))
        so_far = np.cumsum(times)
        out -= so_far - np.repeat((so_far - times)[first], np.diff(np.append(first, n)))
    return out[at.ravel()]


def dominated_by(df: DataFrame, by: list[str], unit: str, x: str, y: str, most: int = 100_000, buckets: int = spread.BUCKETS) -> DataFrame:
    """unit, by and ``beaten_by``: how many rows of other units of the group have as much y with as little x, if any.

    A large group is dealt into buckets of neighbouring x, and again of neighbouring y. Rows count inside
    their bucket of x, then among fewer x inside their bucket of y; all others enter as sums over cells.
    """
    rows = df.select(unit, *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])

    def counted(key: list[str], over: str, name: str, strict: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            return group.assign(**{name: dominators(group[over].to_numpy(float), group["_y"].to_numpy(float), strict)})

        return lambda d: d.groupBy(*key).applyInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in d.schema)}, {name} long")

    if spread.largest(rows, by) <= most:
        found = counted(by, "_x", "_n", False)(rows)
    else:
        dealt = spread.bucketed(spread.bucketed(rows, "_x", by, buckets).withColumnRenamed("_b", "_bx"), "_y", by, buckets).withColumnRenamed("_b", "_by")
        cells = dealt.groupBy(*by, "_bx", "_by").agg(F.count(F.lit(1)).alias("_c"))
        grid = cells.select(*by, "_bx").distinct().join(cells.select(*by, "_by").distinct(), by).join(cells, [*by, "_bx", "_by"], "left")
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        above = grid.withColumn("_s", F.sum("_c").over(before(Window.partitionBy(*by, "_bx").orderBy(F.desc("_by")))))
        far = above.select(*by, "_bx", "_by", F.coalesce(F.sum("_s").over(before(Window.partitionBy(*by, "_by").orderBy("_bx"))), F.lit(0)).alias("_far"))
        near = counted([*by, "_by"], "_bx", "_n2", True)(counted([*by, "_bx"], "_x", "_n1", False)(dealt))
        found = near.join(far, [*by, "_bx", "_by"]).select(unit, *by, "_x", "_y", (F.col("_n1") + F.col("_n2") + F.col("_far")).alias("_n"))
    # a unit's own rows don't count
    same = F.explode(F.transform("_own", lambda r: F.struct(r["_n"].alias("_n"), F.size(F.filter("_own", lambda o: (o["_x"] <= r["_x"]) & (o["_y"] >= r["_y"]))).alias("_self"))))
    own = found.groupBy(unit, *by).agg(F.collect_list(F.struct("_x", "_y", "_n")).alias("_own")).select(unit, *by, same.alias("r"))
    return own.groupBy(unit, *by).agg(F.sum(F.col("r._n") - F.col("r._self")).alias("beaten_by")).where("beaten_by > 0")


def as_array(v: DataFrame, by: list[str], x: str, y: str, name: str = "hull") -> DataFrame:
    """A group's vertices as a sorted array of struct(x, y); a hull has few."""
    return v.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias(name))


def value(hull: Column | str, x0: Column | str, form: str = "nirs") -> Column:
    """The frontier at x0: chords between vertices, flat beyond the last; NULL below a vrs start."""
    h, at = col(hull), col(x0)
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    points = F.concat(F.array(origin), h) if form == "nirs" else h
    below, above = F.filter(points, lambda p: p["x"] <= at), F.filter(points, lambda p: p["x"] > at)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    chord = a["y"] + (b["y"] - a["y"]) * (at - a["x"]) / (b["x"] - a["x"])
    return F.when(a.isNull(), F.lit(None).cast("double")).when(b.isNull(), a["y"]).otherwise(chord)


def sequential(v: DataFrame, years: DataFrame, x: str, y: str) -> DataFrame:
    """Vertices by reference year t of all years up to t, out of yearly vertices."""
    pooled = years.select(F.col("year").alias("t")).join(v, F.col("year") <= F.col("t")).drop("year")
    return vertices(pooled, ["t"], x, y)


def malmquist(df: DataFrame, x: str, y: str) -> DataFrame:
    """unit, year, lnM, lnEC, lnTC, eff_prev, eff_now on sequential frontiers of (unit, year, x, y)."""
    rows = df.select("unit", "year", x, y)
    hulls = as_array(sequential(vertices(rows, ["year"], x, y), rows.select("year").distinct(), x, y), ["t"], x, y)
    now = rows.join(hulls.select(F.col("t").alias("year"), "hull"), "year")
    before = rows.select("unit", (F.col("year") + 1).alias("year"), F.col(x).alias("x0"), F.col(y).alias("y0"))
    old = hulls.select((F.col("t") + 1).alias("year"), F.col("hull").alias("hull0"))
    pair = now.join(before, ["unit", "year"]).join(old, "year")
    ratio = lambda yy, h, xx: F.ln(F.col(yy) / value(h, xx))
    tt, pp, pt, tp = ratio(y, "hull", x), ratio("y0", "hull0", "x0"), ratio(y, "hull0", x), ratio("y0", "hull", "x0")
    out = pair.select("unit", "year", (((pt - pp) + (tt - tp)) / 2).alias("lnM"), (tt - pp).alias("lnEC"), F.exp(pp).alias("eff_prev"), F.exp(tt).alias("eff_now"))
    return out.withColumn("lnTC", F.col("lnM") - F.col("lnEC"))


def bins_by_width(df: DataFrame, value_: str, n: int, by: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """0-based ``bin`` of n equal widths between two percentiles of each group, ends moved in."""
    q = spread.quantiles(df, value_, by, [low, high]).withColumnRenamed("q", "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    k = F.floor((F.col(value_) - lo) / F.nullif((hi - lo) / n, F.lit(0.0)))
    return df.join(q, by).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(n - 1), k.cast("int")))).drop("_q")


def quantile_points(df: DataFrame, x: str, y: str, by: list[str], alpha: float = 0.95, bins: int = 20, least: int = 30) -> DataFrame:
    """Median ln x and alpha-quantile of ln y of each bin with ``least`` rows or more."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    return quantile_of_bins(bins_by_width(rows, "lx", bins, by), [*by, "bin"], "lx", "ly", alpha).where(F.col("n") >= least)


def quantile_of_bins(rows: DataFrame, by: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """by, n, the median of x and the alpha-quantile of y; in one aggregation where no bin is too large for it."""
    if spread.largest(rows, by) <= spread.MOST:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(x).alias(x), F.percentile(y, F.lit(alpha)).alias(y))
    first, second = (spread.quantiles(rows, c, by, [p]).select(*by, F.col("q")[0].alias(c)) for c, p in ((x, 0.5), (y, alpha)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(first, by).join(second, by)


def quantile_frontier(df: DataFrame, x: str, y: str, by: list[str], alpha: float = 0.95, bins: int = 20, least: int = 30) -> DataFrame:
    """Vertices (x, y) of the concave hull, in levels, over the bins' points; few rows per group."""
    pts = quantile_points(df, x, y, by, alpha, bins, least).select(*by, F.exp("lx").alias("x"), F.exp("ly").alias("y"))
    return vertices(pts, by, "x", "y", "vrs")


def pareto_chain(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rows with less b than all that have less a (or as much, and come before)."""
    rows = spread.running(df, b, by, [a, b], "_m", "min", own=False)
    return rows.where(F.col("_m").isNull() | (F.col(b) < F.col("_m") - 1e-15)).drop("_m")


def lower_hull(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Vertices of the convex, falling lower envelope of points (a, b)."""

    def choose(rows: pd.DataFrame) -> np.ndarray:
        x, y = rows[a].to_numpy(float), rows[b].to_numpy(float)
        chain: list[int] = []
        for i in np.lexsort((y, x)).tolist():
            if chain and y[i] >= y[chain[-1]]:
                continue
            while len(chain) > 1 and (y[chain[-1]] - y[chain[-2]]) * (x[i] - x[chain[-2]]) >= (y[i] - y[chain[-2]]) * (x[chain[-1]] - x[chain[-2]]):
                chain.pop()
            chain.append(i)
        found = np.zeros(len(rows), bool)
        found[chain] = True
        return found

    return _two_rounds(df, by, choose, [a, b])
