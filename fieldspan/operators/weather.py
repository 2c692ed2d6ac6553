"""Weather over (pixel, day) rows: degree-days, strict sums, climatology, seasons, zonal means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldspan.functions.expr import col, daily_mean_days, degree_days

BASE, HEAT = 8.0, 32.0


def growing_and_heat(df: DataFrame, tmin: str = "tmin", tmax: str = "tmax") -> DataFrame:
    """gdd and hdd of each day: degree-days above the base, those above the heat level apart."""
    low, high = degree_days(tmin, tmax, BASE), degree_days(tmin, tmax, HEAT)
    return df.withColumns({"gdd": low - high, "hdd": high})


def daily_mean(df: DataFrame, tmin: str = "tmin", tmax: str = "tmax") -> DataFrame:
    low, high = daily_mean_days(tmin, tmax, BASE), daily_mean_days(tmin, tmax, HEAT)
    return df.withColumns({"gdd_mean": low - high, "hdd_mean": high})


def strict_sum(value: Column | str, wanted: Column | int) -> Column:
    """The sum, or NULL unless as many non-NULL values as wanted are there."""
    return F.when(F.count(col(value)) == wanted, F.sum(col(value)))


def circular_smooth(df: DataFrame, pixel: str, period: str, value: str, name: str, radius: int = 3, periods: int = 24) -> DataFrame:
    """Mean over the periods up to ``radius`` away, the year's end joined to its start; NULLs are left out."""
    k = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = df.select(pixel, period, value, k.alias("_k")).select(pixel, F.pmod(F.col(period) + F.col("_k"), F.lit(periods)).cast("int").alias(period), value)
    near = spread.groupBy(pixel, period).agg(F.avg(value).alias(name))
    return df.select(pixel, period).join(near, [pixel, period])


def half_amplitude(df: DataFrame, pixel: str, value: str, alpha: float = 0.5) -> DataFrame:
    """``in_season`` for each period: at or above the minimum plus ``alpha`` of the range."""
    ends = df.groupBy(pixel).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    test = (F.col("_hi") > F.col("_lo")) & (F.col(value) >= F.col("_lo") + alpha * (F.col("_hi") - F.col("_lo")))
    return df.join(ends, pixel).withColumn("in_season", F.coalesce(test, F.lit(False))).drop("_lo", "_hi")


def peak_union(peaks: Column, radius: int = 2) -> Column:
    """Sorted months within ``radius`` of any peak month, the year being a circle."""
    near = F.transform(peaks, lambda p: F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: (F.pmod(p - 1 + k, F.lit(12)) + 1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(near)))


def zonal(values: DataFrame, bridge: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Weighted mean, plain mean and weighted sum over zones; bridge: pixel, zone, w.

    NULL values and their weights are left out; a zone without weight has a NULL weighted mean.
    """
    w = F.when(F.col(value).isNotNull(), F.col("w"))
    return values.join(bridge, "pixel").groupBy("zone", *by).agg(
        (F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted_mean"), F.avg(F.when(F.col("w") > 0, F.col(value))).alias("plain_mean"), F.sum(w * F.col(value)).alias("weighted_sum")
    )


def anomalies(df: DataFrame, value: str, keys: list[str], name: str, least: int = 3, floor: float = 1e-8) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    z = F.when((F.col("_n") >= least) & (F.col("_sd") > floor), (F.col(value) - F.col("_m")) / F.col("_sd"))
    return df.join(s, keys).withColumn(name, z).drop("_m", "_sd", "_n")


def depth_mean(layers: list[tuple[str, float]]) -> Column:
    """Mean of layers weighted by thickness; NULL if a layer is NULL."""
    total = sum(t for _, t in layers)
    terms = [F.col(c) * (t / total) for c, t in layers]
    return sum(terms[1:], terms[0])


def peaks(values: list[float], prominence: float = 0.2, most: int = 3) -> list[int]:
    """Peaks of a circular series: no lower than both neighbours, prominent, the tallest few in order of place.

    A flat top counts once, at its first point. Prominence is the fall to the higher of the two
    lowest points between the peak and any higher one on either side.
    """
    n = len(values)
    top, low = max(values), min(values)
    if not top > low:
        return []
    found = []
    for i in range(n):
        back = next((k for k in range(1, n) if values[i - k] != values[i]), None)
        ahead = next((k for k in range(1, n) if values[(i + k) % n] != values[i]), None)
        if back is None or ahead is None or values[i - back] > values[i] or values[(i + ahead) % n] > values[i] or back > 1:
            continue
        falls = []
        for step in (1, -1):
            lowest = values[i]
            for k in range(1, n):
                v = values[(i + step * k) % n]
                if v > values[i]:
                    break
                lowest = min(lowest, v)
            falls.append(values[i] - lowest)
        if min(falls) >= prominence * (top - low):
            found.append(i)
    return sorted(sorted(found, key=lambda i: (-values[i], i))[:most])


def running_order(pixel: str, order: str):
    return Window.partitionBy(pixel).orderBy(order)


def area_zonal(cells: DataFrame, cover: DataFrame, value: str, weight: str, place: list[str], by: list[str], least: float = 1e-3) -> DataFrame:
    """mean, weighted_mean and total over zones: cells count by the share of them that lies in the zone.

    Cells without a value don't count; zones with less than ``least`` cells' area of values give no row.
    """
    rows = cells.where(F.col(value).isNotNull()).join(cover, place)
    s, v, w = F.col("share"), F.col(value), F.col(weight)
    sums = rows.groupBy(*by).agg(F.sum(s).alias("_s"), F.sum(s * w).alias("_w"), F.sum(s * v).alias("total"), F.sum(s * w * v).alias("_wv"))
    return sums.where(F.col("_s") > least).select(*by, (F.col("total") / F.col("_s")).alias("mean"), (F.col("_wv") / F.nullif(F.col("_w"), F.lit(0.0))).alias("weighted_mean"), "total")
