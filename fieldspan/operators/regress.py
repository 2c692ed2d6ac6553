"""Regressions from sums that Spark gathers: what comes to the driver is as large as the coefficients."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def moments(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sums of all products of two columns, and the row count."""
    names = list(columns)
    rows = df.select(*(by or []), *[c.alias(k) for k, c in columns.items()]).dropna()
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums)


def matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"{i}_{j}"]
    return m


def ols(df: DataFrame, y: Column, x: dict[str, Column], by: list[str]) -> list[dict]:
    """Per group: coefficients by name, n and R2. Groups are few (years); their moments are fetched."""
    columns = {"const": F.lit(1.0)} | x | {"_y": y}
    names = list(columns)[:-1]
    out = []
    for row in moments(df, columns, by).collect():
        m = matrix(row, len(columns))
        a, b, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        coef = np.linalg.lstsq(a, b, rcond=None)[0]
        total = yy - b[0] ** 2 / row["n"]
        out.append({k: row[k] for k in by} | {"n": row["n"], "r2": float(1 - (yy - coef @ b) / total) if total > 0 else math.nan, "coef": dict(zip(names, coef.tolist()))})
    return out


def translog(logs: list[str], centre: dict[str, float] | None = None) -> dict[str, Column]:
    """Logs, half squares and cross products, centred if asked."""
    v = {k: F.ln(k) - F.lit((centre or {}).get(k, 0.0)) for k in logs}
    out = dict(v)
    for i, a in enumerate(logs):
        for b in logs[i:]:
            out[f"{a}*{b}"] = v[a] * v[b] * (0.5 if a == b else 1.0)
    return out


def convergence(growth: DataFrame, years: list[int]) -> dict[str, float]:
    """Slope of dln on level with unit and year effects and errors clustered by unit.

    ``growth``: unit, year, dln, level. Unit effects go by demeaning, year effects as dummies that
    are demeaned likewise, so an unbalanced panel is exact. Years are few.
    """
    x = ["level", *[f"d{y}" for y in years[1:]]]
    rows = growth.withColumns({f"d{y}": (F.col("year") == y).cast("double") for y in years[1:]})
    mean = rows.groupBy("unit").agg(*[F.avg(c).alias(f"_{c}") for c in ["dln", *x]])
    within = rows.join(mean, "unit").select("unit", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in ["dln", *x]])
    row = moments(within, {c: F.col(c) for c in [*x, "dln"]}).first()
    if row is None or not row["n"]:
        return {"slope": math.nan, "se": math.nan, "n": 0, "units": 0}
    m = matrix(row, len(x) + 1)
    bread = np.linalg.pinv(m[:-1, :-1])
    coef = bread @ m[:-1, -1]
    left = F.col("dln") - sum((float(c) * F.col(k) for c, k in zip(coef, x)), F.lit(0.0))
    scores = within.groupBy("unit").agg(*[F.sum(F.col(k) * left).alias(k) for k in x])
    middle = matrix(moments(scores, {k: F.col(k) for k in x}).first(), len(x))
    units = scores.count()
    cov = bread @ middle @ bread * units / max(units - 1, 1)
    return {"slope": float(coef[0]), "se": float(math.sqrt(max(cov[0, 0], 0.0))), "n": int(row["n"]), "units": int(units)}


def absorbed(df: DataFrame, y: str, x: list[str], weight: str | None = None, unit_effects: bool = True) -> dict:
    """Least squares of y on x with unit effects, or a constant, errors clustered by unit.

    Unit effects go by (weighted) demeaning, so an unbalanced panel is exact as long as ``x`` holds all
    else. ``coef``, ``cov``, n and units; the constant, if there is one, comes last.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select("unit", w.alias("_w"), *[F.col(c).cast("double").alias(c) for c in (y, *x)]).dropna().where("_w > 0")
    names = list(x) if unit_effects else [*x, "const"]
    if unit_effects:
        mean = rows.groupBy("unit").agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(f"_{c}") for c in (y, *x)])
        rows = rows.join(mean, "unit").select("unit", "_w", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in (y, *x)])
    else:
        rows = rows.withColumn("const", F.lit(1.0))
    root = F.sqrt("_w")
    row = moments(rows, {c: F.col(c) * root for c in (*names, y)}).first()
    k = len(names)
    if row is None or not row["n"]:
        return {"coef": {c: math.nan for c in names}, "cov": np.full((k, k), math.nan), "n": 0, "units": 0}
    m = matrix(row, k + 1)
    bread = np.linalg.pinv(m[:-1, :-1])
    coef = bread @ m[:-1, -1]
    left = F.col(y) - sum((float(c) * F.col(n) for c, n in zip(coef, names)), F.lit(0.0))
    scores = rows.groupBy("unit").agg(*[F.sum(F.col(c) * left * F.col("_w")).alias(c) for c in names])
    middle = moments(scores, {c: F.col(c) for c in names}).first()
    units = int(middle["n"])
    cov = bread @ matrix(middle, k) @ bread * units / max(units - 1, 1)
    return {"coef": dict(zip(names, coef.tolist())), "cov": cov, "n": int(row["n"]), "units": units}


def wald(fit: dict, names: list[str]) -> tuple[float, int]:
    """(statistic, restrictions) of the hypothesis that the named coefficients are all zero."""
    at = [list(fit["coef"]).index(c) for c in names]
    b = np.array([fit["coef"][c] for c in names])
    cov = fit["cov"][np.ix_(at, at)]
    return float(b @ np.linalg.pinv(cov) @ b), int(np.linalg.matrix_rank(cov))


NEAR = 20_000  #: rows of a group that the exact part of a quantile regression looks at one by one


def _line(coef: dict[object, np.ndarray], by: str, names: list[str]) -> Column:
    """The groups' fitted values over columns of these names."""
    fit = None
    for g, b in coef.items():
        own = sum((float(v) * F.col(k) for v, k in zip(b, names)), F.lit(0.0))
        fit = F.when(F.col(by) == g, own) if fit is None else fit.when(F.col(by) == g, own)
    return fit


def _smoothed(rows: DataFrame, names: list[str], by: str, tau: float, steps: int = 8) -> dict[object, np.ndarray]:
    """Coefficients near those that minimise the check loss, by reweighted least squares; one aggregation a step."""
    coef: dict[object, np.ndarray] = {}
    for step in range(steps):
        w = F.lit(1.0)
        if coef:
            r = F.col("_y") - _line(coef, by, names)
            w = F.when(r > 0, F.lit(tau)).otherwise(F.lit(1 - tau)) / F.greatest(F.abs(r), F.lit(0.1 * 0.4**step))
        root = F.sqrt(w)
        for row in moments(rows, {k: F.col(k) * root for k in names} | {"_y": F.col("_y") * root}, [by]).collect():
            m = matrix(row, len(names) + 1)
            coef[row[by]] = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return coef


def exact_quantile(x: np.ndarray, y: np.ndarray, tau: float, start: np.ndarray, far_x: np.ndarray, far_y: float, most: int = 20_000) -> tuple[np.ndarray, float]:
    """(coefficients, duality gap) of the least check loss over rows and a sum of rows whose sides are known.

    ``far_x`` and ``far_y`` are the sums of the far rows, those above the fit times tau, those below times
    tau - 1. Equal rows are one with their number as its weight, and ties between others are broken by moving
    each y by at most 1e-10 of the largest. A vertex is a fit through as many independent rows as there are coefficients; it is optimal if
    the weights that balance its rows against all others lie within [tau - 1, tau]. Else the row whose
    weight is farthest out leaves, and the fit moves until the loss stops falling.
    """
    k = x.shape[1]
    both, times = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y = both[:, :-1], both[:, -1]
    y = y + 1e-10 * max(1.0, float(np.abs(y).max(initial=0.0))) * (np.arange(len(y)) * 0.6180339887498949 % 1 - 0.5)
    basis: list[int] = []
    span = np.zeros((0, k))
    for i in np.argsort(np.abs(y - x @ start), kind="stable").tolist():
        rest = x[i] - span.T @ (span @ x[i])
        if np.linalg.norm(rest) > 1e-9 * max(1.0, np.linalg.norm(x[i])):
            basis.append(i)
            span = np.vstack([span, rest / np.linalg.norm(rest)])
            if len(basis) == k:
                break
    if len(basis) < k:
        return start, math.nan
    at = np.array(basis)
    for _ in range(most):
        b = np.linalg.solve(x[at], y[at])
        r = y - x @ b
        r[at] = 0.0
        side = np.where(r > 0, tau, tau - 1) * times
        side[at] = 0.0
        weight = np.linalg.solve(x[at].T, -(side @ x + far_x))
        out = np.maximum(weight - tau * times[at], (tau - 1) * times[at] - weight)
        j = int(out.argmax())
        if out[j] <= 1e-10:
            break
        rising = weight[j] > tau * times[at[j]]
        unit = np.zeros(k)
        unit[j] = -1.0 if rising else 1.0
        pace = x @ np.linalg.solve(x[at], unit)
        pace[at] = 0.0
        crosses = np.flatnonzero(((r > 0) & (pace > 0)) | ((r <= 0) & (pace < 0)))
        when = r[crosses] / pace[crosses]
        order = np.argsort(when, kind="stable")
        slope = (tau * times[at[j]] - weight[j] if rising else (1 - tau) * times[at[j]] + weight[j]) + np.cumsum((times * np.abs(pace))[crosses[order]])
        stops = np.flatnonzero(slope >= 0)
        if not len(stops):
            return b, math.inf  # the far rows' sides can't hold
        at[j] = crosses[order[stops[0]]]
    loss = float(side @ r + far_y - far_x @ b)
    bound = float(side @ y + np.clip(weight, (tau - 1) * times[at], tau * times[at]) @ y[at] + far_y)
    return b, abs(loss - bound) / max(1.0, abs(loss)) + max(0.0, float(out.max()))


def quantile_fits(df: DataFrame, y: Column, x: dict[str, Column], by: str, tau: float = 0.95, near: int = NEAR, rounds: int = 12) -> dict[object, dict]:
    """Per group: ``coef`` by name that minimise the check loss, the duality ``gap``, and ``exact``.

    Reweighted least squares come near the fit. Rows far from it have a known side and enter as sums;
    the ``near`` nearest of a group, fewer where it is small, are solved exactly in a task. An aggregation
    over all rows counts those far rows whose side the new fit belies; while there are any, the next
    round looks from there, at twice as many. Only coefficients, few, are fetched. ``exact`` is false, and the
    gap NaN, where that doesn't end.
    """
    columns = {"const": F.lit(1.0)} | x
    names = list(columns)
    rows = df.select(by, *[c.alias(k) for k, c in columns.items()], y.alias("_y")).dropna().persist()
    coef = _smoothed(rows, names, by, tau)
    done: dict[object, dict] = {}
    for step in range(rounds):
        open_to = {g: b for g, b in coef.items() if g not in done}
        if not open_to:
            break
        size = near * 2**step
        own = rows.where(F.col(by).isin(list(open_to))).withColumn("_r", F.col("_y") - _line(open_to, by, names))
        counts = own.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.abs("_r"), F.array(*[F.lit(k / 1000) for k in range(1001)]), F.lit(10_000)).alias("q")).collect()
        width = None
        for g in counts:
            bound = float("inf") if g.n <= size else float(g.q[max(1, int(1000 * size / g.n))])
            width = F.when(F.col(by) == g[by], F.lit(bound)) if width is None else width.when(F.col(by) == g[by], F.lit(bound))
        own = own.withColumn("_far", F.abs("_r") > width)
        part = F.when(F.col("_r") > 0, F.lit(tau)).otherwise(F.lit(tau - 1))
        sums = own.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("_far"), part * F.col(c))), F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate([*names, "_y"])])
        start = {g: [float(v) for v in b] for g, b in open_to.items()}

        def solved(table):
            import pyarrow as pa

            g = table.column(by)[0].as_py()
            matrix_ = np.stack([table.column(c).to_numpy() for c in names], 1)
            far = np.array([table.column(f"_s{i}")[0].as_py() for i in range(len(names) + 1)])
            b, gap = exact_quantile(matrix_, table.column("_y").to_numpy(), tau, np.array(start[g]), far[:-1], far[-1])
            return pa.table({by: table.column(by)[:1], "b": pa.array([b.tolist()], pa.list_(pa.float64())), "gap": pa.array([float(gap)])})

        kind = rows.schema[by].dataType.simpleString()
        found = own.where("not _far").drop("_r", "_far").join(sums, by).groupBy(by).applyInArrow(solved, f"{by} {kind}, b array<double>, gap double").collect()
        gaps = {r[by]: r.gap for r in found}
        coef |= {r[by]: np.array(r.b) for r in found}
        after = F.col("_y") - _line({g: coef[g] for g in open_to}, by, names)
        belied = {r[by]: r.n for r in own.where(F.col("_far") & ((after > 0) != (F.col("_r") > 0))).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
        for g in open_to:
            if not belied.get(g) and gaps.get(g, math.inf) < 1e-8:
                done[g] = {"coef": dict(zip(names, coef[g].tolist())), "gap": gaps[g], "exact": True}
    rows.unpersist()
    return {g: done.get(g, {"coef": dict(zip(names, b.tolist())), "gap": math.nan, "exact": False}) for g, b in coef.items()}


def quantile_regression(df: DataFrame, y: Column, x: dict[str, Column], by: str, tau: float = 0.95) -> dict[object, dict[str, float]]:
    """Coefficients by group that minimise the check loss; NaN where no optimum is certified."""
    fits = quantile_fits(df, y, x, by, tau)
    return {g: f["coef"] if f["exact"] else dict.fromkeys(f["coef"], math.nan) for g, f in fits.items()}


def quantile_errors(df: DataFrame, y: Column, x: dict[str, Column], by: str, coef: dict[object, dict[str, float]], tau: float) -> dict[object, dict[str, float]]:
    """Robust standard errors of quantile coefficients by group.

    The density of the residuals at zero by an Epanechnikov kernel, its width by the rule of Hall and
    Sheather; each residual's side weighs its row.
    """
    columns = {"const": F.lit(1.0)} | x
    names = list(columns)
    fit = None
    for g, b in coef.items():
        line = sum((float(b[k]) * c for k, c in columns.items()), F.lit(0.0))
        fit = F.when(F.col(by) == g, line) if fit is None else fit.when(F.col(by) == g, line)
    if fit is None:
        return {}
    rows = df.select(by, *[c.alias(k) for k, c in columns.items()], y.alias("_y"), (y - fit).alias("_e")).dropna()
    normal = NormalDist()
    widths = []
    for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("sd"), F.percentile("_e", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).collect():
        z = normal.inv_cdf(tau)
        rule = r.n ** (-1 / 3) * normal.inv_cdf(0.975) ** (2 / 3) * (1.5 * normal.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
        low, high = max(tau - rule, 1e-6), min(tau + rule, 1 - 1e-6)
        widths.append((r[by], min(r.sd, (r.q[1] - r.q[0]) / 1.34) * (normal.inv_cdf(high) - normal.inv_cdf(low))))
    h = None
    for g, v in widths:
        h = F.when(F.col(by) == g, F.lit(float(v))) if h is None else h.when(F.col(by) == g, F.lit(float(v)))
    if h is None:
        return {}
    u = F.col("_e") / h
    kernel = F.when(F.abs(u) <= 1, 0.75 * (1 - u * u) / h).otherwise(F.lit(0.0))
    density = {r[by]: r.f for r in rows.groupBy(by).agg(F.avg(kernel).alias("f")).collect()}
    plain = {r[by]: matrix(r, len(names)) for r in moments(rows, {k: F.col(k) for k in names}, [by]).collect()}
    side = F.when(F.col("_e") > 0, F.lit(tau)).otherwise(F.lit(1 - tau))
    sided = {r[by]: matrix(r, len(names)) for r in moments(rows, {k: F.col(k) * side for k in names}, [by]).collect()}
    out = {}
    for g in coef:
        bread = np.linalg.pinv(plain[g])
        cov = bread @ sided[g] @ bread / max(density[g], 1e-12) ** 2
        out[g] = dict(zip(names, np.sqrt(np.maximum(np.diag(cov), 0)).tolist()))
    return out


def half_normal(n: int, m2: float, m3: float) -> dict[str, float]:
    """Variances of noise and inefficiency from the second and third moment of pooled residuals.

    A non-negative third moment leaves no inefficiency, which is reported as sigma_u 0.
    """
    if n < 3 or m3 >= 0:
        return {"sigma_u": 0.0, "sigma_v": math.sqrt(max(m2, 0.0)), "mean_u": 0.0}
    su = (m3 / (math.sqrt(2 / math.pi) * (1 - 4 / math.pi))) ** (1 / 3)
    sv2 = max(m2 - (1 - 2 / math.pi) * su * su, 0.0)
    return {"sigma_u": su, "sigma_v": math.sqrt(sv2), "mean_u": su * math.sqrt(2 / math.pi)}
