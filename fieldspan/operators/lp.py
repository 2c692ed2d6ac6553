"""Linear programmes of production frontiers, many small ones per task, each with its certificate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_EPS = 1e-9
MOST_PIVOTS = 5000
POINTS = 200  #: programmes of a task, and points of a first hull
MANY = 20_000  #: programmes of a task in a large group: they share their bases


def solve(c: np.ndarray, a_ub: np.ndarray, b_ub: np.ndarray, a_eq: np.ndarray | None = None, b_eq: np.ndarray | None = None) -> tuple[float, np.ndarray, float]:
    """max c'z with a_ub z <= b_ub, a_eq z = b_eq, z >= 0: (value, z, certificate).

    The certificate is the larger of the duality gap and the dual's violation, relative. NaN values
    mean infeasible, or that ``MOST_PIVOTS`` didn't reach an optimum; infinity, unbounded. Rows are
    scaled by their right-hand sides.
    """
    n, m1 = len(c), len(b_ub)
    m2 = 0 if b_eq is None else len(b_eq)
    rows = np.vstack([a_ub, a_eq]) if m2 else np.array(a_ub, float)
    rhs = np.concatenate([b_ub, b_eq]) if m2 else np.array(b_ub, float)
    scale = np.where(np.abs(rhs) > 0, np.abs(rhs), np.maximum(np.abs(rows).max(1), 1e-300))
    sign = np.where(rhs < 0, -1.0, 1.0)
    m = m1 + m2
    t = np.zeros((m, n + m1 + m + 1))
    t[:, :n] = rows * (sign / scale)[:, None]
    t[np.arange(m1), n + np.arange(m1)] = sign[:m1]
    t[np.arange(m), n + m1 + np.arange(m)] = 1.0
    t[:, -1] = rhs * sign / scale
    real = n + m1
    needs = np.concatenate([sign[:m1] < 0, np.ones(m2, bool)])
    basis = np.where(needs, real + np.arange(m), n + np.minimum(np.arange(m), max(m1 - 1, 0)))
    if needs.any():
        cost = np.zeros(t.shape[1])
        cost[real + np.flatnonzero(needs)] = -1.0
        if _pivot(t, basis, cost, real) != "optimal" or cost[basis] @ t[:, -1] < -1e-8:
            return np.nan, np.full(n, np.nan), np.nan
        for r in np.flatnonzero(basis >= real):  # artificials at zero leave if they can
            at = np.flatnonzero(np.abs(t[r, :real]) > 1e-7)
            if len(at):
                _step(t, basis, r, int(at[0]))
    cost = np.zeros(t.shape[1])
    cost[:n] = c
    ended = _pivot(t, basis, cost, real)
    if ended != "optimal":
        return np.inf if ended == "unbounded" else np.nan, np.full(n, np.nan), np.nan
    z = np.zeros(t.shape[1])
    z[basis] = t[:, -1]
    value = float(c @ z[:n])
    dual = (cost[basis] @ t[:, real : real + m]) * sign / scale
    gap = abs(dual @ rhs - value)
    wrong = max(0.0, float((c - dual @ rows).max(initial=0.0)), float((-dual[:m1]).max(initial=0.0)))
    return value, z[:n], max(gap, wrong) / max(1.0, abs(value))


def _step(t: np.ndarray, basis: np.ndarray, r: int, k: int) -> None:
    t[r] /= t[r, k]
    other = t[:, k].copy()
    other[r] = 0.0
    t -= np.outer(other, t[r])
    basis[r] = k


def _pivot(t: np.ndarray, basis: np.ndarray, cost: np.ndarray, real: int) -> str:
    """Largest gain first; after stalled steps the first gain, which can't cycle. How it ended."""
    stalled, before = 0, -np.inf
    for _ in range(MOST_PIVOTS):
        gain = cost[:real] - cost[basis] @ t[:, :real]
        gain[basis[basis < real]] = 0.0
        if stalled > 20:
            better = np.flatnonzero(gain > _EPS)
            if not len(better):
                return "optimal"
            k = int(better[0])
        else:
            k = int(np.argmax(gain))
            if gain[k] <= _EPS * max(1.0, np.abs(cost).max()):
                return "optimal"
        up = t[:, k] > 1e-11
        if not up.any():
            return "unbounded"
        ratio = np.where(up, t[:, -1] / np.where(up, t[:, k], 1.0), np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-14)
        _step(t, basis, int(ties[np.argmin(basis[ties])]), k)
        now = float(cost[basis] @ t[:, -1])
        stalled, before = (stalled + 1, before) if now <= before + 1e-13 else (0, now)
    return "stopped"


def frontier_value(x0: np.ndarray, x: np.ndarray, y: np.ndarray, w0: np.ndarray | None = None, w: np.ndarray | None = None) -> tuple[float, float]:
    """Most output from inputs x0 with weights summing to at most 1; w must be met exactly: (f, certificate)."""
    a = np.vstack([x.T, np.ones(len(y))])
    b = np.append(x0, 1.0)
    if w is None:
        value, _, proof = solve(y, a, b)
    else:
        value, _, proof = solve(y, a, b, w.T, w0)
    return (value, proof) if np.isfinite(value) else (np.nan, np.nan)


class Technology:
    """Programmes over one reference that differ in their inputs only: most output, weights summing to at most 1.

    Weather, if there is any, must be met exactly. Reduced costs don't depend on the inputs, so a basis that is optimal for one point is optimal for
    all points at which its weights aren't negative; it is tried on all of them at once. A point that no
    known basis fits starts from the one that bounds it best, by dual steps. A row of weights that rules one point
    out is tried on all likewise.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
        w = np.zeros((len(y), 0)) if w is None else w
        self.inputs, self.n = x.shape[1], len(y)
        rows = np.vstack([x.T, w.T, np.ones(len(y))])
        self.scale = np.maximum(np.abs(rows).max(1, initial=0.0), 1e-300)
        self.unit = max(float(np.abs(y).max(initial=0.0)), 1e-300)
        m = len(rows)
        self.exact = np.arange(self.inputs, m - 1)
        self.full = np.hstack([rows / self.scale[:, None], np.delete(np.eye(m), self.exact, 1)])
        self.cost = np.append(y / self.unit, np.zeros(self.full.shape[1] - self.n))
        self.duals = np.zeros((0, m))
        self.bases: list[np.ndarray] = []
        self.ray: np.ndarray | None = None
        if len(self.exact):
            self._first()

    def _first(self) -> None:
        """A basis that is optimal at some mix of the reference; none where every mix is degenerate."""
        bound = np.delete(np.arange(len(self.scale)), self.exact)
        for k in range(4):
            weights = 0.1 + np.random.default_rng(k).random(self.n)
            b = self.full[:, : self.n] @ (0.8 * weights / weights.sum())
            b[-1] = 1.0
            _, z, _ = solve(self.cost[: self.n], self.full[bound, : self.n], b[bound], self.full[self.exact, : self.n], b[self.exact])
            slack = b[bound] - self.full[bound, : self.n] @ z
            basis = np.concatenate([np.flatnonzero(z > 1e-9), self.n + np.flatnonzero(slack > 1e-9)])
            if len(basis) == len(b) and np.linalg.cond(self.full[:, basis]) < 1e10:
                self.bases.append(basis)
                self.duals = (self.cost[basis] @ np.linalg.inv(self.full[:, basis]))[None, :]
                return

    def _alone(self, b: np.ndarray) -> tuple[float, float]:
        """One point by the two-phase programme."""
        ref, at = self.full[:-1, : self.n].T * self.scale[:-1], b[:-1] * self.scale[:-1]
        k = self.inputs
        more = (at[k:], ref[:, k:]) if len(self.exact) else (None, None)
        return frontier_value(at[:k], ref[:, :k], self.cost[: self.n] * self.unit, *more)

    def values(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(f, certificate) at each row of inputs and weather; NaN at rows with a missing value or a negative input."""
        b = np.hstack([points, np.ones((len(points), 1))]) / self.scale
        f, proof = np.full(len(b), np.nan), np.full(len(b), np.nan)
        left = np.flatnonzero((b[:, : self.inputs] >= 0).all(1) & np.isfinite(b).all(1))
        while len(left):
            self.ray = None
            found = self._basis(b[left[0]]) if self.bases or not len(self.exact) else None
            if found is None:
                if self.ray is not None:  # beyond what two-phase programmes take for met
                    lack = -(b[left] @ self.ray) > 1e-7 * np.abs(b[left][:, self.exact] * self.ray[self.exact]).max(1)
                    if lack[0]:
                        left = left[~lack]
                        continue
                f[left[0]], proof[left[0]] = self._alone(b[left[0]])
                left = left[1:]
                continue
            inverse = np.linalg.inv(self.full[:, found])
            weights = b[left] @ inverse.T
            fits = weights.min(1) >= -_EPS / 10
            fits[0] = True
            dual = self.cost[found] @ inverse
            now = left[fits]
            value = np.maximum(weights[fits], 0.0) @ self.cost[found]
            wrong = max(0.0, float((self.cost - dual @ self.full).max()), float(-weights[fits].min()))
            f[now] = value * self.unit
            proof[now] = np.maximum(np.abs(b[now] @ dual - value), wrong) / np.maximum(np.abs(value), 1e-3)
            left = left[~fits]
        return f, proof

    def _basis(self, b: np.ndarray) -> np.ndarray | None:
        """An optimal basis for one right-hand side; None if it isn't reached."""
        n, m = self.full.shape[1], len(b)
        basis = self.bases[int((self.duals @ b).argmin())].copy() if self.bases else np.arange(n - m, n)
        for step in range(MOST_PIVOTS):
            inverse = np.linalg.inv(self.full[:, basis])
            at = inverse @ b
            dual = self.cost[basis] @ inverse
            gain = self.cost - dual @ self.full
            gain[basis] = 0.0
            if at.min() < -_EPS / 10 and gain.max() <= _EPS:
                r = int(at.argmin())
                row = inverse[r] @ self.full
                row[basis] = 0.0
                open_to = np.flatnonzero(row < -1e-11)
                if not len(open_to):
                    self.ray = inverse[r]
                    return None
                basis[r] = open_to[int((gain[open_to] / row[open_to]).argmin())]
            elif gain.max() > _EPS:
                k = int(gain.argmax()) if step < 200 else int(np.flatnonzero(gain > _EPS)[0])
                column = inverse @ self.full[:, k]
                up = column > 1e-11
                if not up.any():
                    return None
                ratio = np.where(up, np.maximum(at, 0.0) / np.where(up, column, 1.0), np.inf)
                ties = np.flatnonzero(ratio <= ratio.min() + 1e-14)
                basis[ties[int(basis[ties].argmin())]] = k
            else:
                self.bases.append(basis)
                self.duals = np.vstack([self.duals, dual])
                return basis
        return None


def isoquant(target: float, grid: np.ndarray, held: np.ndarray, x1: np.ndarray, x2: np.ndarray, others: np.ndarray, y: np.ndarray) -> list[float]:
    """Least second input that still makes ``target``, at each first input; NaN where nothing does."""
    out = []
    for g in grid:
        a = np.vstack([-y, x1, *others.T, np.ones(len(y))])
        value, _, _ = solve(-x2, a, np.concatenate([[-target, g], held, [1.0]]))
        out.append(-value if np.isfinite(value) else np.nan)
    return out


def informative_range(target: float, held: np.ndarray, x1: np.ndarray, x2: np.ndarray, others: np.ndarray, y: np.ndarray, flat: float = 1e-3, least: float = 1.05) -> tuple[float, float]:
    """First inputs between which the isoquant falls: the least that makes ``target``, and where it turns flat.

    Both ends are programmes over the same mixes: the least first input with any second input, and
    the least one whose mix needs at most ``flat`` more than the least second input of all. The right
    end is at least ``least`` times the left one. NaN where no mix makes the target.
    """
    makes, most = np.vstack([-y, *others.T, np.ones(len(y))]), np.concatenate([[-target], held, [1.0]])
    fewest = lambda cost, rows, rhs: -solve(-cost, rows, rhs)[0]
    low, floor = fewest(x1, makes, most), fewest(x2, makes, most)
    if not np.isfinite(low) or not np.isfinite(floor):
        return np.nan, np.nan
    high = fewest(x1, np.vstack([makes, x2]), np.append(most, floor * (1 + flat) + 1e-12))
    return low, max(high if np.isfinite(high) else float(x1.max()), least * low)


def is_vertex(points: np.ndarray, j: int) -> bool:
    """Whether point j is no mix, with weights of at most 1 in all, of the others; of equal points the first is."""
    same = (points == points[j]).all(1)
    if same[:j].any():
        return False
    rest = points[~same]
    if not len(rest):
        return bool((points[j] != 0).any())
    scale = np.maximum(np.abs(points).max(0), 1e-300)
    value, _, _ = solve(np.zeros(len(rest)), np.ones((1, len(rest))), np.ones(1), (rest / scale).T, points[j] / scale)
    return bool(np.isnan(value))


def _parts(rows: DataFrame, by: str, size: int, many: int | None = None) -> DataFrame:
    """by, parts: how many parts of about ``size`` rows each group takes; beyond 32 parts, parts of up to ``many`` rows."""
    n = F.count(F.lit(1))
    parts = F.ceil(n / size)
    return rows.groupBy(by).agg((F.least(parts, F.greatest(F.lit(32), F.ceil(n / many))) if many else parts).cast("int").alias("parts"))


def outer(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, directions: int = 256) -> np.ndarray:
    """False for points that make no more than a mix of the farthest points in some directions, which stay."""
    points = np.hstack([x, y[:, None]] if w is None else [x, y[:, None], w])
    sign = np.append(-np.ones(x.shape[1]), 1.0)
    spread = points.std(0)
    ways = np.random.default_rng(len(sign)).normal(size=(points.shape[1], directions))
    ways[: len(sign)] = np.abs(ways[: len(sign)]) * sign[:, None]
    seeds = np.unique(np.append(((points - points.mean(0)) / np.where(spread > 0, spread, 1.0) @ ways).argmax(0), (y / np.maximum(x.sum(1), 1e-300)).argmax()))
    f, _ = Technology(x[seeds], y[seeds], None if w is None else w[seeds]).values(x if w is None else np.hstack([x, w]))
    out = ~(f >= y * (1 - 1e-12))
    out[seeds] = True
    return out


def technology(frame: DataFrame, by: str, inputs: list[str], y: str, weather: list[str] | None = None, rounds: int = 4, size: int = MANY // 5) -> DataFrame:
    """by, inputs, weather and y of the rows that can matter to a group's frontier.

    A row goes if others of its part make as much from as little under the same weather: whatever mix it is in, they
    replace it. Each round parts anew what is left, in a quarter of the parts.
    """
    weather = weather or []
    names = [*inputs, *weather, y]
    kept = frame.select(by, *names).dropna()
    kept = kept.join(_parts(kept, by, size), by)  # the number goes with the rows, so that no round counts them again
    order, schema = kept.columns, kept.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names).drop_duplicates(names).reset_index(drop=True)
        w = rows[weather].to_numpy(float) if weather else None
        return rows.loc[outer(rows[inputs].to_numpy(float), rows[y].to_numpy(float), w), order]

    for k in range(rounds):
        part = F.pmod(F.xxhash64(*names, F.lit(k)), F.ceil(F.col("parts") / 4**k))
        kept = kept.withColumn("part", part).groupBy(by, "part").applyInPandas(run, schema)
    return kept.drop("parts")


def hull_pruned(frame: DataFrame, by: str, columns: list[str], rounds: int = 2, size: int = POINTS) -> DataFrame:
    """The rows without points that the others of a random part of their group span with the origin.

    A vertex of the whole is a vertex of its part, so no vertex goes; each round parts anew what is left.
    """
    order = frame.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(columns).reset_index(drop=True)
        points = rows[columns].to_numpy(float)
        return rows.loc[[is_vertex(points, j) for j in range(len(points))], order]

    kept, parts = frame, _parts(frame, by, size)
    for k in range(rounds):
        part = F.pmod(F.xxhash64(*columns, F.lit(k)), F.ceil(F.col("parts") / 4**k))  # later rounds see fewer points
        kept = kept.join(parts, by).withColumn("part", part).groupBy(by, "part").applyInPandas(run, frame.schema)
    return kept


def _met(asked: DataFrame, reference: DataFrame, by: str, key: list[str], parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points dealt over the parts of their group, and the reference once for each part."""
    reference = reference.select(*[F.col(c).alias(c) for c in reference.columns])
    spread = asked.join(parts, by).withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int")).drop("parts")
    return spread, reference.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def hull_vertices(frame: DataFrame, by: str, unit: str, columns: list[str]) -> DataFrame:
    """by, unit of the vertices of each group's convex hull with the origin.

    Parts of a group prune first; then a programme for each point that is left, against all that are
    left. Exact where weak disposability forbids pruning by dominance; of equal points one is a vertex.
    """
    left_over = hull_pruned(frame.select(by, unit, *columns), by, columns)
    asked, every = _met(left_over, left_over, by, [unit], _parts(frame, by, POINTS))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values([*columns, unit]).reset_index(drop=True)
        at = {u: i for i, u in enumerate(right[unit])}
        points = right[columns].to_numpy(float)
        return left.loc[[is_vertex(points, at[u]) for u in left[unit]], [by, unit]] if len(left) else left[[by, unit]]

    return asked.groupBy(by, "part").cogroup(every.groupBy(by, "part")).applyInPandas(run, f"{by} int, {unit} int")


def values(points: DataFrame, reference: DataFrame, inputs: list[str], y: str, weather: list[str] | None = None) -> DataFrame:
    """t, unit, tag, f, proof: the frontier of reference rows (t, ...) at points (t, unit, tag, ...).

    Points of one technology are dealt over tasks by their number; each gets the reference, which a
    caller prunes first: to its skyline, or by ``technology``.
    """
    weather = weather or []
    asked, ref = _met(points, reference.select("t", *inputs, *weather, y), "t", ["unit", "tag"], _parts(points, "t", POINTS, MANY))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = proof = np.full(len(left), np.nan)
        if len(right) and len(left):
            w = right[weather].to_numpy(float) if weather else None
            f, proof = Technology(right[inputs].to_numpy(float), right[y].to_numpy(float), w).values(left[[*inputs, *weather]].to_numpy(float))
        return pd.DataFrame({"t": left["t"], "unit": left["unit"], "tag": left["tag"], "f": f, "proof": proof})

    got = asked.groupBy("t", "part").cogroup(ref.groupBy("t", "part")).applyInPandas(run, "t int, unit int, tag string, f double, proof double")
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f", "proof")})


def sequential(frame: DataFrame, columns: list[str]) -> DataFrame:
    """t and the columns (input, weather, output) of a reference of all years up to t, each year pruned before it is copied on."""
    years = frame.select(F.col("year").cast("int").alias("t")).distinct()
    x, w, y = columns[:1], columns[1:-1], columns[-1]
    own = technology(frame.select("year", *columns), "year", x, y, w)
    return technology(years.join(own, F.col("year") <= F.col("t")).select("t", *columns), "t", x, y, w)


def decomposed(frame: DataFrame) -> DataFrame:
    """Growth of y/x by technology, weather, input and efficiency, from (unit, year, y, x, w1, w2).

    Eight frontier values per unit and pair of years; where some are infeasible the row names them.
    """
    ref = sequential(frame, ["x", "w1", "w2", "y"])
    old = frame.select("unit", (F.col("year") + 1).alias("year"), *[F.col(c).alias(f"{c}0") for c in ("y", "x", "w1", "w2")])
    pair = frame.join(old, ["unit", "year"])
    corners = [("A", 0, "", ""), ("B", 0, "", "0"), ("C", 0, "0", ""), ("D", 0, "0", "0"), ("E", 1, "", ""), ("F", 1, "", "0"), ("G", 1, "0", ""), ("H", 1, "0", "0")]
    asked = F.array(*[F.struct((F.col("year") - back).cast("int").alias("t"), F.concat(F.lit(tag), F.col("year").cast("string")).alias("tag"), F.col(f"x{i}").alias("x"), F.col(f"w1{j}").alias("w1"), F.col(f"w2{j}").alias("w2")) for tag, back, i, j in corners])
    points = pair.select("unit", F.explode(asked).alias("p")).select("unit", "p.*")
    got = values(points, ref, ["x"], "y", ["w1", "w2"])
    wide = got.withColumns({"letter": F.substring("tag", 1, 1), "year": F.substring("tag", 2, 9).cast("int")}).groupBy("unit", "year")
    wide = wide.pivot("letter", list("ABCDEFGH")).agg(F.max(F.when(F.col("f") > 0, F.ln("f")))).join(pair, ["unit", "year"])
    a, b, c, d, e, f, g, h = map(F.col, "ABCDEFGH")
    lack = F.concat_ws("", *[F.when(F.col(k).isNull(), k) for k in "ABCDEFGH"])
    lx, lx0, ly, ly0 = (F.ln(k) for k in ("x", "x0", "y", "y0"))
    return wide.select(
        "unit", "year", lack.alias("missing"), (lack != "").cast("int").alias("infeasible"),
        (0.5 * ((a - e) + (d - h))).alias("dT"), (0.25 * ((c - d) + (a - b) + (g - h) + (e - f))).alias("dW"),
        (lx0 - lx + 0.25 * ((a - c) + (b - d) + (e - g) + (f - h))).alias("dX"), ((ly - a) - (ly0 - h)).alias("dE"), ((ly - lx) - (ly0 - lx0)).alias("lnTFP"),
    )
