"""Stochastic frontier of a panel whose inefficiency decays with time, by maximum likelihood.

ln y = x'b + v - u h(t), h(t) = exp(-eta (t - last year of the unit)), v normal, u normal truncated at
zero, one u a unit. The likelihood needs three sums a unit: of h squared, of h times the residual, and
of the residual squared. Each round is one Spark job over the units, which returns the likelihood,
its score and the sum of the units' squared scores for a few candidate steps; only those sums, as
large as the parameters squared, come to the driver.

The pooled half-normal model is the same likelihood with each row a unit of its own, mu and eta zero;
its errors are still clustered by unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldspan.operators.regress import half_normal, matrix, moments

ROUNDS = 40
STEPS = (1.0, 0.5, 0.2, 0.05, 0.005)
TINY = 1e-7
_EXTRA = ("mu", "eta", "ln_sigma2", "logit_gamma")


class Returns(NamedTuple):
    """Returns to scale at the mean, and the test that they are constant."""

    scale: float  #: of the fit without the constraint
    error: float
    chi2: float  #: with one degree of freedom
    p: float
    bind: bool  #: whether the frontier was refitted at constant returns


class Fit(NamedTuple):
    coef: dict[str, float]  #: frontier terms, then mu, eta, ln_sigma2 and logit_gamma
    errors: dict[str, float]  #: clustered by unit
    loglik: float
    rounds: int
    model: str  #: which model the numbers are of
    returns: Returns | None = None
    converged: bool = False


def _log_phi_series(step: float = 1 / 32, low: float = -12.0, high: float = 9.0, terms: int = 8) -> np.ndarray:
    """Coefficients of the log of the normal distribution function about even places, lowest order first.

    Its slope m follows m' = -m (z + m), so that each coefficient comes of those before it.
    """
    z = low + step * np.arange(round((high - low) / step) + 1)
    half = np.array([0.5 * math.erfc(abs(v) / math.sqrt(2)) for v in z])
    log = np.where(z > 0, np.log1p(-half), np.log(half))
    m = [np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - log)]
    for k in range(terms - 2):
        before = m[k - 1] if k else 0.0
        m.append(-(z * m[k] + before + sum(m[i] * m[k - i] for i in range(k + 1))) / (k + 1))
    return np.stack([log, *(c / (k + 1) for k, c in enumerate(m))])


_SERIES = _log_phi_series()


def log_phi(z: np.ndarray) -> np.ndarray:
    """Log of the normal distribution function, far into the lower tail too."""
    z = np.asarray(z, float)
    place = np.clip(np.nan_to_num(z), -12.0, 9.0)
    at = np.rint((place + 12.0) * 32).astype(np.intp)
    off = place - (at / 32 - 12.0)
    near = _SERIES[-1][at]
    for c in _SERIES[-2::-1]:
        near = near * off + c[at]
    near = np.where(np.isnan(z), z, near)
    far = z < -12
    if not far.any():
        return near
    x = np.where(far, z, -12.0)
    tail = -x * x / 2 - np.log(-x * math.sqrt(2 * math.pi)) + np.log1p(-1 / x**2 + 3 / x**4)
    return np.where(far, tail, near)


def _mills(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - log_phi(z))


class Units:
    """Some units' rows, packed: y, x by row, years before each unit's last, and where each unit begins.

    ``pooled`` makes each row a unit of its own and fixes mu and eta at zero: they are no parameters then.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, back: np.ndarray, first: np.ndarray, pooled: bool = False):
        self.y, self.x, self.back, self.clusters, self.pooled = y, x, back, first, pooled
        self.first = np.arange(len(y)) if pooled else first
        self.n = np.diff(np.append(self.first, len(y)))

    def whole(self, theta: np.ndarray) -> np.ndarray:
        return np.insert(theta, len(theta) - 2, [0.0, 0.0]) if self.pooled else theta

    def _sums(self, theta: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.x.shape[1]
        e = self.y - self.x @ theta[:k]
        h = np.exp(np.clip(theta[k + 1] * self.back, -50, 50))
        return e, h, *(np.add.reduceat(v, self.first) for v in (h * h, h * e, e * e))

    def loglik(self, theta: np.ndarray) -> np.ndarray:
        """By unit."""
        theta = self.whole(theta)
        _, _, hh, he, ee = self._sums(theta)
        mu, s2, g = theta[-4], math.exp(min(theta[-2], 50.0)), 1 / (1 + math.exp(-max(min(theta[-1], 30.0), -30.0)))
        su2, sv2 = s2 * g, s2 * (1 - g)
        mix = sv2 + su2 * hh
        star, width = (mu * sv2 - su2 * he) / mix, np.sqrt(su2 * sv2 / mix)
        z = star / width
        return -0.5 * (self.n * math.log(2 * math.pi) + (self.n - 1) * math.log(sv2) + np.log(mix) + ee / sv2 + mu * mu / su2 - z * z) + log_phi(z) - log_phi(np.array(mu / math.sqrt(su2)))

    def scores(self, theta: np.ndarray) -> np.ndarray:
        """By unit and parameter: the derivatives of ``loglik``."""
        return self.both(theta)[1]

    def both(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likelihood by unit, and its derivatives by unit and parameter."""
        theta = self.whole(theta)
        k = self.x.shape[1]
        e, h, hh, he, ee = self._sums(theta)
        mu, s2, g = theta[-4], math.exp(min(theta[-2], 50.0)), 1 / (1 + math.exp(-max(min(theta[-1], 30.0), -30.0)))
        su2, sv2 = s2 * g, s2 * (1 - g)
        mix = sv2 + su2 * hh
        root = np.sqrt(mix * su2 * sv2)
        z = (mu * sv2 - su2 * he) / root
        lp, start = log_phi(z), np.array(mu / math.sqrt(su2))
        value = -0.5 * (self.n * math.log(2 * math.pi) + (self.n - 1) * math.log(sv2) + np.log(mix) + ee / sv2 + mu * mu / su2 - z * z) + lp - log_phi(start)
        slope = z + np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - lp)  # of z*z/2 and the log of its distribution
        at_mu = float(_mills(start))
        out = np.empty((len(self.first), k + 4))
        out[:, :k] = np.add.reduceat(self.x * e[:, None], self.first) / sv2 + (slope * su2 / root)[:, None] * np.add.reduceat(self.x * h[:, None], self.first)
        by_u = -0.5 * (hh / mix - mu * mu / su2**2) + slope * (-he / root - 0.5 * z * (hh / mix + 1 / su2)) + at_mu * mu / (2 * su2**1.5)
        by_v = -0.5 * ((self.n - 1) / sv2 + 1 / mix - ee / sv2**2) + slope * (mu / root - 0.5 * z * (1 / mix + 1 / sv2))
        out[:, -2] = (su2 * by_u + sv2 * by_v) * (theta[-2] < 50)
        out[:, -1] = s2 * g * (1 - g) * (by_u - by_v) * (abs(theta[-1]) < 30)
        if self.pooled:
            return value, np.delete(out, [k, k + 1], 1)
        out[:, k] = -mu / su2 + slope * sv2 / root - at_mu / math.sqrt(su2)
        pace = self.back * h * (np.abs(theta[k + 1] * self.back) < 50)
        mixed = su2 * 2 * np.add.reduceat(pace * h, self.first) / mix
        out[:, k + 1] = -0.5 * mixed - slope * (su2 * np.add.reduceat(pace * e, self.first) / root + 0.5 * z * mixed)
        return value, out

    def inefficiency(self, theta: np.ndarray) -> np.ndarray:
        """Expected u h(t) of each row given its unit's residuals."""
        theta = self.whole(theta)
        _, h, hh, he, _ = self._sums(theta)
        s2, g = math.exp(theta[-2]), 1 / (1 + math.exp(-theta[-1]))
        su2, sv2 = s2 * g, s2 * (1 - g)
        mix = sv2 + su2 * hh
        star, width = (theta[-4] * sv2 - su2 * he) / mix, np.sqrt(su2 * sv2 / mix)
        return h * np.repeat(star + width * _mills(star / width), self.n)


def packed(df: DataFrame, y: Column, x: dict[str, Column], year: str = "year") -> DataFrame:
    """unit and its rows (year, y, x) in order of years: as many as a unit has years."""
    row = F.struct(F.col(year).alias("year"), y.alias("y"), F.array(*[c.cast("double") for c in x.values()]).alias("x"))
    return df.select("unit", row.alias("r")).where("r.y is not null and forall(r.x, v -> v is not null)").groupBy("unit").agg(F.array_sort(F.collect_list("r")).alias("rows"))


def _units(batch: pa.RecordBatch, pooled: bool = False) -> tuple[Units, np.ndarray]:
    lists = batch.column("rows")
    flat = lists.flatten()
    off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    year = flat.field("year").to_numpy().astype(float)
    x = flat.field("x").flatten().to_numpy().reshape(len(year), -1)
    last = np.repeat(year[off[1:] - 1], np.diff(off))
    return Units(flat.field("y").to_numpy(), x, last - year, off[:-1], pooled), year


class Sums(NamedTuple):
    loglik: float
    score: np.ndarray
    outer: np.ndarray  #: of the scores of what has an inefficiency of its own
    clustered: np.ndarray  #: of the units' scores


def _summed(units: DataFrame, thetas: list[np.ndarray], pooled: bool) -> list[Sums]:
    """For each candidate the likelihood, its score and the squared scores."""
    k = len(thetas[0])
    width = 1 + k + 2 * k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(thetas), width))
        for batch in batches:
            if batch.num_rows:
                u, _ = _units(batch, pooled)
                for c, theta in enumerate(thetas):
                    value, s = u.both(theta)
                    by = np.add.reduceat(s, u.clusters) if pooled else s
                    total[c] += np.concatenate([[value.sum()], s.sum(0), (s.T @ s).ravel(), (by.T @ by).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(thetas)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["c", "v"])

    parts = units.mapInArrow(run, "c int, v array<double>").select("c", F.posexplode("v").alias("i", "v"))
    out = np.zeros((len(thetas), width))
    for c, i, v in parts.groupBy("c", "i").agg(F.sum("v")).collect():
        out[c, i] = v
    squares = out[:, k + 1 :].reshape(-1, 2, k, k)
    return [Sums(float(v[0]), v[1 : k + 1], *q) for v, q in zip(out, squares)]


def maximised(units: DataFrame, start: np.ndarray, rounds: int = ROUNDS, pooled: bool = False) -> tuple[np.ndarray, Sums, int, bool]:
    """(parameters, sums there, rounds, converged) by steps along the scores.

    The direction is the score over the squared scores; where no step gains, it is damped.
    """
    theta, damp = start, 0.0
    at = _summed(units, [theta], pooled)[0]
    for k in range(1, rounds + 1):
        ridge = damp * np.diag(np.maximum(np.diag(at.outer), 1e-12))
        step = np.linalg.lstsq(at.outer + ridge, at.score, rcond=None)[0]
        if not np.isfinite(step).all():
            break
        if at.score @ step < TINY * max(1.0, abs(at.loglik)):
            return theta, at, k, True
        tried = [theta + s * step for s in STEPS]
        found = _summed(units, tried, pooled)
        best = max(range(len(found)), key=lambda c: found[c].loglik if math.isfinite(found[c].loglik) else -math.inf)
        if math.isfinite(found[best].loglik) and found[best].loglik > at.loglik:
            theta, at = tried[best], found[best]
            damp = damp / 4 if best < 2 else max(damp, 1e-3) * 2
        elif damp > 1e4:
            break
        else:
            damp = max(damp, 1e-3) * 10
    return theta, at, rounds, False


def clustered(units: DataFrame, theta: np.ndarray, at: Sums, pooled: bool = False) -> np.ndarray:
    """Covariance: the units' squared scores between inverse second derivatives, of differences of scores."""
    k = len(theta)
    steps = [1e-4 * max(1.0, abs(v)) for v in theta]
    moved = [theta + s * d * np.eye(k)[j] for j, d in enumerate(steps) for s in (1, -1)]
    found = [v for a in range(0, len(moved), 8) for v in _summed(units, moved[a : a + 8], pooled)]
    second = np.array([(found[2 * j].score - found[2 * j + 1].score) / (2 * d) for j, d in enumerate(steps)])
    bread = np.linalg.pinv((second + second.T) / 2)
    n = units.count()
    return bread @ at.clustered @ bread * n / max(n - 1, 1)


def returns(theta: np.ndarray, cov: np.ndarray, at: list[int], bind: bool = False) -> Returns:
    """The sum of the elasticities at the places ``at``, and the test that it is one."""
    scale, var = float(theta[at].sum()), float(cov[np.ix_(at, at)].sum())
    chi2 = (scale - 1) ** 2 / var if var > 0 else math.nan
    return Returns(scale, math.sqrt(max(var, 0.0)), chi2, math.erfc(math.sqrt(chi2 / 2)), bind)


def fitted(df: DataFrame, y: Column, inputs: dict[str, Column], years: list[int], rounds: int = ROUNDS) -> tuple[Fit, DataFrame | None]:
    """The frontier of ln y on the inputs' centred logs and year effects, and the packed units.

    If the fit has increasing returns, it is refitted at constant ones: everything relative to the first
    input. If a likelihood has no maximum inside, the pooled half-normal model stands in. No row, or no
    year: no terms, model ``none``.
    """
    means = df.agg(*[F.avg(c).alias(k) for k, c in inputs.items()]).first().asDict()
    if not years or None in means.values():
        return Fit({}, {}, math.nan, 0, "none"), None
    centred = {k: c - F.lit(means[k]) for k, c in inputs.items()}
    effects = {f"y{t}": (F.col("year") == t).cast("double") for t in years[1:]}
    x = {"const": F.lit(1.0), **centred, **effects}
    at = [list(x).index(k) for k in inputs]
    units = packed(df, y, x).persist()
    fit = _fit(df, y, x, units, "time decay", rounds, at)
    if fit and fit.returns.scale > 1:
        base = next(iter(inputs))
        rel = {k: c - centred[base] for k, c in centred.items() if k != base}
        narrow = {"const": F.lit(1.0), **rel, **effects}
        again_units = packed(df, y - centred[base], narrow).persist()
        again = _fit(df, y - centred[base], narrow, again_units, "time decay, constant returns", rounds, [])
        if again:
            units.unpersist()
            again.coef[base] = 1.0 - sum(again.coef[k] for k in rel)
            return again._replace(returns=fit.returns._replace(bind=True)), again_units
        again_units.unpersist()
        fit = None
    return fit or pooled(df, y, x, units, rounds, at), units


def _start(df: DataFrame, y: Column, x: dict[str, Column]) -> tuple[np.ndarray, float]:
    """Least squares and the variance of its residuals."""
    row = moments(df, x | {"_y": y}).first()
    m = matrix(row, len(x) + 1)
    b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return b, max(float(m[-1, -1] - b @ m[:-1, -1]) / max(row["n"] - len(x), 1), 1e-8)


def _fit(df: DataFrame, y: Column, x: dict[str, Column], units: DataFrame, model: str, rounds: int, inputs: list[int]) -> Fit | None:
    """The fit with time decay, or none where the likelihood has no maximum inside."""
    b, s2 = _start(df, y, x)
    start = np.concatenate([b, [0.0, 0.0, math.log(1.5 * s2), 0.0]])
    start[0] += math.sqrt(2 / math.pi * 0.75 * s2)
    theta, at, done, ok = maximised(units, start, rounds)
    if not (ok and -12 < theta[-1] < 12 and abs(theta[-4]) < 50 * math.exp(theta[-2] / 2)):
        return None
    cov = clustered(units, theta, at)
    keys = [*x, *_EXTRA]
    errors = np.sqrt(np.maximum(np.diag(cov), 0)).tolist()
    return Fit(dict(zip(keys, theta.tolist())), dict(zip(keys, errors)), at.loglik, done, model, returns(theta, cov, inputs) if inputs else None, True)


def pooled(df: DataFrame, y: Column, x: dict[str, Column], units: DataFrame, rounds: int = ROUNDS, inputs: list[int] = ()) -> Fit:
    """The half-normal model of rows without a memory of their unit, by maximum likelihood.

    The moments of least-squares residuals give the start. Residuals that lean the wrong way leave no
    inefficiency: gamma ends next to 0, and the terms are those of least squares. ``converged`` tells
    whether the rounds were enough; if not, the terms are the best found, without errors or a test.
    """
    b, _ = _start(df, y, x)
    e = y - sum((float(v) * c for v, c in zip(b, x.values())), F.lit(0.0))
    hn = half_normal(*df.select(e.alias("e")).agg(F.count("e"), F.avg(F.pow("e", 2)), F.avg(F.pow("e", 3))).first())
    total = max(hn["sigma_u"] ** 2 + hn["sigma_v"] ** 2, 1e-12)
    g = min(max(hn["sigma_u"] ** 2 / total, 1e-6), 1 - 1e-6)
    b[0] += hn["mean_u"]
    theta, at, done, ok = maximised(units, np.concatenate([b, [math.log(total), math.log(g / (1 - g))]]), rounds, True)
    coef = dict(zip([*x, *_EXTRA], np.insert(theta, len(theta) - 2, [0.0, 0.0]).tolist()))
    if not ok:
        return Fit(coef, {}, at.loglik, done, "pooled half-normal")
    cov = clustered(units, theta, at, True)
    errors = dict(zip([*x, *_EXTRA[2:]], np.sqrt(np.maximum(np.diag(cov), 0)).tolist()))
    return Fit(coef, errors, at.loglik, done, "pooled half-normal", returns(theta, cov, list(inputs)) if inputs else None, True)


def efficiencies(fit: Fit, units: DataFrame, names: list[str]) -> DataFrame:
    """unit, year, u_hat and te = exp(-u_hat) of every packed row; ``names`` are the packed terms."""
    alone = fit.model.startswith("pooled")  # each row has an inefficiency of its own
    theta = np.array([fit.coef[k] for k in (*names, *(_EXTRA[2:] if alone else _EXTRA))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, year = _units(batch, alone)
                hat = u.inefficiency(theta)
                unit = np.repeat(batch.column("unit").to_numpy(), np.diff(np.append(u.clusters, len(year))))
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(year.astype(np.int32)), pa.array(hat), pa.array(np.exp(-hat))], ["unit", "year", "u_hat", "te"])

    return units.mapInArrow(run, "unit int, year int, u_hat double, te double")
