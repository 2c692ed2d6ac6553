"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
from fieldspan.plans.catalog import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return v + 0.0
    return tuple(v) if isinstance(v, list) else v


def key(row):
    return [(v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in row]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    rel = duck.execute(ORACLES[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)


# Queries that SQL can't express: certificates, identities, or a plain recomputation of the rows.


def certified(rows):
    assert all((r.f is None) == (r.proof is None) and (r.f is None or r.f >= 0 and r.proof <= 1e-9) for r in rows)


def within(x, low, high, slack=1e-9):
    return low - slack <= x <= high + slack


def check_f02(rows, spark):
    certified(rows)
    assert rows and all(within(r.theta, 0, 1) for r in rows)
    assert all(max(r.theta for r in rows if r.t == t) > 1 - 1e-9 for t in {r.t for r in rows})


def check_f05b(rows, spark):
    assert rows and all(abs(r.lnM - r.lnEC - r.lnTC) < 1e-9 and within(r.eff_now, 0, 1) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.year, []).append(r.lnTC)
    assert all(min(v) >= -1e-9 for v in by.values())  # references only grow, so the frontier can't fall


def check_f09(rows, spark):
    by = {}
    for r in rows:
        by.setdefault(r.year, []).append((r.x_l, r.x_m))
    assert len(by) == 7
    for v in by.values():
        known = [x for _, x in sorted(v) if x is not None]
        assert len(v) == 10 and known and all(b <= a * (1 + 1e-9) for a, b in zip(known, known[1:]))


def check_f10(rows, spark):
    assert len(rows) == 7 and all(r.high >= 1.05 * r.low - 1e-9 > 0 for r in rows)


def check_f11(rows, spark):
    from fieldspan.operators import lp
    from fieldspan.plans.fitted import weather_frame

    by = {}
    for r in weather_frame(spark, DATA).collect():
        by.setdefault(r.year, []).append(r)
    want = set()
    for t, group in by.items():
        points = np.array([[r.x, r.w1, r.w2, r.y] for r in group])
        want |= {(t, group[j].unit) for j in range(len(group)) if lp.is_vertex(points, j)}
    assert {(r.year, r.unit) for r in rows} == want and len(rows) == len(want)


def check_f13(rows, spark):
    assert rows and all((r.missing == "") == (r.infeasible == 0) and (r.infeasible or r.off == 0) for r in rows)


def check_f15(rows, spark):
    certified(rows)
    assert all(within(r.theta, 0, 1) for r in rows if r.unit % 2 == 0)


def check_f22(rows, spark):
    certified(rows)
    assert len(rows) == 7 * 25


def check_e11(rows, spark):
    again = [r for r in QUERIES["e11b_convergence_table"](spark, DATA).collect() if r.model == "level, unit and year effects"]
    assert rows[0].slope == pytest.approx(again[0].coef, rel=1e-6) and rows[0].se == pytest.approx(again[0].se, rel=1e-6) and rows[0].n == again[0].n


def check_e11b(rows, spark):
    assert [r.model for r in rows].count("stages, unit effects, weighted") == 2 and all(r.se >= 0 and r.n > r.units > 0 for r in rows)
    stages = [r for r in rows if r.wald is not None]
    assert all(r.restrictions == 2 and r.wald >= max((s.coef / s.se) ** 2 for s in stages if s.se > 0) * (1 - 1e-6) for r in stages)


def check_e11c(rows, spark):
    from fieldspan.operators import frontier as O, index as I
    from fieldspan.plans.fitted import rows as holes

    assert len(rows) == 9 and all(r.se >= 0 and r.n > r.units > 0 for r in rows)
    m = O.malmquist(holes(spark, DATA), "x_m", "y").toPandas().merge(holes(spark, DATA).select("unit", "year", "y").toPandas(), on=["unit", "year"])
    dummies = lambda c, first: [(m[c] == v).to_numpy(float) for v in sorted(set(m[c]))[first:]]
    years, units = dummies("year", 1), dummies("unit", 1)
    one, level = np.ones(len(m)), np.log(m.eff_prev.to_numpy())
    fit = lambda y, x, w: np.linalg.lstsq(np.stack(x, 1) * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    by = {(r.outcome, r.model, r.term): r.coef for r in rows}
    assert by["lnM", "year effects", "level"] == pytest.approx(fit(m.lnM, [level, one, *years], one)[0], rel=1e-6)
    assert by["lnEC", "unit and year effects", "level"] == pytest.approx(fit(m.lnEC, [level, one, *years, *units], one)[0], rel=1e-6)
    ends = [I.STAGES[0][0][0], I.STAGES[0][1][0]]
    stages = [((m.year > ends[0]) & (m.year <= ends[1])).to_numpy(float), (m.year > ends[1]).to_numpy(float)]
    got = [by["lnTC", "stages, weighted", n] for n in (I.STAGES[0][1][1], I.STAGES[1])]
    assert got == pytest.approx(fit(m.lnTC, [*stages, one, *units], m.y.to_numpy())[:2], rel=1e-6, abs=1e-9)


def check_e13(rows, spark):
    assert rows[0].sigma_u >= 0 and rows[0].sigma_v >= 0 and rows[0].mean_u == pytest.approx(rows[0].sigma_u * math.sqrt(2 / math.pi))


LARGER = "/root/testdata/sf0.01"  # the smallest tables on which the panel likelihood has a maximum


def check_e13b(rows, spark):
    terms = {r.term for r in rows}
    assert {"const", "x_l", "x_s", "x_k", "x_m", "mu", "eta", "ln_sigma2", "logit_gamma", "y2001"} <= terms and len({r.model for r in rows}) == 1
    assert sum(r.coef for r in rows if r.term.startswith("x_")) <= 1 + 1e-9 or rows[0].model.startswith("pooled")
    larger = QUERIES["e13b_time_decay_frontier"](spark, LARGER).collect()
    assert larger[0].model.startswith("time decay") and all(r.se is None or r.se > 0 for r in larger)
    # no parameter gains from a small move, over all units at once
    from fieldspan.operators.panel_frontier import _units
    from fieldspan.plans.fitted import decay

    fit, units, terms = decay(spark, LARGER)
    u, _ = _units(units.toArrow().combine_chunks().to_batches()[0])
    theta = np.array([fit.coef[k] for k in (*terms, "mu", "eta", "ln_sigma2", "logit_gamma")])
    top = u.loglik(theta).sum()
    assert top == pytest.approx(fit.loglik, rel=1e-9)
    for j, t in enumerate(theta):
        for s in (1, -1):
            moved = theta.copy()
            moved[j] += s * 0.05 * max(abs(t), 0.1)
            assert u.loglik(moved).sum() < top + 1e-3


def check_e13c(rows, spark):
    (r,) = QUERIES["e13c_returns_to_scale"](spark, LARGER).collect()
    assert r.converged and r.chi2 == pytest.approx(((r.scale - 1) / r.se) ** 2) and r.p == pytest.approx(math.erfc(abs(r.scale - 1) / r.se / math.sqrt(2)), abs=1e-12)
    assert r.bind == (r.scale > 1) == r.model.endswith("constant returns")
    terms = {t.term: t.coef for t in QUERIES["e13b_time_decay_frontier"](spark, LARGER).collect()}
    assert sum(terms[k] for k in ("x_l", "x_s", "x_k", "x_m")) == pytest.approx(1.0 if r.bind else r.scale)
    assert all(x.converged for x in rows)


def check_e13d(rows, spark):
    assert rows[0].converged or all(r.se is None for r in rows)
    rows = QUERIES["e13d_pooled_likelihood"](spark, LARGER).collect()
    terms = {r.term: r.coef for r in rows}
    assert rows[0].converged and terms["mu"] == terms["eta"] == 0 and all((r.se is None) == (r.term in ("mu", "eta")) for r in rows)
    from fieldspan.plans.fitted import rows as holes

    m = holes(spark, LARGER).toPandas()
    e = np.log(m.y) - terms["const"] - sum(terms[k] * np.log(m[k]) for k in ("x_l", "x_s", "x_k", "x_m")) - m.year.map(lambda t: terms.get(f"y{t}", 0.0))
    s, g = math.exp(terms["ln_sigma2"] / 2), 1 / (1 + math.exp(-terms["logit_gamma"]))
    below = [0.5 * math.erfc(x * math.sqrt(g / (1 - g)) / s / math.sqrt(2)) for x in e]
    again = len(e) * math.log(2 / s / math.sqrt(2 * math.pi)) - (e**2).sum() / 2 / s**2 + np.log(below).sum()
    assert rows[0].loglik == pytest.approx(again, rel=1e-8)


def check_e14b(rows, spark):
    for found, data in ((rows, DATA), (QUERIES["e14b_decay_efficiency"](spark, LARGER).collect(), LARGER)):
        assert len({(r.unit, r.year) for r in found}) == len(found) and all(r.u_hat >= 0 and r.te == pytest.approx(math.exp(-r.u_hat)) for r in found)
        terms = {r.term: r.coef for r in QUERIES["e13b_time_decay_frontier"](spark, data).collect()}
        assert all(r.ln_tfp == pytest.approx(terms["const"] + terms.get(f"y{r.year}", 0.0) - r.u_hat) for r in found)
        if found[0].model.startswith("time decay"):  # a unit's inefficiency moves with exp(-eta) alone
            by = {(r.unit, r.year): r.u_hat for r in found}
            assert all(by[k[0], k[1] - 1] == pytest.approx(v * math.exp(terms["eta"]), rel=1e-6) for k, v in by.items() if (k[0], k[1] - 1) in by)


def check_e08b(rows, spark):
    assert rows and all(r.n > 0 and None not in (r.dea, r.sfa, r.solow) for r in rows)
    from fieldspan.plans.fitted import _estimators, sample

    m = _estimators(spark, DATA).toPandas()
    y = {(r.unit, r.year): r.y for r in sample(spark, DATA).collect()}
    for r in rows:  # shares are among the matched units
        g = m[m.year == r.year]
        before, now = (np.array([y[u, r.year - k] for u in g.unit]) for k in (1, 0))
        w = before / before.sum() + now / now.sum()
        for k in ("dea", "sfa", "solow"):
            v = g[k].clip(*np.quantile(g[k], [0.01, 0.99]))
            assert getattr(r, k) == pytest.approx((v * w).sum() / w.sum(), rel=1e-6, abs=1e-9)


def check_e09f(rows, spark):
    by = {r.series: r for r in rows}
    assert set(by) == {"dea", "sfa", "solow", "totals"} and all(r.least - 1e-9 <= r.mean <= r.most + 1e-9 for r in rows)
    years = QUERIES["e08b_matched_estimators"](spark, DATA).collect()
    for k in ("dea", "sfa", "solow"):
        v = 100 * np.array([r[k] for r in years])
        assert by[k].n == len(v) and by[k].sd == pytest.approx(v.std(ddof=1)) and by[k].mean == pytest.approx(v.mean())


def check_e09g(rows, spark):
    (r,) = rows
    v = np.array([x.lnM for x in QUERIES["f05b_malmquist_four_inputs"](spark, DATA).collect() if x.lnM is not None])
    assert r.n == len(v) and r.sd == pytest.approx(v.std(ddof=1)) and r.sd_trimmed == pytest.approx(v.clip(*np.quantile(v, [0.01, 0.99])).std(ddof=1))
    assert r.beyond_half == pytest.approx((abs(v) > 0.5).mean()) and r.beyond_one == pytest.approx((abs(v) > 1).mean())


def check_e12b(rows, spark):
    assert rows and all(r.gap == pytest.approx(r.dea - r.sfa) and (1 + r.dea / 100) == pytest.approx((1 + r.dea_ec / 100) * (1 + r.dea_tc / 100), rel=1e-6) for r in rows)


def check_e15b(rows, spark):
    fit = {(r.year, r.model): r.r2 for r in rows}
    assert len(fit) == 14 and all(fit[y, "translog"] >= fit[y, "cobb-douglas"] - 1e-9 for y, _ in fit)


def check_e15c(rows, spark):
    for r in rows:
        shares = [r.x_l, r.x_s, r.x_k, r.x_m]
        assert all(within(x, 0, 1) for x in shares) and within(r.all_inputs, 0, min(shares))
        assert r.model != "cobb-douglas" or set(shares) <= {0.0, 1.0}
    assert len(rows) == 14


def check_e16(rows, spark):
    by = {}
    for r in rows:
        by.setdefault(r.year, []).append((r.lx_l, r.lx_m))
    for v in by.values():
        v.sort()
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(v, v[1:]) if b[0] > a[0]]
        assert len(v) == 5 and all(x == pytest.approx(slopes[0], rel=1e-6) for x in slopes)


def check_e17(rows, spark):
    # an exact fit has at most a tenth of the units above it, and the three that it goes through beside at most nine tenths below
    assert len(rows) == 7 and all(r.exact and r.gap < 1e-9 for r in rows)
    assert all(r.above * r.n <= 0.1 * r.n + 1e-9 and r.above * r.n >= 0.1 * r.n - 3 - 1e-9 for r in rows)


def check_e16b(rows, spark):
    import duckdb as _duck

    assert len(rows) == 35 and all(r.lx_m is None or abs(r.ly - r.target) < 1e-9 for r in rows)
    inputs = ["x_l", "x_s", "x_k", "x_m"]
    con = _duck.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    from fieldspan.sources.tables import HOLES_SQL

    v = con.execute(f"WITH {HOLES_SQL} SELECT year, ln(y), {', '.join(f'ln({k})' for k in inputs)} FROM holes").fetchnumpy()
    year, ly, x = v["year"], v["ln(y)"], np.stack([v[f"ln({k})"] for k in inputs], 1)
    mid = np.median(x, 0)
    form = lambda z: np.stack([np.ones(len(z)), *z.T, *[z[:, i] * z[:, j] * (0.5 if i == j else 1) for i in range(4) for j in range(i, 4)]], 1)
    fits = {t: np.linalg.lstsq(form(x[year == t] - mid), ly[year == t], rcond=None)[0] for t in set(year.tolist())}
    if min((year == t).sum() for t in fits) >= 15:  # else the fit isn't one
        for r in rows:
            if r.lx_m is not None:
                z = np.array([[r.lx_l, mid[1], mid[2], r.lx_m]]) - mid
                assert float(form(z) @ fits[r.year]) == pytest.approx(r.target, abs=1e-6)


def check_e17b(rows, spark):
    assert len(rows) == 7
    for r in rows:
        assert r.reject_cobb_douglas == (abs(r.t) > 1.96) and r.concave == (r.concave_share > 0.9) and (r.t >= 0) == (r.curvature >= 0)
        assert min(r.e_p10, r.e_p90) - 1e-9 <= r.e_p50 <= max(r.e_p10, r.e_p90) + 1e-9


def check_e17c(rows, spark):
    assert len(rows) == 7 and all(r.rts == pytest.approx(r.labour + r.level) and r.inflation == pytest.approx(r.per_worker / r.level) for r in rows)


def check_g11(rows, spark):
    values = {}
    for r in sorted(QUERIES["g09_smoothed_climatology"](spark, DATA).collect(), key=lambda r: r.hm):
        values.setdefault(r.pixel, []).append(r.v)
    assert {r.pixel for r in rows} == set(values)
    for r in rows:
        v = values[r.pixel]
        assert len(r.peaks) <= 3 and all(v[p] >= max(v[p - 1], v[(p + 1) % len(v)]) for p in r.peaks)


def check_j09(rows, spark):
    from difflib import SequenceMatcher

    from fieldspan.plans.fitted import names

    left, dims = (x.collect() for x in names(spark, DATA))
    codes, best = {r.code for r in dims}, {}
    for a in left:
        if a.cid not in codes:
            near = [(-SequenceMatcher(None, a.name, b.gname).ratio(), b.code) for b in dims if b.prov == a.prov and b.gname[:2] == a.name[:2]]
            if near:
                best[a.cid] = min(near)
    assert {r.cid: (r.code, r.similarity) for r in rows} == {k: (c, pytest.approx(-s, abs=0.0051)) for k, (s, c) in best.items()}


def check_x02(rows, spark):
    from difflib import SequenceMatcher

    parts = {r.p_partkey: r for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    assert len(rows) == len(parts) and all(r.ratio == pytest.approx(SequenceMatcher(None, parts[r.p_partkey].p_type, parts[r.p_partkey].p_name).ratio(), abs=0.0051) for r in rows)


def check_f12(rows, spark):
    certified(rows)
    own = [r for r in rows if r.tag == "own"]
    assert len(own) == 70 and all(r.f is not None for r in own)


CHECKS = {k.removeprefix("check_"): v for k, v in list(globals().items()) if k.startswith("check_")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_of_other_queries(spark, name):
    CHECKS[name.split("_")[0]](QUERIES[name](spark, DATA).collect(), spark)


def _stands(df, node):
    """How often a node is in a query's plan, as it was put together."""
    return df._jdf.queryExecution().analyzed().toString().count(node)


def test_estimators_stand_once_in_each_reader(spark):
    """A second copy runs the programmes, or a lookup in what is kept, again for each estimator."""
    for name in ("e08b_matched_estimators", "e09f_volatility_by_estimator"):  # the rows, and the ends of their distribution
        assert _stands(QUERIES[name](spark, DATA), "FlatMapCoGroupsInPandas") <= 2, name
    assert _stands(QUERIES["e12b_gap_by_stage"](spark, DATA), "FlatMapCoGroupsInPandas") == 1


def test_references_of_programmes_are_kept(spark):
    from fieldspan.plans import fitted
    from fieldspan.sources.tables import held, release

    release(spark)
    QUERIES["f05b_malmquist_four_inputs"](spark, DATA)
    for name in ("technologies", "technologies up to a year"):
        assert held(spark, DATA, name, fitted.table).storageLevel.useDisk
