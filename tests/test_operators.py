"""Hand-made cases of the operators."""

import math

import numpy as np
import pytest

from fieldspan.functions.expr import degree_days, significant, stage
from fieldspan.operators import cleaning as C, crosswalk as X, frontier as O, index as I, lp, panel as P, regress as R, weather as W
from pyspark.sql import functions as F


def test_degree_day_branches(spark):
    rows = spark.createDataFrame([(0.0, 8.0), (10.0, 20.0), (8.0, 8.0), (5.0, 35.0), (None, 9.0)], "lo double, hi double")
    got = [r[0] for r in rows.select(degree_days("lo", "hi", 8.0)).collect()]
    assert got[:3] == [0.0, 7.0, 0.0] and got[4] is None
    turn = math.asin((8 - 20) / 15)
    assert got[3] == pytest.approx(((20 - 8) * (math.pi / 2 - turn) + 15 * math.cos(turn)) / math.pi)


def test_growing_plus_heat_is_all(spark):
    r = W.growing_and_heat(spark.createDataFrame([(5.0, 35.0)], "tmin double, tmax double")).withColumn("all", degree_days("tmin", "tmax", 8.0)).first()
    assert r["gdd"] + r["hdd"] == pytest.approx(r["all"]) and r["hdd"] > 0


def test_peaks():
    wave = lambda k: [math.cos(2 * math.pi * k * i / 24) for i in range(24)]
    assert W.peaks(wave(1)) == [0]
    assert W.peaks(wave(2)) == [0, 12]
    assert len(W.peaks(wave(3))) == 3
    assert W.peaks([1.0] * 24) == []
    assert W.peaks([0, 1, 1, 0] + [0] * 20) == [1]


def test_strict_sum_needs_every_day(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, None)], "k int, v double")
    got = dict(rows.groupBy("k").agg(W.strict_sum("v", 2)).collect())
    assert got == {1: 3.0, 2: None}


def test_gap_guard(spark):
    rows = spark.createDataFrame([(1, 1987, 1.0), (1, 1993, 2.0), (1, 1994, 4.0)], "unit int, year int, v double")
    assert [(r["year"], r["d"]) for r in P.adjacent_change(rows, "v").collect()] == [(1994, 2.0)]


def test_stage_and_digits(spark):
    r = spark.range(1).select(stage(F.lit(1998), ((1997, "a"), (1999, "b")), "c").alias("s"), significant(F.lit(123456.0), 3).alias("d")).first()
    assert (r["s"], r["d"]) == ("b", 123000.0)


def test_nirs_hull():
    x, y = np.array([2.0, 4.0]), np.array([4.0, 5.0])
    assert O.concave(x, y).tolist() == [0, 1]
    f = lambda v: lp.frontier_value(np.array([v]), x[:, None], y)[0]
    assert [f(v) for v in (1.0, 2.0, 3.0, 5.0)] == pytest.approx([2.0, 4.0, 4.5, 5.0])
    assert O.concave(x, y, "crs").tolist() == [0]
    assert O.concave(np.zeros(0), np.zeros(0)).tolist() == []


def test_relational_value_equals_programme(spark):
    rng = np.random.default_rng(4)
    pts = [(1, int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(1, 9, (60, 2)))]
    df = spark.createDataFrame(pts, "year int, unit int, x double, y double")
    h = O.as_array(O.vertices(df, ["year"], "x", "y"), ["year"], "x", "y")
    got = {r["unit"]: r["f"] for r in df.join(h, "year").select("unit", O.value("hull", "x").alias("f")).collect()}
    x, y = np.array([p[2] for p in pts])[:, None], np.array([p[3] for p in pts])
    for _, u, a, _ in pts:
        f, proof = lp.frontier_value(np.array([a]), x, y)
        assert got[u] == pytest.approx(f, rel=1e-9) and proof < 1e-9


def test_pruning_changes_no_value():
    rng = np.random.default_rng(5)
    x, y = rng.uniform(1, 9, (120, 3)), rng.uniform(1, 9, 120)
    keep = O.skyline(x, y)
    assert 0 < keep.sum() < 120
    for p in x[:20]:
        assert lp.frontier_value(p, x, y)[0] == pytest.approx(lp.frontier_value(p, x[keep], y[keep])[0], rel=1e-9)


def test_weak_disposability_can_be_infeasible():
    x, w, y = np.array([[1.0], [2.0]]), np.array([[1.0, 1.0], [2.0, 1.0]]), np.array([1.0, 3.0])
    assert lp.frontier_value(np.array([2.0]), x, y, np.array([1.0, 1.0]), w)[0] == pytest.approx(1.0)
    assert math.isnan(lp.frontier_value(np.array([2.0]), x, y, np.array([5.0, 1.0]), w)[0])


def test_hull_prune_keeps_values(spark):
    rng = np.random.default_rng(8)
    pts = rng.uniform(1, 3, (40, 4))
    pts[30:] = pts[:10] * 0.5 + pts[10:20] * 0.5
    rows = [(1, i, *map(float, p)) for i, p in enumerate(pts)]
    kept = sorted(r.unit for r in lp.hull_vertices(spark.createDataFrame(rows, "year int, unit int, x double, w1 double, w2 double, y double"), "year", "unit", ["x", "w1", "w2", "y"]).collect())
    assert 4 < len(kept) < 40 and not set(kept) & set(range(30, 40))
    for p in pts[:15]:
        every, few = (lp.frontier_value(p[:1], q[:, :1], q[:, 3], p[1:3], q[:, 1:3])[0] for q in (pts, pts[kept]))
        assert every == pytest.approx(few, rel=1e-8)


def test_parts_prune_no_vertex(spark):
    rng = np.random.default_rng(9)
    pts = rng.uniform(1, 3, (90, 4))
    rows = [(1, i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "year int, unit int, x double, w1 double, w2 double, y double")
    cols = ["x", "w1", "w2", "y"]
    vertices = {i for i in range(90) if lp.is_vertex(pts, i)}
    kept = {r.unit for r in lp.hull_pruned(df, "year", cols, rounds=3, size=12).collect()}
    assert vertices <= kept < set(range(90))
    assert {r.unit for r in lp.hull_vertices(df, "year", "unit", cols).collect()} == vertices


def test_a_programme_that_does_not_end_has_no_value(monkeypatch):
    x, y = np.array([[1.0, 2.0], [2.0, 1.0], [3.0, 3.0]]), np.array([1.0, 1.5, 2.0])
    assert lp.frontier_value(np.array([2.0, 2.0]), x, y)[1] < 1e-9
    monkeypatch.setattr(lp, "MOST_PIVOTS", 1)
    assert math.isnan(lp.frontier_value(np.array([2.0, 2.0]), x, y)[0])


def test_technology_equals_single_programmes():
    rng = np.random.default_rng(12)
    for n, k in ((1, 1), (40, 1), (300, 4), (150, 3)):
        x = rng.lognormal(size=(n, k)) * np.array([1.0, 1e6, 1e-3, 50.0])[:k]
        y = 1e5 * np.exp(0.7 * np.log(x / x.mean(0)).mean(1) + 0.2 * rng.normal(size=n))
        x[: n // 10] = x[n // 10 : 2 * (n // 10)]  # repeated and tied points
        points = np.vstack([x, x * rng.uniform(0.2, 3, (n, k)), np.zeros((1, k)), x[:1] * 1e6])
        f, proof = lp.Technology(x, y).values(points)
        want = np.array([lp.frontier_value(p, x, y)[0] for p in points])
        assert np.allclose(f, want, rtol=1e-9, atol=1e-6) and proof.max() < 1e-9
    f, proof = lp.Technology(x, y).values(np.array([[1.0, np.nan, 1.0], [-1.0, 1.0, 1.0]]))
    assert np.isnan(f).all() and np.isnan(proof).all()


def test_informative_range():
    x1, x2, y = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0])
    low, high = lp.informative_range(1.0, np.zeros(0), x1, x2, np.zeros((3, 0)), y)
    # on the chord from (2, 2) to (4, 1), 1.001 of the second input needs 3.998 of the first
    assert low == pytest.approx(1.0, abs=1e-9) and high == pytest.approx(3.998, abs=1e-6)
    rng = np.random.default_rng(8)
    x, out = rng.uniform(1, 5, (30, 3)), rng.uniform(1, 2, 30)
    low, high = lp.informative_range(1.2, np.array([4.0]), x[:, 0], x[:, 1], x[:, 2:], out)
    at = lambda g: lp.isoquant(1.2, np.array([g]), np.array([4.0]), x[:, 0], x[:, 1], x[:, 2:], out)[0]
    assert math.isnan(at(low * 0.9999)) and at(low * 1.0001) > 0 and at(high * 1.0001) <= at(5.0) * 1.001 + 1e-9
    assert high == pytest.approx(1.05 * low) or at(high * 0.999) > at(5.0) * 1.001
    assert math.isnan(lp.informative_range(2.0, np.zeros(0), x1, x2, np.zeros((3, 0)), y)[0])


def test_decomposition_identity(spark):
    rng = np.random.default_rng(6)
    rows = [(u, t, float(a), float(b), float(c), float(d)) for u in range(12) for t in (1, 2, 3) for a, b, c, d in [rng.uniform(1, 3, 4)]]
    out = lp.decomposed(spark.createDataFrame(rows, "unit int, year int, y double, x double, w1 double, w2 double")).collect()
    assert len(out) == 24
    for r in out:
        assert (r["missing"] == "") == (r["infeasible"] == 0)
        if not r["infeasible"]:
            assert r["dT"] + r["dW"] + r["dX"] + r["dE"] == pytest.approx(r["lnTFP"], abs=1e-8)


def test_isoquant_chain(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 6.0), (1, 3.0, 2.0), (1, 4.0, 1.0)], "g int, a double, b double")
    assert (2.0, 6.0) not in [(r["a"], r["b"]) for r in O.pareto_chain(df, ["g"], "a", "b").collect()]


def test_spikes():
    years = np.arange(1990, 2002)
    flat = np.full(12, 100.0)
    one, two = flat.copy(), flat.copy()
    one[5], two[5:7] = 1.0, (900.0, 1000.0)
    places = lambda y, v: [(s.first, s.last) for s in C.spikes(y, np.array(v, float))]
    assert places(years, one) == [(5, 5)]
    assert places(years, two) == [(5, 6)]
    assert places(years, flat) == []
    gone = years.copy()
    gone[6:] += 1
    assert places(gone, one) == []
    # the search goes on at the end anchor, and thresholds differ by direction
    assert places(years, [100, 100, 100, 1, 100, 1, 100, 100, 100, 100, 100, 100]) == [(3, 3), (5, 5)]
    assert C.spikes(years, one, down=np.log(200.0)) == [] and len(C.spikes(years, one, up=np.log(200.0))) == 1


def test_arbiter_keeps_good_years_between_bad_ones():
    years = np.arange(1997, 2009)
    v = np.array([94000, 93500, 94500, 95300, 19534, 98287, 113000, 15172, 84083, 94300, 94200, 94600], float)
    found = C.spikes(years, v)
    assert [(years[s.first], years[s.last]) for s in found] == [(2001, 2001), (2004, 2004)]
    kept = C.judged(np.log(v), 2)
    assert not kept.counts[5] and kept.off[5] < kept.anchors[5] and all(s.off > s.anchors for s in found)
    assert kept.level[5] == pytest.approx(np.median(np.log(v[:12]))) and C.judged(np.log(v[3:7]), 1).counts[1]


def test_leading_run():
    years = np.arange(1981, 1995)
    v = np.full(14, 70000.0)
    v[:3] = (7.0, 7.1, 7.2)
    at, factor, action = C.leading_run(years, v)
    assert at.tolist() == [0, 1, 2] and factor == 10000.0 and action == "rescale"
    v[:3] = (300.0, 310.0, 320.0)
    assert C.leading_run(years, v)[2] == "null"
    assert C.leading_run(years[:6], v[:6])[2] == "keep"
    mixed = np.array([500, 192, 100003, 369, 31718, *[60000.0] * 9])
    assert C.leading_run(years, mixed)[0].tolist() == [0, 1, 3]
    # a later jump that doesn't fit doesn't end the search; odd medians are of values, not logs
    late = np.array([1.0, *[100.0] * 5, *[1.0] * 6])
    at, factor, action = C.leading_run(years[:12], late)
    assert at.tolist() == [0] and factor == 100.0 and action == "rescale"


def test_splice_changes_both_series(spark):
    rows = [(1, 1981 + i, 7.0 if i < 3 else 70000.0, 3.5 if i < 3 else 35000.0 if i != 5 else None) for i in range(12)] + [(2, 1981 + i, 300.0 if i < 3 else 70000.0, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "unit int, year int, nominal double, real double")
    found = C.spliced(df, "nominal", ("real",))
    assert {(r.unit, r.year, r["var"], r.value_after) for r in found.collect()} == {(1, 1981 + i, v, x) for i in range(3) for v, x in (("nominal", 70000.0), ("real", 35000.0))} | {(2, 1981 + i, v, None) for i in range(3) for v in ("nominal", "real")}
    out = {(r.unit, r.year): (r.nominal, r.real) for r in C.spliced_in(df, found).collect()}
    assert out[1, 1982] == (70000.0, 35000.0) and out[1, 1986] == (70000.0, None) and out[2, 1981] == (None, None) and out[2, 1990] == (70000.0, 1.0) and len(out) == 24


def test_scans_of_units_that_lie_in_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(u, 1990 + t, 1.0 if t == u % 5 + 3 else 100.0) for u in range(30) for t in range(12)] + [(31, 1990, None), (None, 1991, 5.0)]
        df = spark.createDataFrame(rows, "unit int, year int, v double").repartition(4)
        got = sorted((r.unit, r.start, r.end) for r in C.scan(df, ("v",)).collect())
        assert got == [(u, 1993 + u % 5, 1993 + u % 5) for u in range(30)]
        assert C.scan(df.where("unit < 0"), ("v",)).count() == C.spliced(df.where("unit < 0"), "v").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unit_slip_needs_both_series(spark):
    rows = [(1, 2000, 150000.0, 90000.0), (1, 2001, 15.0, 9.0), (1, 2002, 150000.0, 90000.0), (2, 2000, 150000.0, 90000.0), (2, 2001, 15.0, 90000.0), (2, 2002, 150000.0, 90000.0)]
    df = spark.createDataFrame(rows, "unit int, year int, y double, m double")
    got = {(r["unit"], r["year"]): r["y"] for r in C.unit_slips(df, ("y", "m"), ("y", "m")).collect()}
    assert got[1, 2001] == 150000.0 and got[2, 2001] == 15.0


def test_placeholder(spark):
    rows = [(u, 1, 2000, 5.0 if u < 4 else float(u + 10)) for u in range(6)] + [(u, 2, 2000, 5.0) for u in range(4)]
    got = C.placeholders_to_null(spark.createDataFrame(rows, "unit int, sid int, year int, v double"), "v").collect()
    assert sorted(r["v"] is None for r in got if r["sid"] == 1) == [False, False, True, True, True, True]
    assert all(r["v"] == 5.0 for r in got if r["sid"] == 2)


def test_missing_anchor_holds(spark):
    df = spark.createDataFrame([(1, 1, 2000, 10.0), (1, 1, 2001, 99.0), (1, 1, 2002, 40.0), (2, 1, 2001, 99.0), (2, 1, 2002, 5.0)], "unit int, sid int, year int, v double")
    s = spark.createDataFrame([(1, 2001, 2001), (2, 2001, 2001)], "unit int, a int, b int")
    empty = spark.createDataFrame([], "sid int, year int, ref double")
    got = {r["unit"]: (r["imputed"], r["method"]) for r in C.imputed(s, df, empty, "v").collect()}
    assert got[1][0] == pytest.approx(20.0) and got[1][1] == "log-linear" and got[2] == (None, "hold")


def test_tornqvist_leaves_out_units_without_both_years(spark):
    g = spark.createDataFrame([(1, 2001, 0.1), (2, 2001, 0.5)], "unit int, year int, dln double")
    w = spark.createDataFrame([(1, 2000, 4.0), (1, 2001, 5.0), (2, 2001, 95.0)], "unit int, year int, w double")
    r = I.tornqvist(g, w).first()
    assert (r["n"], r["dln_weighted"]) == (1, pytest.approx(0.1))


def test_convergence_against_dummies(spark):
    rng = np.random.default_rng(7)
    rows = [(u, t, float(rng.normal()), float(rng.normal())) for u in range(15) for t in range(5) if (u + t) % 6]
    fit = R.convergence(spark.createDataFrame(rows, "unit int, year int, dln double, level double"), list(range(5)))
    x = np.array([[r[3], *[float(r[0] == u) for u in range(15)], *[float(r[1] == t) for t in range(1, 5)]] for r in rows])
    assert fit["slope"] == pytest.approx(np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0][0])


def test_layers_in_order(spark):
    left = spark.createDataFrame([(10, 1, "A"), (11, 1, "B"), (12, 1, "C"), (13, 1, "Dx"), (14, 1, "Z")], "cid long, prov int, name string")
    dims = spark.createDataFrame([(10, 1, "Q", None), (21, 1, "B", None), (20, 1, "B", None), (22, 1, "N", "C"), (23, 1, "Dy", None)], "code long, prov int, gname string, gold string")
    got = {r["cid"]: (r["map_code"], r["how"]) for r in X.layered(left, dims, "[xy]$").collect()}
    assert got == {10: (10, "code"), 11: (20, "name"), 12: (22, "former"), 13: (23, "stem"), 14: (None, "unmatched")}


def test_years_are_replaced_and_extended(spark, tmp_path):
    from fieldspan.sources import tables as S

    path = str(tmp_path / "stage")
    S.write_years(spark.createDataFrame([(1, 2000), (2, 2001)], "v int, year int"), path)
    S.write_years(spark.createDataFrame([(9, 2001)], "v int, year int"), path)
    S.extend_years(spark.createDataFrame([(7, 2000), (8, 2002)], "v int, year int"), path).count()
    assert sorted((r["v"], r["year"]) for r in spark.read.parquet(path).collect()) == [(1, 2000), (8, 2002), (9, 2001)]
    assert not S.write_complete(spark.range(3), str(tmp_path / "none"), F.col("id") == 1)
    with pytest.raises(ValueError):
        S.require(spark.range(1), "id", "x")


def test_panel_frontier_finds_its_parameters(spark):
    from pyspark.sql import functions as F

    from fieldspan.operators import panel_frontier as PF

    rng = np.random.default_rng(1)
    rows = []
    for u in range(120):
        ui = abs(rng.normal(0.0, 0.5))
        for t in range(8):
            a, b = rng.normal(size=2)
            h = np.exp(-0.1 * (t - 7))
            rows.append((u, 2000 + t, float(np.exp(1 + 0.4 * a + 0.3 * b + 0.05 * t + rng.normal(0, 0.15) - ui * h)), float(np.exp(a)), float(np.exp(b)), float(ui * h)))
    df = spark.createDataFrame(rows, "unit int, year int, y double, a double, b double, u double").repartition(2)
    years = list(range(2000, 2008))
    fit, units = PF.fitted(df, F.ln("y"), {"a": F.ln("a"), "b": F.ln("b")}, years)
    assert fit.model == "time decay" and fit.coef["a"] == pytest.approx(0.4, abs=0.03) and fit.coef["b"] == pytest.approx(0.3, abs=0.03)
    assert fit.coef["eta"] == pytest.approx(0.1, abs=0.02) and 0 < fit.errors["a"] < 0.02
    found = PF.efficiencies(fit, units, ["const", "a", "b", *[f"y{t}" for t in years[1:]]]).join(df, ["unit", "year"])
    assert found.count() == 960 and found.select(F.corr("u_hat", "u")).first()[0] > 0.95
    # the same likelihood by integrating over u
    from fieldspan.operators.panel_frontier import Units, log_phi

    one = Units(np.array([0.3, -0.2, 0.1]), np.ones((3, 1)), np.array([2.0, 1.0, 0.0]), np.array([0]))
    theta = np.array([0.5, 0.2, 0.1, np.log(0.5), 0.4])
    g = 1 / (1 + np.exp(-0.4))
    su, sv = np.sqrt(0.5 * g), np.sqrt(0.5 * (1 - g))
    x = np.linspace(0, 12, 200001)
    dens = np.exp(-((x - 0.2) ** 2) / (2 * su * su)) / (su * np.sqrt(2 * np.pi)) / np.exp(log_phi(np.array(0.2 / su)))
    for e, back in zip(one.y - 0.5, one.back):
        dens = dens * np.exp(-((e + x * np.exp(0.1 * back)) ** 2) / (2 * sv * sv)) / (sv * np.sqrt(2 * np.pi))
    assert one.loglik(theta)[0] == pytest.approx(np.log(((dens[1:] + dens[:-1]) / 2 * np.diff(x)).sum()), abs=1e-6)


def test_pooled_frontier_is_the_half_normal_likelihood(spark):
    from pyspark.sql import functions as F

    from fieldspan.operators import panel_frontier as PF

    rng = np.random.default_rng(3)
    rows = []
    for u in range(60):
        own = rng.normal(0, 0.1)  # what the rows of a unit share: errors must be clustered
        rows += [(u, 2000 + t, float(np.exp(1 + 0.6 * (a := rng.normal()) + own + rng.normal(0, 0.1) - abs(rng.normal(0, 0.4)))), float(np.exp(a))) for t in range(8)]
    df = spark.createDataFrame(rows, "unit int, year int, y double, a double").repartition(3)
    x = {"const": F.lit(1.0), "a": F.ln("a")}
    units = PF.packed(df, F.ln("y"), x)
    fit = PF.pooled(df, F.ln("y"), x, units, inputs=[1])
    assert fit.converged and fit.model == "pooled half-normal" and fit.coef["a"] == pytest.approx(0.6, abs=0.05)

    unit, ly, la = np.array([r[0] for r in rows]), np.log([r[2] for r in rows]), np.log([r[3] for r in rows])

    def by_row(t):
        s, g = math.exp(t[2] / 2), 1 / (1 + math.exp(-t[3]))
        e = ly - t[0] - t[1] * la
        below = np.array([0.5 * math.erfc(v * math.sqrt(g / (1 - g)) / s / math.sqrt(2)) for v in e])
        return math.log(2 / s / math.sqrt(2 * math.pi)) - e**2 / 2 / s**2 + np.log(below)

    top = np.array([fit.coef[k] for k in ("const", "a", "ln_sigma2", "logit_gamma")])
    assert by_row(top).sum() == pytest.approx(fit.loglik, rel=1e-9)
    d = 1e-4 * np.eye(4)
    scores = np.stack([(by_row(top + v) - by_row(top - v)) / 2e-4 for v in d], 1)
    second = np.array([[(by_row(top + v + w).sum() - by_row(top + v - w).sum() - by_row(top - v + w).sum() + by_row(top - v - w).sum()) / 4e-8 for v in d] for w in d])
    held = np.stack([scores[unit == u].sum(0) for u in range(60)])
    cov = np.linalg.inv(second) @ (held.T @ held) @ np.linalg.inv(second) * 60 / 59
    errors = np.array([fit.errors[k] for k in ("const", "a", "ln_sigma2", "logit_gamma")])
    assert errors == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-2)
    assert fit.returns.scale == fit.coef["a"] and fit.returns.chi2 == pytest.approx(((fit.coef["a"] - 1) / errors[1]) ** 2) and fit.returns.p < 1e-9
    # what is expected of a row depends on that row alone
    found = {(r.unit, r.year): r.u_hat for r in PF.efficiencies(fit, units, ["const", "a"]).collect()}
    s, g = math.exp(top[2] / 2), 1 / (1 + math.exp(-top[3]))
    for (u, t, y, a) in rows[:20]:
        e, width = math.log(y) - top[0] - top[1] * math.log(a), s * math.sqrt(g * (1 - g))
        z = -e * g / width
        assert found[u, t] == pytest.approx(-e * g + width * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-z / math.sqrt(2))), rel=1e-6)


def test_quantile_regression_is_the_programmes(spark):
    rng = np.random.default_rng(4)
    x, e = rng.uniform(0, 2, 60), rng.normal(size=60)
    y = 1 + 0.7 * x + e
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    coef = R.quantile_regression(df, F.col("y"), {"x": F.col("x")}, "g", 0.8)[1]
    loss = lambda a, b: float(np.where((r := y - a - b * x) > 0, 0.8 * r, -0.2 * r).sum())
    best = min(loss(y[i] - s * x[i], s) for i in range(60) for j in range(i) for s in [(y[i] - y[j]) / (x[i] - x[j])])
    assert loss(coef["const"], coef["x"]) == pytest.approx(best, rel=1e-4)
    se = R.quantile_errors(df, F.col("y"), {"x": F.col("x")}, "g", {1: coef}, 0.8)[1]
    assert 0.05 < se["x"] < 1.0


def test_absorbed_effects_equal_dummies(spark):
    rng = np.random.default_rng(2)
    rows = [(u, float(rng.normal()), float(rng.uniform(1, 3)), float(u)) for u in range(6) for _ in range(5)]
    rows = [(u, a, w, 0.5 * a + c + float(rng.normal(0, 0.1))) for u, a, w, c in rows]
    df = spark.createDataFrame(rows, "unit int, a double, w double, y double")
    fit = R.absorbed(df, "y", ["a"], weight="w")
    design = np.array([[a, *[float(u == k) for k in range(6)]] for u, a, _, _ in rows])
    root = np.sqrt([w for _, _, w, _ in rows])
    b = np.linalg.lstsq(design * root[:, None], np.array([r[3] for r in rows]) * root, rcond=None)[0]
    assert fit["coef"]["a"] == pytest.approx(b[0]) and fit["units"] == 6 and R.wald(fit, ["a"])[0] == pytest.approx(b[0] ** 2 / fit["cov"][0, 0])


def test_exact_quantiles_against_all_vertices(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from fieldspan.operators import regress as R

    rng = np.random.default_rng(21)
    rows, best = [], {}
    for g, (n, tau) in enumerate([(14, 0.8), (20, 0.8), (17, 0.8)]):
        x = np.stack([np.ones(n), rng.normal(size=n), rng.integers(0, 3, n)], 1)
        y = x @ [1.0, 2.0, -1.0] + rng.normal(size=n) ** 3
        if g == 2:
            y[:6] = y[6:12]
            x[:6] = x[6:12]  # repeated rows
        loss = lambda b: float(np.where(y - x @ b > 0, tau * (y - x @ b), (tau - 1) * (y - x @ b)).sum())  # noqa: B023, E731
        best[g] = min(loss(np.linalg.solve(x[list(h)], y[list(h)])) for h in combinations(range(n), 3) if abs(np.linalg.det(x[list(h)])) > 1e-9)
        rows += [(g, float(a[1]), float(a[2]), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double").repartition(3)
    for near in (8, 20_000):  # with few near rows the others enter as sums
        fits = R.quantile_fits(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}, "g", 0.8, near=near)
        for g, f in fits.items():
            r = [y - f["coef"]["const"] - f["coef"]["a"] * a - f["coef"]["b"] * b for k, a, b, y in rows if k == g]
            assert f["exact"] and f["gap"] < 1e-9 and sum(0.8 * v if v > 0 else -0.2 * v for v in r) == pytest.approx(best[g], rel=1e-9)


def test_json_payloads(spark):
    import json

    from fieldspan.plans.relational import payloads

    df = spark.createDataFrame([(1, 2001, 1234567.0, 0.000123456789), (1, 2000, None, 2.0), (2, 2000, -0.5, None)], "unit int, year int, a double, b double")
    got = {r.unit: json.loads(r.payload) for r in payloads(df, "unit", "year", {"a": "A", "b": "B"}).collect()}
    assert got[1] == {"id": 1, "years": [2000, 2001], "vars": [{"label": "A", "z": [None, 1234570.0]}, {"label": "B", "z": [2.0, 0.000123457]}]}
    assert got[2]["vars"] == [{"label": "A", "z": [-0.5]}, {"label": "B", "z": [None]}]


def test_prefix_match_in_blocks(spark):
    """Blocks of distinct names give every name the best of all pairs."""
    from difflib import SequenceMatcher
    from random import Random

    rng = Random(3)
    word = lambda: "ab" + "".join(rng.choice("abcd é😀") for _ in range(rng.choice([3, 6, 12, 80])))
    names = [word() for _ in range(25)]
    left = [(i, i % 2, rng.choice(names)) for i in range(200)]
    dims = [(i if i % 50 else None, i % 2, rng.choice(names)[: rng.choice([4, 90])] + rng.choice(["", "", " NEW"])) for i in range(300)]
    got = X.best_by_prefix(spark.createDataFrame(left, "cid long, prov int, name string"), spark.createDataFrame(dims, "code long, prov int, gname string"), block=7)
    want = {}
    for cid, prov, name in left:
        score, _, code, _ = max((SequenceMatcher(None, name, g).ratio(), c is not None, -(c or 0), g) for c, p, g in dims if p == prov)
        want[cid] = (-code, round(score, 2))
    assert {r.cid: (r.code, r.similarity) for r in got.collect()} == {k: (c, pytest.approx(s, abs=0.0051)) for k, (c, s) in want.items()}


def test_prefix_match_bound():
    """The bound holds for names of any length, and leaves few candidates of the best match."""
    from difflib import SequenceMatcher

    names = [f"Brand#{b} {t}" for b in range(1, 26) for t in ("LARGE", "ECONOMY", "SMALL", "STANDARD", "MEDIUM", "PROMO")] + ["x" * 70 + "é", "😀b"]
    letters, size = X._bits(names)
    for name in names[::7] + ["Brand#7 LARGE NEW", names[-1] + "y"]:
        ratio = np.array([SequenceMatcher(None, name, n).ratio() for n in names])
        bound = X.at_most(name, letters, size)
        assert (bound >= ratio).all() and (len(name) > 63 or (bound >= ratio.max()).sum() < 40)


def test_panel_scores_are_derivatives(monkeypatch):
    """One pass over the units gives likelihood and scores, without a call of the likelihood for each parameter."""
    from fieldspan.operators import panel_frontier as PF

    z = np.linspace(-11.9, 8, 4001)
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v < 0 else math.log1p(-0.5 * math.erfc(v / math.sqrt(2))) for v in z]
    assert np.allclose(PF.log_phi(z), want, rtol=1e-13, atol=1e-15) and np.isfinite(PF.log_phi(np.array([-1e3, 40.0]))).all()
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
    y = x @ [1, 0.5, 0.3] + 0.2 * rng.normal(size=300) - np.repeat(np.abs(rng.normal(size=60)), 5)
    for pooled, theta in ((False, [1, 0.4, 0.2, 0.3, 0.05, -1, 0.5]), (False, [1, 0.4, 0.2, -2, -0.1, -2, 3]), (True, [1, 0.4, 0.2, -1, 0.5])):
        u, theta = PF.Units(y, x, np.tile(np.arange(4.0, -1, -1), 60), np.arange(0, 300, 5), pooled), np.array(theta, float)
        moved = np.stack([(u.loglik(theta + d) - u.loglik(theta - d)) / 2e-6 for d in 1e-6 * np.eye(len(theta))], 1)
        calls = []
        monkeypatch.setattr(PF.Units, "loglik", lambda self, t: calls.append(t))
        assert np.allclose(u.scores(theta), moved, rtol=1e-6, atol=1e-6) and not calls
        monkeypatch.undo()


def test_exact_weather_shares_bases(monkeypatch):
    """Programmes with weather to be met are solved together: same values and same infeasible points, few programmes."""
    rng = np.random.default_rng(0)
    x, w = rng.normal(2000, 250, (400, 1)), np.column_stack([rng.normal(25, 1.5, 400), rng.normal(4, 0.25, 400)])
    y = x[:, 0] * rng.normal(30, 2, 400)
    one = lp.frontier_value
    want = np.array([one(x[i], x[:60], y[:60], w[i], w[:60]) for i in range(400)])
    alone = []
    monkeypatch.setattr(lp, "frontier_value", lambda *a: alone.append(1) or one(*a))
    f, proof = lp.Technology(x[:60], y[:60], w[:60]).values(np.hstack([x, w]))
    assert (np.isnan(f) == np.isnan(want[:, 0])).all() and np.isnan(f).any() and np.allclose(f, want[:, 0], rtol=1e-9, equal_nan=True)
    assert np.nanmax(proof) < 1e-9 and len(alone) < 5
    kept = lp.outer(x[:60], y[:60], w[:60])
    again, _ = lp.Technology(x[:60][kept], y[:60][kept], w[:60][kept]).values(np.hstack([x, w]))
    assert kept.sum() < 60 and np.allclose(f, again, rtol=1e-9, equal_nan=True)
    assert lp.Technology(x[:1], y[:1], w[:1]).values(np.hstack([x[:2], w[:2]]))[0].tolist() == [pytest.approx(y[0]), pytest.approx(math.nan, nan_ok=True)]


def test_large_technology_is_copied_to_few_parts(spark):
    points = spark.range(50_000).select(F.lit(1).alias("t"))
    assert lp._parts(points, "t", lp.POINTS, lp.MANY).first().parts == 32 and lp._parts(points.limit(150), "t", lp.POINTS, lp.MANY).first().parts == 1


def test_counts_of_dominating_points_need_no_pairs(spark):
    """Counts of ties, repeated points and a unit's own rows are those of all pairs, in one task and over cells."""
    rng = np.random.default_rng(5)
    rows = [(int(u), int(t), float(x), float(y)) for u, t, x, y in zip(rng.integers(0, 250, 600), rng.integers(0, 2, 600), rng.integers(0, 30, 600), rng.integers(0, 30, 600))]
    rows += [(900, 0, None, 3.0), (901, 0, 3.0, None), (902, 1, -1.0, 99.0)]
    want = {}
    for u, t, x, y in rows:
        n = sum(v != u and s == t and None not in (x, y, a, b) and a <= x and b >= y for v, s, a, b in rows)
        want[u, t] = want.get((u, t), 0) + n
    df = spark.createDataFrame(rows, "unit int, year int, x double, y double")
    for most in (1000, 10):
        plan = O.dominated_by(df, ["year"], "unit", "x", "y", most=most, buckets=7)
        assert {(r.unit, r.year): r.beaten_by for r in plan.collect()} == {k: n for k, n in want.items() if n}
    x, y = rng.random(20_000), rng.random(20_000)
    assert O.dominators(x, y)[:50].tolist() == [int(((x <= a) & (y >= b)).sum()) for a, b in zip(x[:50], y[:50])]


def _growth_of_two(spark):
    rng = np.random.default_rng(5)
    rows = [(u, t, None if (u + t) % 7 == 0 else float(rng.normal()), None if t == 2003 else float(rng.normal())) for u in range(40) for t in (2001, 2002, 2003)]
    weight = [(u, t, 0.0 if u == 3 else float(rng.uniform(1, 2))) for u in range(40) for t in (2000, 2001, 2002, 2003) if (u, t) != (5, 2001)]
    return spark.createDataFrame(rows, "unit int, year int, a double, b double"), spark.createDataFrame(weight, "unit int, year int, w double")


def test_weighted_growth_of_columns_is_each_ones_tornqvist(spark):
    from fieldspan.operators import index as I

    growth, weight = _growth_of_two(spark)
    found = {r.year: r for r in I.weighted_growth(growth, weight, ["a", "b"]).collect()}
    assert len(found) == 3 and found[2003].b is None and found[2003].n_b == 0
    for k in ("a", "b"):
        alone = I.tornqvist(growth.select("unit", "year", F.col(k).alias("dln")), weight).collect()
        assert {r.year for r in alone} == {t for t, r in found.items() if r[f"n_{k}"]}
        assert all(found[r.year][k] == pytest.approx(r.dln_weighted, rel=1e-12) and found[r.year][f"n_{k}"] == r.n for r in alone)


def test_columns_winsorized_together_are_winsorized_alone(spark):
    from fieldspan.operators import panel as P, spread

    growth, _ = _growth_of_two(spark)
    both = P.winsorized(growth, ["a", "b"], low=0.1, high=0.9)
    assert both.columns == ["year", "unit", "a", "b"]
    for k in ("a", "b"):
        alone = P.winsorized(growth.select("unit", "year", k), k, low=0.1, high=0.9)
        assert {(r.unit, r.year): r[k] for r in alone.collect()} == {(r.unit, r.year): r[k] for r in both.collect()}
    small, large = ({r.year: (r.a, r.b) for r in spread.quantiles_of(growth, ["a", "b"], ["year"], [0.1, 0.5], most=most, buckets=4).collect()} for most in (100, 10))
    assert small.keys() == large.keys() and large[2003][1] is None
    assert all(v == pytest.approx(w) for t in small for v, w in zip(small[t], large[t]) if v is not None)


def test_technology_reads_its_input_twice_whatever_the_rounds(spark):
    from fieldspan.operators import lp

    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("year"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    found = lp.technology(rows, "year", ["x"], "y")
    assert found.columns == ["year", "x", "y"] and found._jdf.queryExecution().analyzed().toString().count("Range (") == 2
