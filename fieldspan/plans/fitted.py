"""Programmes, fits and matching that SQL can't express or not plainly; with their certificates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldspan.functions.expr import stage
from fieldspan.operators import crosswalk as X, frontier as O, index as I, lp, panel as P, panel_frontier as PF, regress as R, spread
from fieldspan.plans.headline import growth, sample
from fieldspan.plans.indices import accounts
from fieldspan.plans.registry import query
from fieldspan.sources.tables import INPUTS, held, panel, table, with_holes

_IN = list(INPUTS)


def rows(spark, d):
    return with_holes(panel(spark, d))


def _points(df, t="year"):
    return df.select(F.col(t).cast("int").alias("t"), "unit", F.col("year").cast("string").alias("tag"), *_IN, "y")


def _own(spark, d):
    return lp.technology(rows(spark, d), "year", _IN, "y")


def _up_to(spark, d):
    """The technology of all years up to t; each year's rows are pruned before they are copied on."""
    years = rows(spark, d).select(F.col("year").alias("t")).distinct()
    return lp.technology(years.join(held(spark, d, "technologies", _own), F.col("year") <= F.col("t")).drop("year"), "t", _IN, "y")


@query("f02_nirs_programme")
def f02(spark, d):
    """Four-input frontier values of each year's units, with the duality certificate."""
    r = rows(spark, d)
    ref = held(spark, d, "technologies", _own).withColumnRenamed("year", "t")
    got = lp.values(_points(r), ref, _IN, "y").select("t", "unit", "f", "proof")
    return got.join(r.select(F.col("year").alias("t"), "unit", "y"), ["t", "unit"]).withColumn("theta", F.col("y") / F.col("f"))


@query("f05b_malmquist_four_inputs")
def f05b(spark, d):
    r = rows(spark, d)
    years = r.select(F.col("year").alias("t")).distinct()
    ref = held(spark, d, "technologies up to a year", _up_to)
    asked = _points(r.withColumn("s", F.explode(F.array(*[F.col("year") + k for k in (0, 1, -1)]))), "s")
    v = lp.values(asked.join(years, "t", "left_semi"), ref, _IN, "y").select("t", "unit", F.col("tag").cast("int").alias("at"), "f")
    # a value serves up to two pairs of years: now and before (t or p) of the technology, then of the inputs
    at = lambda year, tag: F.struct(year.alias("year"), F.lit(tag).alias("tag"))
    t = F.col("t")
    uses = F.when(F.col("at") == t, F.array(at(t, "tt"), at(t + 1, "pp"))).when(F.col("at") == t + 1, F.array(at(t + 1, "pt"))).otherwise(F.array(at(t, "tp")))
    wide = v.select("unit", "f", F.explode(uses).alias("u")).select("unit", "u.*", "f").groupBy("unit", "year").pivot("tag", ["tt", "pp", "pt", "tp"]).agg(F.max("f"))
    out = rows(spark, d).select("unit", "year", "y").join(r.select("unit", (F.col("year") + 1).alias("year"), F.col("y").alias("y0")), ["unit", "year"]).join(wide, ["unit", "year"])
    tt, pt = F.ln(F.col("y") / F.col("tt")), F.ln(F.col("y") / F.col("pt"))
    pp, tp = F.ln(F.col("y0") / F.col("pp")), F.ln(F.col("y0") / F.col("tp"))
    m = ((pt - pp) + (tt - tp)) / 2
    return out.select("unit", "year", m.alias("lnM"), (tt - pp).alias("lnEC"), (m - (tt - pp)).alias("lnTC"), F.exp(tt).alias("eff_now"))


@query("f09_isoquant_programme")
def f09(spark, d):
    """Least x_m at each x_l that still makes the year's median output, the other inputs at their medians."""
    r = rows(spark, d)
    mid = r.groupBy("year").agg(F.median("y").alias("target"), F.median("x_s").alias("hs"), F.median("x_k").alias("hk"), F.percentile("x_l", F.array(*[F.lit(k / 10) for k in range(1, 11)])).alias("grid"))
    ref = O.non_dominated(r, ["year"], _IN, "y")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in left.to_dict("records"):
            got = lp.isoquant(p["target"], np.array(p["grid"]), np.array([p["hs"], p["hk"]]), *(right[c].to_numpy(float) for c in ("x_l", "x_m")), right[["x_s", "x_k"]].to_numpy(float), right["y"].to_numpy(float))
            out += [(p["year"], float(g), v if v == v else None) for g, v in zip(p["grid"], got)]
        return pd.DataFrame(out, columns=["year", "x_l", "x_m"]).astype({"x_m": float})

    return mid.groupBy("year").cogroup(ref.groupBy("year")).applyInPandas(run, "year int, x_l double, x_m double")


@query("f10_informative_range")
def f10(spark, d):
    """By year, the x_l between which the median output's isoquant falls."""
    r = rows(spark, d)
    mid = r.groupBy("year").agg(F.median("y").alias("target"), F.median("x_s").alias("hs"), F.median("x_k").alias("hk"))
    ref = O.non_dominated(r, ["year"], _IN, "y")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in left.to_dict("records"):
            ends = lp.informative_range(p["target"], np.array([p["hs"], p["hk"]]), *(right[c].to_numpy(float) for c in ("x_l", "x_m")), right[["x_s", "x_k"]].to_numpy(float), right["y"].to_numpy(float))
            out.append((p["year"], *ends))
        return pd.DataFrame(out, columns=["year", "low", "high"])

    return mid.groupBy("year").cogroup(ref.groupBy("year")).applyInPandas(run, "year int, low double, high double")


def weather_frame(spark, d):
    """unit, year, y, x and two weather columns that must be met exactly; kept, as programmes meet it often."""
    return held(spark, d, "weather", _weather)


def _weather(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_suppkey").cast("int").alias("unit"), F.year("l_shipdate").cast("int").alias("year")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.sum("l_quantity").alias("x"), F.avg("p_size").alias("w1"), (F.avg("l_tax") * 100).alias("w2")
    )


def own_year(w):
    """Each year's units as a technology, without those that the others replace."""
    return lp.technology(w.withColumnRenamed("year", "t"), "t", ["x"], "y", ["w1", "w2"])


@query("f11_hull_prune")
def f11(spark, d):
    """Units that span each year's technology when weather must be met exactly."""
    return lp.hull_vertices(weather_frame(spark, d), "year", "unit", ["x", "w1", "w2", "y"])


@query("f12_weak_disposability")
def f12(spark, d):
    """Values with both weather columns as equalities, on own-year and on last year's technology."""
    w = weather_frame(spark, d)
    asked = w.select(F.col("year").alias("t"), "unit", F.lit("own").alias("tag"), "x", "w1", "w2").unionByName(w.where("year > 1995").select((F.col("year") - 1).alias("t"), "unit", F.lit("last").alias("tag"), "x", "w1", "w2"))
    return lp.values(asked, own_year(w), ["x"], "y", ["w1", "w2"])


@query("f13_cps_decomposition")
def f13(spark, d):
    """The parts' sum equals lnTFP in each feasible row: the column ``off`` shows it."""
    out = lp.decomposed(weather_frame(spark, d))
    return out.withColumn("off", F.round(F.col("dT") + F.col("dW") + F.col("dX") + F.col("dE") - F.col("lnTFP"), 8))


@query("f15_outside_reference")
def f15(spark, d):
    """Scores of all units against a reference of even units only."""
    r = rows(spark, d)
    ref = lp.technology(r.where("unit % 2 = 0"), "year", _IN, "y").withColumnRenamed("year", "t")
    got = lp.values(_points(r), ref, _IN, "y").select("t", "unit", "f", "proof")
    return got.join(r.select(F.col("year").alias("t"), "unit", "y"), ["t", "unit"]).withColumn("theta", F.col("y") / F.col("f"))


@query("f22_programme_surface")
def f22(spark, d):
    """f(x, w) on a grid of five by five a year; NULL where no mix of units meets the weather."""
    w = weather_frame(spark, d)
    q = w.groupBy(F.col("year").alias("t")).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in (0.1, 0.3, 0.5, 0.7, 0.9)])).alias(c) for c in ("x", "w1")], F.median("w2").alias("w2"))
    pts = q.select("t", F.posexplode("x").alias("i", "x"), "w1", "w2").select("t", "i", "x", F.posexplode("w1").alias("j", "w1"), "w2")
    asked = pts.select("t", F.col("i").cast("int").alias("unit"), F.col("j").cast("string").alias("tag"), "x", "w1", "w2")
    got = lp.values(asked, own_year(w), ["x"], "y", ["w1", "w2"])
    return got.join(asked.select("t", "unit", "tag", "x", "w1"), ["t", "unit", "tag"]).select(F.col("t").alias("year"), "x", "w1", "f", "proof")


@query("e11_convergence_regression")
def e11(spark, d):
    r = rows(spark, d)
    level = r.select("unit", (F.col("year") + 1).alias("year"), I.solow().alias("level"))
    g = growth(spark, d).join(level, ["unit", "year"])
    years = [x[0] for x in g.select("year").distinct().orderBy("year").collect()]
    fit = R.convergence(g, years) if years else {"slope": math.nan, "se": math.nan, "n": 0, "units": 0}
    return spark.createDataFrame([tuple(fit.values())], "slope double, se double, n long, units long")


@query("e13_pooled_half_normal")
def e13(spark, d):
    """Pooled half-normal stochastic frontier by moments of least-squares residuals: what stands in
    where the likelihood of ``e13d`` starts."""
    r = rows(spark, d).withColumn("one", F.lit(1))
    fit = R.ols(r, F.ln("y"), {k: F.ln(k) for k in _IN}, ["one"])
    if not fit:
        return spark.createDataFrame([], "sigma_u double, sigma_v double, mean_u double, n long")
    coef = fit[0]["coef"]
    e = F.ln("y") - coef["const"] - sum((coef[k] * F.ln(k) for k in _IN), F.lit(0.0))
    m = r.select(e.alias("e")).agg(F.count("e"), F.avg(F.pow("e", 2)), F.avg(F.pow("e", 3))).first()
    out = R.half_normal(*m)
    return spark.createDataFrame([(*out.values(), m[0])], "sigma_u double, sigma_v double, mean_u double, n long")


@query("e15b_translog_by_year")
def e15b(spark, d):
    """Cobb-Douglas and translog by year: fit and elasticities at the mean."""
    r = rows(spark, d)
    centre = r.agg(*[F.avg(F.ln(k)).alias(k) for k in _IN]).first().asDict()
    if centre[_IN[0]] is None:
        return spark.createDataFrame([], "year int, model string, n long, r2 double, x_l double, x_s double, x_k double, x_m double")
    out = []
    for name, x in (("cobb-douglas", {k: F.ln(k) - F.lit(centre[k]) for k in _IN}), ("translog", R.translog(_IN, centre))):
        out += [(f["year"], name, f["n"], f["r2"], *[f["coef"][k] for k in _IN]) for f in R.ols(r, F.ln("y"), x, ["year"])]
    return spark.createDataFrame(out, "year int, model string, n long, r2 double, x_l double, x_s double, x_k double, x_m double")


@query("e16_surface_and_isoquant")
def e16(spark, d):
    """Fitted output on a grid, and the second input that holds the middle output, by the fit inverted."""
    fit = {f["year"]: f["coef"] for f in R.ols(rows(spark, d), F.ln("y"), {k: F.ln(k) for k in ("x_l", "x_m")}, ["year"])}
    mid = rows(spark, d).groupBy("year").agg(F.median(F.ln("y")).alias("ly"), F.percentile(F.ln("x_l"), F.array(*[F.lit(p) for p in (0.1, 0.3, 0.5, 0.7, 0.9)])).alias("g"))
    table_ = spark.createDataFrame([(y, c["const"], c["x_l"], c["x_m"]) for y, c in fit.items()], "year int, a double, bl double, bm double")
    line = (F.col("ly") - F.col("a") - F.col("bl") * F.col("lx_l")) / F.nullif(F.col("bm"), F.lit(0.0))
    return mid.join(F.broadcast(table_), "year").select("year", "a", "bl", "bm", "ly", F.explode("g").alias("lx_l")).withColumn("lx_m", line).select("year", "lx_l", "lx_m")


@query("e16b_translog_isoquant")
def e16b(spark, d):
    """By year, the x_m that makes the target with x_l on a grid and the other inputs at their medians, on the
    year's four-input translog; the target is the middle year's output at the medians. The fitted log output
    is a quadratic in ln x_m, so the root where output rises is closed; NULL outside the 1 to 99 % range."""
    r = rows(spark, d)
    logs = {k: F.ln(k) for k in _IN}
    q = r.agg(*[F.percentile(v, F.array(*[F.lit(p) for p in (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99)])).alias(k) for k, v in logs.items()]).first()
    mid = {k: q[k][3] for k in _IN}
    fits = {f["year"]: f["coef"] for f in R.ols(r, F.ln("y"), R.translog(_IN, mid), ["year"])}  # logs about their medians
    if not fits:
        return spark.createDataFrame([], "year int, lx_l double, lx_m double, ly double, target double")
    target = sorted(fits.items())[len(fits) // 2][1]["const"]
    curves = []
    for year, c in fits.items():
        for l in q["x_l"][1:6]:
            v = l - mid["x_l"]
            curves.append((int(year), l, c["const"] + c["x_l"] * v + 0.5 * c["x_l*x_l"] * v * v, c["x_m"] + c["x_l*x_m"] * v, 0.5 * c["x_m*x_m"]))
    a0, a1, a2 = F.col("a0") - F.lit(target), F.col("a1"), F.col("a2")
    root = F.sqrt(a1 * a1 - 4 * a2 * a0)
    # of the two roots the one where output rises, in the form that doesn't cancel
    up = F.when(a1 * a1 < 4 * a2 * a0, F.lit(None)).when(a1 > 0, F.try_divide(-2 * a0, a1 + root)).otherwise(F.try_divide(root - a1, 2 * a2))
    at = F.when((up >= q["x_m"][0] - mid["x_m"]) & (up <= q["x_m"][6] - mid["x_m"]), up)
    out = spark.createDataFrame(curves, "year int, lx_l double, a0 double, a1 double, a2 double").withColumn("v", at)
    fitted = F.col("a0") + a1 * F.col("v") + a2 * F.col("v") * F.col("v")
    return out.select("year", "lx_l", (F.col("v") + mid["x_m"]).alias("lx_m"), fitted.alias("ly"), F.lit(target).alias("target"))


@query("e17_quantile_regression")
def e17(spark, d):
    """Upper-quantile regression by year, with the share of units above the fit."""
    r = rows(spark, d)
    x = {"x_l": F.ln("x_l"), "x_m": F.ln("x_m")}
    fits = R.quantile_fits(r, F.ln("y"), x, "year", 0.9)
    t = spark.createDataFrame([(int(y), *(f["coef"][k] for k in ("const", "x_l", "x_m")), f["gap"], f["exact"]) for y, f in fits.items()], "year int, a double, bl double, bm double, gap double, exact boolean")
    above = F.ln("y") > F.col("a") + F.col("bl") * F.ln("x_l") + F.col("bm") * F.ln("x_m") + 1e-9
    return r.join(F.broadcast(t), "year").groupBy("year", "a", "bl", "bm", "gap", "exact").agg(F.avg(above.cast("double")).alias("above"), F.count(F.lit(1)).alias("n"))


def decay(spark, d):
    """The frontier with time decay of a folder's panel, its packed units and the terms, fitted once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _decays:
        r = rows(spark, d)
        years = [x[0] for x in r.select("year").distinct().orderBy("year").collect()]
        fit, units = PF.fitted(r, F.ln("y"), {k: F.ln(k) for k in _IN}, years)
        _decays[key] = fit, units, ["const", *[k for k in _IN if k != _IN[0] or "constant" not in fit.model], *[f"y{t}" for t in years[1:]]]
    return _decays[key]


_decays: dict[tuple[str, str], tuple] = {}


@query("e13b_time_decay_frontier")
def e13b(spark, d):
    """Terms of the panel frontier, with errors clustered by unit, and which model they are of."""
    fit, _, _ = decay(spark, d)
    out = [(k, float(v), fit.errors.get(k), fit.model) for k, v in fit.coef.items()]
    return spark.createDataFrame(out, "term string, coef double, se double, model string")


@query("e13c_returns_to_scale")
def e13c(spark, d):
    """Returns to scale at the mean before any constraint, the test that they are constant, and whether the
    constraint binds; the fit that stands, its likelihood, rounds, and whether it converged. No row without a fit that converged."""
    fit, _, _ = decay(spark, d)
    out = [(*fit.returns, fit.model, fit.loglik, fit.rounds, fit.converged)] if fit.returns else []
    return spark.createDataFrame(out, "scale double, se double, chi2 double, p double, bind boolean, model string, loglik double, rounds int, converged boolean")


@query("e13d_pooled_likelihood")
def e13d(spark, d):
    """Terms of the pooled half-normal frontier with year effects, by likelihood, errors clustered by unit."""
    r = rows(spark, d)
    years = [x[0] for x in r.select("year").distinct().orderBy("year").collect()]
    x = {"const": F.lit(1.0), **{k: F.ln(k) for k in _IN}, **{f"y{t}": (F.col("year") == t).cast("double") for t in years[1:]}}
    if not years:
        return spark.createDataFrame([], "term string, coef double, se double, loglik double, converged boolean")
    units = PF.packed(r, F.ln("y"), x).persist()
    fit = PF.pooled(r, F.ln("y"), x, units)
    units.unpersist()
    out = [(k, float(v), fit.errors.get(k), fit.loglik, fit.converged) for k, v in fit.coef.items()]
    return spark.createDataFrame(out, "term string, coef double, se double, loglik double, converged boolean")


def decayed(spark, d):
    """unit, year, u_hat, te and ln_tfp: constant and year effect less inefficiency."""
    fit, units, terms = decay(spark, d)
    if units is None:
        return spark.createDataFrame([], "unit int, year int, u_hat double, te double, ln_tfp double, model string")
    effect = F.lit(fit.coef["const"])
    for k in terms:
        if k[0] == "y" and k[1:].isdigit():
            effect = effect + F.when(F.col("year") == int(k[1:]), F.lit(fit.coef[k])).otherwise(F.lit(0.0))
    return PF.efficiencies(fit, units, terms).withColumn("ln_tfp", effect - F.col("u_hat")).withColumn("model", F.lit(fit.model))


@query("e14b_decay_efficiency")
def e14b(spark, d):
    return decayed(spark, d)


def _estimators(spark, d):
    """Growth of the same unit-years by three estimators: programmes, the fitted frontier, the residual."""
    dea = f05b(spark, d).select("unit", "year", F.col("lnM").alias("dea"), F.col("lnEC").alias("dea_ec"), F.col("lnTC").alias("dea_tc"))
    fitted = decayed(spark, d)
    sfa = P.adjacent_change(fitted, F.col("ln_tfp"), name="sfa").select("unit", "year", "sfa", "model")
    solow = I.unit_growth(sample(spark, d), I.solow()).select("unit", "year", F.col("dln").alias("solow"))
    return dea.join(sfa, ["unit", "year"]).join(solow, ["unit", "year"])


@query("e08b_matched_estimators")
def e08b(spark, d):
    """National growth by year and estimator on matched unit-years, winsorized and weighted by output."""
    names = ["dea", "sfa", "solow"]
    matched = _estimators(spark, d).select("unit", "year", *names).persist()  # a row per unit and year, met three times below
    weight = sample(spark, d).select("unit", "year", F.col("y").alias("w"))
    national = I.weighted_growth(P.winsorized(matched, names), weight, names)
    return national.where(" and ".join(f"n_{k} > 0" for k in names)).select("year", F.col("n_dea").alias("n"), *names)


@query("e09f_volatility_by_estimator")
def e09f(spark, d):
    """The yearly spread and range of national growth, in log percent, beside one another: of programmes and the fitted
    frontier (winsorized, weighted by output, matched unit-years) and of the residual of the totals."""
    series = e08b(spark, d).unpivot(["year"], ["dea", "sfa", "solow"], "series", "g").select("series", (100 * F.col("g")).alias("g"))
    totals = accounts(P.balanced(rows(spark, d))).select(F.lit("totals").alias("series"), F.col("tfp").alias("g"))
    return series.unionByName(totals).groupBy("series").agg(F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"), F.min("g").alias("least"), F.max("g").alias("most"), F.count("g").alias("n"))


@query("e09g_tails_of_programmes")
def e09g(spark, d):
    """Tails of the units' growth by programmes: shares beyond 0.5 and 1, and the spread before and after
    values outside the 1st to 99th percentile of all are moved to these."""
    g = f05b(spark, d).select("lnM").where("lnM is not null").persist()
    v = g.join(F.broadcast(spread.quantiles(g, "lnM", [], [0.01, 0.99])))  # a single row
    beyond = lambda b: F.avg((F.abs("lnM") > b).cast("double"))
    clipped = F.greatest(F.least("lnM", F.col("q")[1]), F.col("q")[0])
    return v.agg(beyond(0.5).alias("beyond_half"), beyond(1.0).alias("beyond_one"), F.stddev_samp("lnM").alias("sd"), F.stddev_samp(clipped).alias("sd_trimmed"), F.count("lnM").alias("n"))


@query("e12b_gap_by_stage")
def e12b(spark, d):
    """Percent growth by stage of programmes and fitted frontier, their gap, and a warning if the fit fell back."""
    m = _estimators(spark, d).groupBy(stage("year", *I.STAGES).alias("stage")).agg(*[F.avg(c).alias(c) for c in ("dea", "dea_ec", "dea_tc", "sfa")], F.max("model").alias("model"))
    pct = {c: 100 * F.expm1(c) for c in ("dea", "dea_ec", "dea_tc", "sfa")}
    fallback = F.col("model").startswith("pooled")
    return m.withColumns(pct).withColumn("gap", F.col("dea") - F.col("sfa")).withColumn("warning", F.when(fallback, "the fitted frontier is the pooled fallback"))


@query("e11b_convergence_table")
def e11b(spark, d):
    """Catch-up and stage regressions: growth on the lagged level with year effects, without and with
    unit effects; growth on stages with unit effects and output weights, with the test that all stages are alike."""
    r = rows(spark, d)
    level = r.select("unit", (F.col("year") + 1).alias("year"), I.solow().alias("level"))
    g = growth(spark, d).select("unit", "year", "dln").join(level, ["unit", "year"]).join(r.select("unit", "year", F.col("y").alias("w")), ["unit", "year"])
    years = [x[0] for x in g.select("year").distinct().orderBy("year").collect()]
    names_ = [n for _, n in I.STAGES[0]] + [I.STAGES[1]]
    g = g.withColumns({f"d{t}": (F.col("year") == t).cast("double") for t in years[1:]} | {f"s{k}": (stage("year", *I.STAGES) == n).cast("double") for k, n in enumerate(names_[1:], 1)})
    effects, stages = [f"d{t}" for t in years[1:]], [f"s{k}" for k in range(1, len(names_))]
    out = []
    for model, unit_effects in (("level, year effects", False), ("level, unit and year effects", True)):
        fit = R.absorbed(g, "dln", ["level", *effects], unit_effects=unit_effects)
        out.append((model, "level", fit["coef"]["level"], math.sqrt(max(fit["cov"][0, 0], 0.0)), fit["n"], fit["units"], None, None))
    fit = R.absorbed(g, "dln", stages, weight="w")
    test, k = R.wald(fit, stages)
    for j, s in enumerate(stages):
        out.append(("stages, unit effects, weighted", names_[j + 1], fit["coef"][s], math.sqrt(max(fit["cov"][j, j], 0.0)), fit["n"], fit["units"], test, k))
    return spark.createDataFrame(out, "model string, term string, coef double, se double, n long, units long, wald double, restrictions int")


@query("e11c_catch_up_of_efficiency")
def e11c(spark, d):
    """On the one-input Malmquist index: lnM on last year's log efficiency with year effects, then with unit
    effects too, and lnEC likewise; then lnM, lnEC and lnTC on stages with unit effects and output weights,
    each with the test that all stages are alike. Errors are clustered by unit."""
    r = rows(spark, d)
    m = O.malmquist(r, "x_m", "y").withColumn("level", F.ln("eff_prev")).join(r.select("unit", "year", F.col("y").alias("w")), ["unit", "year"])
    years = [x[0] for x in m.select("year").distinct().orderBy("year").collect()]
    names_ = [n for _, n in I.STAGES[0]] + [I.STAGES[1]]
    m = m.withColumns({f"d{t}": (F.col("year") == t).cast("double") for t in years[1:]} | {f"s{k}": (stage("year", *I.STAGES) == n).cast("double") for k, n in enumerate(names_[1:], 1)})
    effects, stages = [f"d{t}" for t in years[1:]], [f"s{k}" for k in range(1, len(names_))]
    error = lambda fit, j: math.sqrt(max(fit["cov"][j, j], 0.0))
    out = []
    for y, model, unit_effects in (("lnM", "year effects", False), ("lnM", "unit and year effects", True), ("lnEC", "unit and year effects", True)):
        fit = R.absorbed(m, y, ["level", *effects], unit_effects=unit_effects)
        out.append((y, model, "level", fit["coef"]["level"], error(fit, 0), fit["n"], fit["units"], None, None))
    for y in ("lnM", "lnEC", "lnTC"):
        fit = R.absorbed(m, y, stages, weight="w")
        test, k = R.wald(fit, stages)
        out += [(y, "stages, weighted", names_[j + 1], fit["coef"][s], error(fit, j), fit["n"], fit["units"], test, k) for j, s in enumerate(stages)]
    return spark.createDataFrame(out, "outcome string, model string, term string, coef double, se double, n long, units long, wald double, restrictions int")


def _per_worker(spark, d):
    r = rows(spark, d).withColumns({"lk": F.ln(F.col("x_k") / F.col("x_l")), "ly": F.ln(F.col("y") / F.col("x_l"))})
    mean = r.groupBy("year").agg(F.avg("lk").alias("m"), F.percentile("lk", F.array(*[F.lit(p) for p in (0.01, 0.1, 0.5, 0.9, 0.99)])).alias("q"), F.count(F.lit(1)).alias("n"))
    return r.join(F.broadcast(mean.select("year", "m")), "year").withColumn("z", F.col("lk") - F.col("m")), {x.year: x for x in mean.collect()}


@query("e17b_translog_quantile")
def e17b(spark, d):
    """By year, the 0.95 quantile of output per worker in capital per worker with a centred square: slope
    at the mean, curvature and its t, elasticities, whether Cobb-Douglas is rejected, and the share of
    the curve that is concave in levels."""
    r, years = _per_worker(spark, d)
    x = {"z": F.col("z"), "zz": F.col("z") ** 2}
    coef = R.quantile_regression(r, F.col("ly"), x, "year", 0.95)
    se = R.quantile_errors(r, F.col("ly"), x, "year", coef, 0.95)
    out = []
    for t, c in sorted(coef.items()):
        q, m = years[t].q, years[t].m
        k = np.linspace(q[0], q[4], 200) - m
        level, slope = np.exp(c["const"] + c["z"] * k + c["zz"] * k * k) / np.exp(k + m), c["z"] + 2 * c["zz"] * k
        # second derivative of y in k times k, at points that are even in logs
        concave = float((level * (slope * (slope - 1) + 2 * c["zz"]) < 0).mean())
        tc = c["zz"] / se[t]["zz"] if se[t]["zz"] > 0 else math.nan
        out.append((int(t), int(years[t].n), c["z"], c["zz"], tc, *[c["z"] + 2 * c["zz"] * (v - m) for v in q[1:4]], concave, concave > 0.9, abs(tc) > 1.96))
    return spark.createDataFrame(out, "year int, n long, b_at_mean double, curvature double, t double, e_p10 double, e_p50 double, e_p90 double, concave_share double, concave boolean, reject_cobb_douglas boolean")


@query("e17c_ratio_bias")
def e17c(spark, d):
    """By year, capital's elasticity at the 0.95 quantile per worker and in levels, and their ratio."""
    r = rows(spark, d)
    ratio = R.quantile_regression(r, F.ln(F.col("y") / F.col("x_l")), {"k": F.ln(F.col("x_k") / F.col("x_l"))}, "year", 0.95)
    level = R.quantile_regression(r, F.ln("y"), {"l": F.ln("x_l"), "k": F.ln("x_k")}, "year", 0.95)
    out = [(int(t), ratio[t]["k"], c["k"], c["l"], c["k"] + c["l"], ratio[t]["k"] / c["k"] if abs(c["k"]) > 1e-6 else None) for t, c in sorted(level.items())]
    return spark.createDataFrame(out, "year int, per_worker double, level double, labour double, rts double, inflation double")


@query("e15c_monotonicity")
def e15c(spark, d):
    """By year and form, the share of units with a positive fitted elasticity of each input, and of all."""
    r = rows(spark, d)
    out = None
    for name, x in (("cobb-douglas", {k: F.ln(k) for k in _IN}), ("translog", R.translog(_IN))):
        fits = R.ols(r, F.ln("y"), x, ["year"])
        table_ = spark.createDataFrame([(f["year"], [f["coef"][k] for k in x]) for f in fits], "year int, b array<double>")
        at = {k: F.col("b")[i] for i, k in enumerate(x)}
        slope = {k: at[k] + sum((at[p] * F.ln(p.replace(k, "", 1).strip("*")) for p in x if "*" in p and k in p.split("*")), F.lit(0.0)) for k in _IN}
        signs = r.join(F.broadcast(table_), "year").select("year", *[(slope[k] > 0).alias(k) for k in _IN])
        share = signs.groupBy("year").agg(F.lit(name).alias("model"), *[F.avg(F.col(k).cast("double")).alias(k) for k in _IN], F.avg((F.col(_IN[0]) & F.col(_IN[1]) & F.col(_IN[2]) & F.col(_IN[3])).cast("double")).alias("all_inputs"))
        out = share if out is None else out.unionByName(share)
    return out


def names(spark, d):
    """Left entities and a directory with codes, names and former names, all out of ``part``."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("prov"), F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    key = F.col("p_partkey")
    left = p.select(key.alias("cid"), "prov", "name")
    return left, p.where("p_partkey % 3 <> 0").select(
        F.when(key % 2 == 0, key).otherwise(key + 1000000).alias("code"), "prov", F.when(key % 5 == 0, F.concat("name", F.lit(" NEW"))).when(key % 7 == 1, F.regexp_replace("name", "(STEEL|TIN|BRASS)$", "COPPER")).otherwise(F.col("name")).alias("gname"),
        F.when(key % 5 == 0, F.col("name")).alias("gold"),
    )


_NAMES = """p AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS prov, p_brand || ' ' || p_type AS name FROM part),
 g AS (SELECT CASE WHEN k%2=0 THEN k ELSE k+1000000 END AS code, prov, CASE WHEN k%5=0 THEN name || ' NEW' WHEN k%7=1 THEN regexp_replace(name,'(STEEL|TIN|BRASS)$','COPPER') ELSE name END AS gname, CASE WHEN k%5=0 THEN name END AS gold FROM p WHERE k%3<>0),
 n1 AS (SELECT prov, gname AS n, min(code) AS code FROM g GROUP BY 1,2), n2 AS (SELECT prov, gold AS n, min(code) AS code FROM g WHERE gold IS NOT NULL GROUP BY 1,2),
 n3 AS (SELECT prov, regexp_replace(gname,'(STEEL|TIN|BRASS|COPPER|NICKEL)$','') AS n, min(code) AS code FROM g GROUP BY 1,2),
 m AS (SELECT k AS cid, p.prov AS prov, name, g0.code AS c0, n1.code AS c1, n2.code AS c2, n3.code AS c3 FROM p LEFT JOIN (SELECT DISTINCT code FROM g) g0 ON g0.code=k LEFT JOIN n1 ON n1.prov=p.prov AND n1.n=name LEFT JOIN n2 ON n2.prov=p.prov AND n2.n=name LEFT JOIN n3 ON n3.prov=p.prov AND n3.n=regexp_replace(name,'(STEEL|TIN|BRASS|COPPER|NICKEL)$',''))"""


def matched(spark, d):
    left, dims = names(spark, d)
    return X.layered(left, dims, "(STEEL|TIN|BRASS|COPPER|NICKEL)$")


_HOW = "CASE WHEN c0 IS NOT NULL THEN 'code' WHEN c1 IS NOT NULL THEN 'name' WHEN c2 IS NOT NULL THEN 'former' WHEN c3 IS NOT NULL THEN 'stem' ELSE 'unmatched' END"


@query("j08_layered_fallback", f"WITH {_NAMES} SELECT cid, coalesce(c0,c1,c2,c3) AS map_code, {_HOW} AS how FROM m")
def j08(spark, d):
    return matched(spark, d).select("cid", "map_code", "how")


@query("j09_prefix_best_match")
def j09(spark, d):
    """The most similar name within province and first two letters, scored by matching blocks."""
    left, dims = names(spark, d)
    return X.best_by_prefix(left.where(F.col("cid") < 0).unionByName(left.join(dims.select(F.col("code").alias("cid")), "cid", "left_anti")), dims)


@query("x02_string_similarity")
def x02(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(X.similarity(F.col("p_type"), F.col("p_name")), 2).alias("ratio"))


_ACT = f"CASE WHEN cid%11=0 THEN 'remove_override' WHEN name IS NULL OR name='' THEN 'remove_noname' WHEN cid%100=0 THEN 'remove_prefecture' ELSE CASE {_HOW} WHEN 'code' THEN 'keep_adopt_name' WHEN 'name' THEN 'recode_name_match' WHEN 'former' THEN 'combine' WHEN 'stem' THEN 'ambiguous_dup' ELSE 'keep_rural' END END"


def roster(spark, d):
    how = F.col("how")
    action = X.resolved(
        [("remove_override", F.col("cid") % 11 == 0), ("remove_noname", F.col("name").isNull() | (F.col("name") == "")), ("remove_prefecture", F.col("cid") % 100 == 0), ("keep_adopt_name", how == "code"), ("recode_name_match", how == "name"), ("combine", how == "former"), ("ambiguous_dup", how == "stem")],
        "keep_rural",
    )
    return matched(spark, d).withColumn("action", action).withColumn("final_code", F.coalesce("map_code", "cid"))


@query("c18_roster_decisions", f"WITH {_NAMES} SELECT cid, {_ACT} AS action, coalesce(c0,c1,c2,c3,cid) AS final_code FROM m")
def c18(spark, d):
    return roster(spark, d).select("cid", "action", "final_code")


_DROPPED = ("ambiguous_dup", "remove_override", "remove_noname", "remove_prefecture")


@query("c19_crosswalk_applied", f"WITH {_NAMES}, r AS (SELECT cid, {_ACT} AS action, coalesce(c0,c1,c2,c3,cid) AS final_code FROM m), v AS (SELECT l_partkey AS cid, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2) SELECT final_code, year, round(sum(q),4) AS q FROM v JOIN r ON r.cid=v.cid WHERE action NOT IN {_DROPPED} GROUP BY 1,2")
def c19(spark, d):
    kept = roster(spark, d).where(~F.col("action").isin(*_DROPPED))
    v = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cid"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"))
    return X.applied(v, kept, ["q"]).withColumn("q", F.round("q", 4))


@query("c20_corrections", "WITH r AS (SELECT p_partkey AS cid, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 ELSE p_partkey END AS canon, p_retailprice AS v FROM part WHERE p_partkey % 13 <> 0) SELECT canon AS cid, arg_min(v, (CAST(cid<>canon AS INT), cid)) AS v, CAST(count(*) AS BIGINT) AS merged FROM r GROUP BY canon")
def c20(spark, d):
    """Renamed codes join their canonical one, whose own row goes first; removed codes go."""
    key = F.col("p_partkey")
    r = table(spark, d, "part").where(key % 13 != 0).select(key.alias("old"), F.when(key % 10 == 3, key - 1).otherwise(key).alias("cid"), F.col("p_retailprice").alias("v"))
    return r.groupBy("cid").agg(F.min_by("v", F.struct((F.col("old") != F.col("cid")).cast("int"), "old")).alias("v"), F.count(F.lit(1)).alias("merged"))
