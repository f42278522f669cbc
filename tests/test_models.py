"""Fits against plain numpy solutions, term selection on known models, and residual checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails as T
from tidemark.operators.design import crossed, design_columns, design_matrix, model_table
from tidemark.operators.glm import (
    Family,
    coef_table,
    dispersion_by_level,
    fit_glm,
    fitted_mean,
    refit_by_dispersion,
    tweedie_power,
)
from tidemark.operators.residuals import durbin_watson, residual_summary, simulated_residuals
from tidemark.operators.terms import drop_terms, type2_tests

LEVELS = {"f": ["a", "b", "c"], "g": ["n", "y"]}
DESIGN = crossed(LEVELS, ["t"], 2)


def make(family, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    f, g = rng.choice(["a", "b", "c"], n), rng.choice(["n", "y"], n)
    t = rng.integers(0, 6, n).astype(float)
    eta = 1.0 + 0.5 * (f == "b") - 0.4 * (f == "c") + 0.3 * (g == "y") - 0.1 * t + 0.4 * (f == "b") * (g == "y")
    mu = np.exp(eta)
    if family == "poisson":
        y = rng.poisson(mu)
    elif family == "negbin2":
        y = rng.poisson(mu * rng.gamma(2.0, 0.5, n))
    elif family == "negbin1":
        y = rng.negative_binomial(mu / 1.5, 1 / 2.5)
    elif family == "tweedie":
        p, phi = 1.5, 2.0
        hits = rng.poisson(mu ** (2 - p) / (phi * (2 - p)))
        y = np.where(hits > 0, rng.gamma(np.maximum(hits, 1) * (2 - p) / (p - 1)) * phi * (p - 1) * mu ** (p - 1), 0.0)
    else:
        y = eta + rng.normal(0, 0.7, n)
    return f, g, t, y.astype(float)


def frame(spark, data):
    f, g, t, y = data
    rows = [(i, str(a), str(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(f, g, t, y))]
    return spark.createDataFrame(rows, "id int, f string, g string, t double, y double").repartition(4)


def matrix(data):
    f, g, t, _ = data
    fb, fc, gy = (f == "b") * 1.0, (f == "c") * 1.0, (g == "y") * 1.0
    return np.column_stack([np.ones(len(t)), fb, fc, gy, t, fb * gy, fc * gy, fb * t, fc * t, gy * t])


def irls(x, y, variance, rounds=100):
    """Estimates and unscaled errors of a log-link model."""
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.mean())
    for _ in range(rounds):
        mu = np.exp(x @ b)
        w = mu**2 / variance(mu)
        inv = np.linalg.inv(x.T @ (x * w[:, None]))
        b = inv @ (x.T @ (w * (x @ b + (y - mu) / mu)))
    return b, np.sqrt(np.diag(inv)), np.exp(x @ b)


def test_design_has_no_baseline_columns(spark):
    names = list(design_columns(DESIGN))
    assert names == ["f_b", "f_c", "g_y", "t", "f_b_x_g_y", "f_c_x_g_y", "f_b_x_t", "f_c_x_t", "g_y_x_t"]
    data = make("poisson", 200)
    got = design_matrix(frame(spark, data), DESIGN, ["id"]).orderBy("id").collect()
    assert np.allclose(np.array([list(r)[1:] for r in got], dtype=float), matrix(data)[:, 1:])


@pytest.mark.parametrize("family", ["negbin1", "tweedie"])
def test_quasi_families(spark, family):
    data = make(family)
    power = 1.0 if family == "negbin1" else 1.5
    x, y = matrix(data), data[3]
    b, unscaled, mu = irls(x, y, lambda m: m**power)
    phi = ((y - mu) ** 2 / mu**power).sum() / (len(y) - x.shape[1])
    table = model_table(frame(spark, data), DESIGN, "y")
    assert table.count() == 36
    fit = fit_glm(table, DESIGN, Family(family, power=1.5 if family == "tweedie" else None))
    assert np.allclose(list(fit.estimates.values()), b, atol=1e-7)
    assert fit.dispersion == pytest.approx(phi, rel=1e-7)
    assert np.allclose(list(fit.unscaled_errors.values()), unscaled, rtol=1e-5)
    rows = coef_table(spark, fit).collect()
    assert rows[1]["se"] == pytest.approx(unscaled[1] * math.sqrt(phi), rel=1e-5)
    assert fit.rows == len(y)


def test_negative_binomial(spark):
    data = make("negbin2")
    x, y = matrix(data), data[3]
    fit = fit_glm(model_table(frame(spark, data), DESIGN, "y"), DESIGN, Family("negbin2"))
    theta = fit.family.theta
    b, unscaled, mu = irls(x, y, lambda m: m + m * m / theta)
    assert np.allclose(list(fit.estimates.values()), b, atol=1e-6)
    assert np.allclose(list(fit.unscaled_errors.values()), unscaled, rtol=1e-4)
    n = len(y)
    moment = (((y - mu) ** 2).sum() * n / (n - x.shape[1]) - mu.sum()) / (mu**2).sum()
    assert theta == pytest.approx(1 / moment, rel=1e-5)
    assert theta == pytest.approx(2.0, rel=0.25)
    assert fit.rounds < 40


def test_gaussian(spark):
    data = make("gaussian")
    x, y = matrix(data), data[3]
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    fit = fit_glm(model_table(frame(spark, data), DESIGN, "y"), DESIGN, Family("gaussian"))
    assert np.allclose(list(fit.estimates.values()), b, atol=1e-9)
    assert fit.dispersion == pytest.approx(rss[0] / (len(y) - x.shape[1]))


def test_power_of_the_variance(spark):
    data = make("tweedie", 6000)
    assert tweedie_power(model_table(frame(spark, data), DESIGN, "y"), ["f", "g", "t"]) == pytest.approx(1.5, abs=0.21)


def test_rows_that_miss_a_variable_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 3.0), (None, 1.0, 3.0), ("a", 1.0, None), ("z", 1.0, 9.0), ("b", 2.0, 4.0)], "f string, t double, y double")
    table = model_table(df, crossed({"f": ["a", "b"]}, ["t"], 1), "y")
    assert table.agg(F.sum("n")).first()[0] == 2


def test_term_dropping_keeps_what_matters(spark):
    fit = fit_glm(model_table(frame(spark, make("poisson")), DESIGN, "y"), DESIGN, Family("poisson"))
    last, records = drop_terms(fit)
    left = set(last.design.terms)
    assert {("f",), ("g",), ("t",), ("f", "g")} <= left
    assert len(left) < len(DESIGN.terms)
    # only terms without a remaining larger term are ever tried
    assert all(":" in r[1] or ("t" == r[1]) for r in records)
    tests = {r["term"]: r for r in type2_tests(spark, last).collect()}
    assert tests["f:g"]["df"] == 2 and tests["f:g"]["p_value"] < 1e-6


def test_type2_equals_squared_t_for_one_degree(spark):
    design = crossed({"g": ["n", "y"]}, ["t"], 1)
    fit = fit_glm(model_table(frame(spark, make("gaussian")), design, "y"), design, Family("gaussian"))
    t = {r["term"]: r["statistic"] for r in coef_table(spark, fit).collect()}
    tests = {r["term"]: r for r in type2_tests(spark, fit).collect()}
    assert tests["g"]["statistic"] == pytest.approx(t["g_y"] ** 2, rel=1e-6)


def test_dispersion_by_level(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(i % 4), float(rng.normal(0, 3 if g == "y" else 1))) for i in range(4000) for g in ("n", "y")]
    df = spark.createDataFrame(rows, "g string, t double, y double")
    design = crossed({"g": ["n", "y"]}, ["t"], 1)
    fit = fit_glm(model_table(df, design, "y"), design, Family("gaussian"))
    spread = {r["g"]: r["dispersion"] for r in dispersion_by_level(fit, ["g"]).collect()}
    assert spread["n"] == pytest.approx(1, rel=0.1) and spread["y"] == pytest.approx(9, rel=0.1)
    again = refit_by_dispersion(fit, ["g"])
    assert again.dispersion == pytest.approx(1.0, rel=0.01)


@pytest.mark.parametrize("family, truth", [("poisson", "poisson"), ("negbin1", "negbin1"), ("negbin2", "negbin2"), ("gaussian", "gaussian"), ("tweedie", "tweedie")])
def test_residuals_of_a_right_model_are_uniform(spark, family, truth):
    df = frame(spark, make(truth, 2000, 7))
    fit = fit_glm(model_table(df, DESIGN, "y"), DESIGN, Family(family, power=1.5 if family == "tweedie" else None))
    out = simulated_residuals(df, fit, "y", ["id"])
    u = np.sort([r["scaled"] for r in out.collect()])
    assert len(u) == 2000 and u[0] >= 0 and u[-1] <= 1
    gap = np.abs(u - (np.arange(2000) + 0.5) / 2000).max()
    assert gap < 1.63 / math.sqrt(2000)  # Kolmogorov, 1 %


def test_residuals_do_not_depend_on_partitions(spark):
    df = frame(spark, make("negbin1", 500))
    fit = fit_glm(model_table(df, DESIGN, "y"), DESIGN, Family("negbin1"))
    one = {r["id"]: r["scaled"] for r in simulated_residuals(df.repartition(1), fit, "y", ["id"]).collect()}
    many = {r["id"]: r["scaled"] for r in simulated_residuals(df.repartition(5), fit, "y", ["id"]).collect()}
    assert one == many


def test_wrong_model_shows(spark):
    df = frame(spark, make("negbin2", 2000, 3))
    fit = fit_glm(model_table(df, DESIGN, "y"), DESIGN, Family("poisson"))
    u = np.array([r["scaled"] for r in simulated_residuals(df, fit, "y", ["id"]).collect()])
    assert ((u < 0.02) | (u > 0.98)).mean() > 0.08


def test_durbin_watson(spark):
    rng = np.random.default_rng(2)
    white, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    rows = [("white", i, float(v)) for i, v in enumerate(white)] + [("walk", i, float(v)) for i, v in enumerate(walk)]
    out = {r["k"]: r for r in durbin_watson(spark.createDataFrame(rows, "k string, t int, r double"), "r", "t", ["k"]).collect()}
    c = white - white.mean()
    assert out["white"]["dw"] == pytest.approx((np.diff(c) ** 2).sum() / (c**2).sum())
    assert abs(out["white"]["z"]) < 3 and out["walk"]["z"] < -10


def test_residual_summary(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, r double")
    row = residual_summary(df, "r", ["k"]).first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_high"], row["outliers"], row["av"]) == (2, 3, 4, 4, 1, 22)


def test_tails():
    assert T.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert T.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05)
    assert T.chi2_upper(0.5, 4) == pytest.approx(0.9735009788392561)
    assert T.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert T.f_upper(2.5, 3, 7) == pytest.approx(1 - 0.8563, abs=2e-3)
    assert T.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert T.t_quantile(0.975, 16) == pytest.approx(2.119905299221011)
    assert T.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_nine_models(spark, raw, responses, abundance):
    from tidemark.plans import figures as G
    from tidemark.plans import grazers as Z
    from tidemark.plans.models import checked, fit_plan, model_named, simplified
    from tidemark.plans.surveys import canopy_clean
    from tidemark.session import settle

    pool = Z.weighed_pool(raw["sizes"], Z.published_curves(spark))
    data = {
        "biomass": settle(Z.herbivore_biomass(Z.abundance_weights(abundance, pool))),
        "lottia": abundance.where("species = 'Lottia'"),
        "littorina": abundance.where("species = 'Littorina'"),
        "siphonaria": abundance.where("species = 'Siphonaria'"),
        "ephemerals": G.equinox_subset(G.ephemerals(responses)),
        "perennials": G.equinox_subset(G.perennials(responses)),
        "canopy": canopy_clean(raw["canopy"]).where("barnacles in ('no', 'yes')"),
        "balanus": G.of_species(responses, "Balanus_recruits"),
        "chthamalus": G.of_species(responses, "Chthamalus_recruits"),
    }
    rows = {"biomass": 492, "lottia": 120, "littorina": 360, "siphonaria": 132, "ephemerals": 205, "perennials": 205, "canopy": 359, "balanus": 692, "chthamalus": 360}
    for name, df in data.items():
        fit = fit_plan(model_named(name), df)
        assert fit.rows == rows[name], name
        assert all(math.isfinite(v) for v in fit.estimates.values()), name
        assert fit.dispersion > 0, name
        # with an intercept and a canonical or saturated mean, fitted and observed totals stay close
        total = fit.table.agg(F.sum(F.col("n") * F.col("mean")).alias("y"), F.sum(F.col("n") * fitted_mean(fit)).alias("m")).first()
        if fit.family.name in ("gaussian", "negbin1"):
            assert total["m"] == pytest.approx(total["y"], rel=1e-6), name

    plan = model_named("siphonaria")
    fit = fit_plan(plan, data["siphonaria"], by_dispersion=True)
    checks = checked(plan, fit, data["siphonaria"], ["plot", "date", "barnacles"])
    assert checks["rows"].count() == 132
    assert checks["time"].first()["n_times"] == 11
    assert checks["by_barnacles"].agg(F.sum("n")).first()[0] == 132
    last, record = simplified(fit)
    assert record.count() >= 1 and len(last.design.terms) >= 1


FAMILIES = [Family("gaussian"), Family("poisson"), Family("negbin1"), Family("negbin2"), Family("tweedie", power=1.5)]


@pytest.mark.parametrize("family", FAMILIES, ids=lambda f: f.name)
def test_errors_of_saturated_designs(spark, family):
    rng = np.random.default_rng(11)
    rows = [(a, b, float(rng.poisson(4 + 3 * (a == "v") + 2 * (b == "q")))) for _ in range(500) for a in "uv" for b in "pq"]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    design = crossed({"a": ["u", "v"], "b": ["p", "q"]})
    fit = fit_glm(model_table(df, design, "y"), design, family)
    cells = {}
    for a, b, y in rows:
        cells.setdefault((a, b), []).append(y)

    def information(key):
        mu = np.mean(cells[key])
        power, theta = fit.family.power, fit.family.theta
        by_family = {"gaussian": 1.0, "tweedie": mu ** (2 - (power or 0)), "negbin2": mu / (1 + mu / (theta or 1))}
        return 500 * by_family.get(family.name, mu)

    expected = {
        "intercept": [("u", "p")],
        "a_v": [("u", "p"), ("v", "p")],
        "b_q": [("u", "p"), ("u", "q")],
        "a_v_x_b_q": [(a, b) for a in "uv" for b in "pq"],
    }
    for name, keys in expected.items():
        assert fit.unscaled_errors[name] == pytest.approx(math.sqrt(sum(1 / information(k) for k in keys)), rel=1e-6)


@pytest.mark.parametrize("family", ["gaussian", "negbin1"])
def test_refitted_dispersion_reaches_the_residuals(spark, family):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(6000):
        g = "nxy"[k % 3] if k < 5400 else "n"
        phi, mu = {"n": 1.5, "x": 9.0, "y": 3.0}[g], 20.0
        y = rng.normal(mu, math.sqrt(phi)) if family == "gaussian" else rng.negative_binomial(mu / (phi - 1), 1 / phi)
        rows.append((k, g, float(k % 4), float(y)))
    df = spark.createDataFrame(rows, "id long, g string, t double, y double")
    design = crossed({"g": ["n", "x", "y"]}, ["t"], 1)
    fit = refit_by_dispersion(fit_glm(model_table(df, design, "y"), design, Family(family)), ["g"])
    first = simulated_residuals(df, fit, "y", ["id"])
    again = simulated_residuals(df, fit, "y", ["id"])  # the frame itself is as it was
    assert df.columns == ["id", "g", "t", "y"] and first.columns == again.columns
    scaled = {}
    for r in first.collect():
        scaled.setdefault(r["g"], []).append(r["scaled"])
    for u in scaled.values():
        u = np.sort(u)
        assert np.abs(u - (np.arange(len(u)) + 0.5) / len(u)).max() < 1.63 / math.sqrt(len(u))


def test_dispersion_along_a_covariate(spark):
    rng = np.random.default_rng(13)
    rows = [("g", float(t), float(rng.normal(0, math.exp(0.2 * t)))) for t in range(6) for _ in range(2000)]
    rows += [("h", float(t), 1.0) for t in range(6)]
    df = spark.createDataFrame(rows, "g string, t double, y double")
    design = crossed({"g": ["g", "h"]}, ["t"], 1)
    fit = fit_glm(model_table(df, design, "y"), design, Family("gaussian"))
    again = refit_by_dispersion(fit, ["t"], along="t")
    spread = {r["t"]: r["dispersion"] for r in again.spread.collect()}
    assert all(spread[float(t)] == pytest.approx(math.exp(0.4 * t), rel=0.15) for t in range(6))


def test_levels_without_spread_do_not_rule_the_refit(spark):
    rows = [("n", float(k % 3), float(k % 5)) for k in range(300)] + [("y", float(k % 3), 2.0) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t double, y double")
    design = crossed({"g": ["n", "y"]}, ["t"])
    fit = fit_glm(model_table(df, design, "y"), design, Family("gaussian"))
    assert max(r["dispersion"] for r in refit_by_dispersion(fit, ["g"]).spread.collect()) < 10 * fit.dispersion
    assert min(r["dispersion"] for r in refit_by_dispersion(fit, ["g"]).spread.collect()) == pytest.approx(fit.dispersion)


def test_models_of_one_term(spark):
    rng = np.random.default_rng(14)
    rows = [(g, float(rng.normal(5 + (g == "y"), 1))) for _ in range(200) for g in "ny"]
    df = spark.createDataFrame(rows, "g string, y double")
    design = crossed({"g": ["n", "y"]})
    cells = model_table(df, design, "y")
    fit = fit_glm(cells, design, Family("gaussian"))
    groups = [np.array([y for g, y in rows if g == k]) for k in "ny"]
    grand = np.concatenate(groups).mean()
    f = sum(len(v) * (v.mean() - grand) ** 2 for v in groups) / fit.dispersion
    (test,) = type2_tests(spark, fit).collect()
    assert test["term"] == "g" and test["df"] == 1 and test["statistic"] == pytest.approx(f, rel=1e-6)
    last, records = drop_terms(fit)
    assert len(records) == 1 and not records[0][-1] and last.estimates == fit.estimates
    same = spark.createDataFrame([(g, y) for (g, _), (_, y) in zip(rows, rows[1:] + rows[:1])], "g string, y double").sample(1.0)
    flat = fit_glm(model_table(same.withColumn("y", F.lit(3.0) + F.col("y") * 0), design, "y"), design, Family("poisson"))
    empty, dropped = drop_terms(flat)
    assert empty.design.terms == () and empty.estimates["intercept"] == pytest.approx(math.log(3)) and dropped[0][-1]


def test_power_at_the_end_of_the_grid_is_told(spark):
    rng = np.random.default_rng(15)
    rows = [(g, float(5 * (k + 1) + rng.normal())) for k, g in enumerate("pqr") for _ in range(300)]
    design = crossed({"g": ["p", "q", "r"]})
    cells = model_table(spark.createDataFrame(rows, "g string, y double"), design, "y")
    with pytest.warns(UserWarning, match="end of the grid"):
        assert tweedie_power(cells, ["g"]) == 1.1
    flat = model_table(spark.createDataFrame([("p", 2.0), ("p", 2.0)], "g string, y double"), design, "y")
    with pytest.warns(UserWarning, match="no group"):
        tweedie_power(flat, ["g"])


def test_tails_of_large_counts(spark):
    from tidemark.operators.residuals import count_tails

    cases = [(2.0, math.inf, 3.0), (100_000.0, math.inf, 100_000.0), (1.5, 2.0, 0.0), (2.0, 4.0, 3.0), (2.0, 1e8, 3.0), (2.0, math.inf, 2.5), (2.0, math.inf, -1.0), (0.0, math.inf, 1.0)]
    found = {(r["tm_mu"], r["tm_size"], r["tm_y"]): (r["below"], r["upto"]) for r in count_tails(spark.createDataFrame(cases, "tm_mu double, tm_size double, tm_y double")).collect()}
    below, upto = zip(*[found[c] for c in cases])
    poisson = [math.exp(-2) * 2**k / math.factorial(k) for k in range(4)]
    assert below[0] == pytest.approx(sum(poisson[:3])) and upto[0] == pytest.approx(sum(poisson))
    assert below[1] == pytest.approx(0.5, abs=0.01) and upto[1] > below[1]
    assert below[2] == 0 and upto[2] == pytest.approx((2 / 3.5) ** 2)
    binomial = [math.comb(k + 3, k) * (4 / 6) ** 4 * (2 / 6) ** k for k in range(4)]
    assert below[3] == pytest.approx(sum(binomial[:3])) and upto[3] == pytest.approx(sum(binomial))
    assert below[4] == pytest.approx(sum(poisson[:3]), rel=1e-6) and upto[4] == pytest.approx(sum(poisson), rel=1e-6)  # nearly a Poisson
    assert below[5] == upto[5] == pytest.approx(sum(poisson[:3])) and (below[6], upto[6]) == (0, 0) and (below[7], upto[7]) == (1, 1)


def test_far_tails():
    from tidemark.functions.tails import chi2_upper

    assert chi2_upper(100, 1) == pytest.approx(math.erfc(math.sqrt(50)), rel=1e-10)
    assert chi2_upper(100, 4) == pytest.approx(math.exp(-50) * 51, rel=1e-10)
    assert chi2_upper(1, 4) == pytest.approx(math.exp(-0.5) * 1.5, rel=1e-10)


def test_levels_that_differ_in_signs_only(spark):
    rows = [("none", 1.0), ("none", 2.0), ("+B", 11.0), ("+B", 12.0), ("-B", 21.0), ("-B", 22.0), ("é", 31.0), ("é", 32.0), ("ü", 41.0), ("ü", 42.0)]
    design = crossed({"g": ["none", "+B", "-B", "é", "ü"]})
    fit = fit_glm(model_table(spark.createDataFrame(rows, "g string, y double"), design, "y"), design, Family("gaussian"))
    found = sorted(round(r["estimate"], 6) for r in coef_table(spark, fit).collect())
    assert found == [1.5, 10.0, 20.0, 30.0, 40.0]
    with pytest.raises(ValueError, match="share|several"):
        design_columns(crossed({"a": ["x", "b_c"], "a_b": ["x", "c"]}))


def test_p_values_of_the_one_factor_model(spark):
    from tidemark.operators.oneway import anova_oneway, oneway_ols

    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 7.0)]
    df = spark.createDataFrame(rows, "f string, y double")
    row = anova_oneway(df, "f", "y").first()
    slope = oneway_ols(df, "f", "y", "a").where("term = 'b'").first()
    assert row["p_value"] == pytest.approx(slope["p_value"], rel=1e-9)  # F = t squared
    t, tail = slope["t_value"], slope["p_value"]
    x = t / math.sqrt(4 + t * t)  # the t distribution with 4 degrees of freedom in closed form
    assert tail == pytest.approx(1 - 1.5 * (x - x**3 / 3), rel=1e-9)
