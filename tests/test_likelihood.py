"""Wald tests against nested fits, and sizes of negative binomials against the likelihood itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import DESIGN, frame, irls, make, matrix
from tidemark.operators.design import crossed, model_table
from tidemark.operators.glm import Family, _digamma, fit_glm, fit_negbin2_likelihood, theta_score, value_counts
from tidemark.operators.terms import linear_hypothesis, type2_tests, wald_tests, wald_type2


def test_wald_equals_nested_fits_of_a_linear_model(spark):
    fit = fit_glm(model_table(frame(spark, make("gaussian")), DESIGN, "y"), DESIGN, Family("gaussian"))
    nested = {r["term"]: r for r in type2_tests(spark, fit).collect()}
    for row in wald_tests(spark, fit).collect():
        assert row["df"] == nested[row["term"]]["df"] and row["statistic"] == pytest.approx(nested[row["term"]]["statistic"], rel=1e-6)


def test_wald_of_counts_from_the_covariance(spark):
    data = make("negbin1")
    fit = fit_glm(model_table(frame(spark, data), DESIGN, "y"), DESIGN, Family("negbin1"))
    x = matrix(data)
    b, _, mu = irls(x, data[3], lambda m: m)
    v = np.linalg.inv(x.T @ (x * mu[:, None])) * fit.dispersion
    assert np.allclose(fit.covariance * fit.dispersion, v, rtol=1e-5, atol=1e-12)

    def stat(at):
        return b[at] @ np.linalg.solve(v[np.ix_(at, at)], b[at])

    got = {term: (df, s) for term, df, s, _ in wald_type2(fit)}
    assert got["f:g"] == (2, pytest.approx(stat([5, 6]), rel=1e-5))
    assert got["g"] == (1, pytest.approx(stat([3, 5, 6, 9]) - stat([5, 6, 9]), rel=1e-5))
    assert got["f"] == (2, pytest.approx(stat([1, 2, 5, 6, 7, 8]) - stat([5, 6, 7, 8]), rel=1e-5))


def test_no_covariance_and_columns_that_follow_from_each_other(spark):
    df = spark.createDataFrame([(g, float(i), i * 2.0, i * 1.5 + k) for i in range(9) for k, g in enumerate("ny")], "g string, t double, u double, y double")
    design = crossed({"g": ["n", "y"]}, ["t", "u"], 1)
    table = model_table(df, design, "y")
    with pytest.raises(ValueError):
        linear_hypothesis(fit_glm(table, design, Family("gaussian"), errors=False), ["t"])
    assert linear_hypothesis(fit_glm(table, design, Family("gaussian")), []) == 0.0


def test_digamma(spark):
    row = spark.range(1).select(*[c for x in (0.5, 1.0, 10.0) for c in _digamma(F.lit(x))]).first()
    euler = 0.5772156649015329
    assert row[0] == pytest.approx(-euler - 2 * math.log(2), abs=1e-13) and row[1] == pytest.approx(math.pi**2 / 2, rel=1e-13)
    assert row[2] == pytest.approx(-euler, abs=1e-13) and row[3] == pytest.approx(math.pi**2 / 6, rel=1e-13)
    assert row[4] == pytest.approx(sum(1 / k for k in range(1, 10)) - euler, rel=1e-13)


def log_likelihood(y, mu, theta):
    parts = [math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) + theta * math.log(theta / (theta + m)) + v * math.log(m / (theta + m)) for v, m in zip(y, mu)]
    return sum(parts)


def test_size_at_the_top_of_the_likelihood(spark):
    data = make("negbin2")
    x, y = matrix(data), data[3]
    df = frame(spark, data)
    table, counts = model_table(df, DESIGN, "y"), value_counts(df, DESIGN, "y")
    fit = fit_negbin2_likelihood(table, counts, DESIGN)
    theta = fit.family.theta
    b, unscaled, mu = irls(x, y, lambda m: m + m * m / theta)
    assert np.allclose(list(fit.estimates.values()), b, atol=1e-6)
    assert np.allclose(list(fit.unscaled_errors.values()), unscaled, rtol=1e-4)
    best = log_likelihood(y, mu, theta)
    assert best > log_likelihood(y, mu, theta * 1.001) and best > log_likelihood(y, mu, theta / 1.001)
    below = sum(1 / (theta + k) for v in y for k in range(int(v)))
    score = below + (np.log(theta / (theta + mu)) + 1 - (y + theta) / (mu + theta)).sum()
    assert abs(score) < 1e-4 and theta == pytest.approx(2.0, rel=0.2)


def test_score_of_the_size(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 0, 1, 4, 9, 9)] + [("b", 3.0), ("b", None), ("z", 5.0)], "f string, y double")
    design = crossed({"f": ["a", "b"]})
    counts = value_counts(df, design, "y")
    assert {r["value"]: r["rows"] for r in counts.collect()} == {0.0: 2, 1.0: 1, 4.0: 1, 9.0: 2, 3.0: 1}
    y, h = [0, 0, 1, 4, 9, 9, 3], 1e-5
    mu = [2.5] * 7
    first, second = theta_score(model_table(df, design, "y"), counts, F.lit(2.5), 1.7)
    assert first == pytest.approx((log_likelihood(y, mu, 1.7 + h) - log_likelihood(y, mu, 1.7 - h)) / (2 * h), rel=1e-6)
    up, down = (theta_score(model_table(df, design, "y"), counts, F.lit(2.5), 1.7 + s)[0] for s in (h, -h))
    assert second == pytest.approx((up - down) / (2 * h), rel=1e-5)


def test_counts_without_spread_are_poisson(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 4.0), ("b", 2.0), ("b", 2.0)], "f string, y double")
    design = crossed({"f": ["a", "b"]})
    with pytest.warns(UserWarning, match="no more than a Poisson"):
        fit = fit_negbin2_likelihood(model_table(df, design, "y"), value_counts(df, design, "y"), design)
    assert fit.family.theta == 1e8
