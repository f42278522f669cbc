"""Uniformity of residuals and influence of rows against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_models import DESIGN, frame, make, matrix
from tidemark.operators.design import model_table
from tidemark.operators.diagnostics import kolmogorov_distance, kolmogorov_p, lm_diagnostics, residual_uniformity
from tidemark.operators.glm import Family, fit_glm


def distance(u):
    u, k = np.sort(u), np.arange(1, len(u) + 1)
    return max((k / len(u) - u).max(), (u - (k - 1) / len(u)).max())


def sets():
    rng = np.random.default_rng(5)
    return {
        "even": rng.random(3000),
        "low": rng.random(2000) ** 3,
        "tied": rng.choice([0.0, 0.25, 0.25000001, 0.7, 1.0], 500),
        "crowded": 0.3 + rng.random(800) * 1e-5,
        "one": np.array([0.4]),
        "same": np.full(50, 0.5),
    }


def test_distance(spark):
    known = sets()
    rows = [(g, float(u)) for g, values in known.items() for u in values] + [("even", None), ("even", float("nan")), (None, 0.9)]
    got = {r["g"]: r for r in kolmogorov_distance(spark.createDataFrame(rows, "g string, u double").repartition(5), "u", ["g"]).collect()}
    assert set(got) == {*known, None}
    for g, values in known.items():
        assert (got[g]["n"], got[g]["ks"]) == (len(values), pytest.approx(distance(values), abs=1e-12)), g
    assert got[None]["ks"] == pytest.approx(0.9)
    whole = kolmogorov_distance(spark.createDataFrame([(float(u),) for u in known["low"]], "u double"), "u").first()
    assert whole["ks"] == pytest.approx(distance(known["low"]), abs=1e-12)
    assert kolmogorov_distance(spark.createDataFrame([], "g string, u double"), "u", ["g"]).count() == 0


def test_tail_of_the_distance(spark):
    # the limit distribution has its upper 5 % and 1 % points at 1.3581 and 1.6276
    n = 10**12
    x = spark.createDataFrame([(v / n**0.5,) for v in (1.3581, 1.6276, 0.1)], "ks double")
    got = [r[0] for r in x.select(kolmogorov_p(F.col("ks"), F.lit(n))).collect()]
    assert got[:2] == [pytest.approx(0.05, abs=1e-4), pytest.approx(0.01, abs=1e-4)] and got[2] == 1.0


def test_uniformity(spark):
    known = sets()
    rows = [(g, float(u)) for g in ("even", "low") for u in known[g]]
    got = {r["g"]: r for r in residual_uniformity(spark.createDataFrame(rows, "g string, u double"), "u", ["g"]).collect()}
    assert got["even"]["p_value"] > 0.01 > 1e-6 > got["low"]["p_value"]
    assert got["low"]["low_outliers"] == (known["low"] < 1 / 251).sum() and got["low"]["expected_outliers"] == pytest.approx(4000 / 251)
    assert got["even"]["spread"] == pytest.approx(12 * known["even"].var())


def test_influence(spark):
    data = make("gaussian", 400)
    df = frame(spark, data)
    fit = fit_glm(model_table(df, DESIGN, "y"), DESIGN, Family("gaussian"))
    x, y = matrix(data), data[3]
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    e, h = y - hat @ y, np.diag(hat)
    s2 = (e**2).sum() / (len(y) - x.shape[1])
    got = lm_diagnostics(df, fit, "y").orderBy("id").toPandas()
    assert np.allclose(got["leverage"], h) and np.allclose(got["residual"], e)
    assert np.allclose(got["standardised"], e / np.sqrt(s2 * (1 - h)))
    assert np.allclose(got["cook"], e**2 / s2 * h / (1 - h) ** 2 / x.shape[1])
    assert "Exchange hashpartitioning" not in lm_diagnostics(df, fit, "y")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        lm_diagnostics(df, fit_glm(model_table(df, DESIGN, "y"), DESIGN, Family("gaussian"), errors=False), "y")


def test_a_row_that_alone_decides_an_estimate(spark):
    rows = [(str(f), str(g), float(t), 1.0 * t + k) for k, (f, g, t) in enumerate([("a", "n", 0), ("a", "n", 1), ("a", "n", 2), ("b", "n", 1)])]
    from tidemark.operators.design import crossed

    design = crossed({"f": ["a", "b"]}, ["t"], 1)
    df = spark.createDataFrame(rows, "f string, g string, t double, y double")
    got = lm_diagnostics(df, fit_glm(model_table(df, design, "y"), design, Family("gaussian")), "y").where("f = 'b'").first()
    assert got["leverage"] == pytest.approx(1.0) and got["standardised"] is None and got["cook"] is None
