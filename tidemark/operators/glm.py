"""Fixed-effects generalised linear models over design cells.

These approximate mixed models: blocks enter as fixed effects, and dispersion, the power of
the variance and the size of a negative binomial come from moments.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tails import chi2_upper, f_upper, normal_two_sided, t_two_sided
from tidemark.operators.combine import join_groups
from tidemark.operators.design import Design, design_columns
from tidemark.session import settle

INTERCEPT = "intercept"
MAX_ROUNDS = 100
# Candidate powers between a Poisson (1) and a gamma (2) response.
POWER_GRID = [1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9]


@dataclass(frozen=True)
class Family:
    """gaussian (identity link), or poisson, tweedie, negbin1, negbin2 (log link)."""

    name: str
    power: float | None = None
    theta: float | None = None

    @property
    def log_link(self) -> bool:
        return self.name != "gaussian"

    @property
    def free_dispersion(self) -> bool:
        return self.name in ("gaussian", "tweedie", "negbin1")


def variance(family: Family, mu: Column) -> Column:
    if family.name == "gaussian":
        return F.lit(1.0)
    if family.name == "tweedie":
        return F.pow(mu, F.lit(family.power))
    if family.name == "negbin2":
        return mu + mu * mu / F.lit(family.theta)
    return mu


def unit_deviance(family: Family, y: Column, mu: Column) -> Column:
    if family.name == "gaussian":
        return (y - mu) * (y - mu)
    if family.name == "tweedie":
        p = family.power
        return 2 * (
            F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))
            - y * F.pow(mu, F.lit(1 - p)) / (1 - p)
            + F.pow(mu, F.lit(2 - p)) / (2 - p)
        )
    own = F.when(y > 0, y * F.ln(y / mu)).otherwise(0.0)
    if family.name == "negbin2":
        t = F.lit(family.theta)
        return 2 * (own - (y + t) * F.ln((y + t) / (mu + t)))
    return 2 * (own - (y - mu))


@dataclass(frozen=True)
class Fit:
    table: DataFrame
    design: Design
    family: Family
    weight: str
    estimates: dict[str, float]
    #: Covariance of the estimates for a dispersion of one, in their order; None where it was left out.
    covariance: np.ndarray | None
    rows: float
    dispersion: float
    deviance: float
    rounds: int = 1
    #: After a refit: the dispersion of each level, as a table, and the columns that name the level.
    spread: DataFrame | None = None
    spread_by: tuple[str, ...] = ()

    @property
    def residual_df(self) -> float:
        return self.rows - len(self.estimates)

    @property
    def unscaled_errors(self) -> dict[str, float]:
        if self.covariance is None:
            return {}
        with np.errstate(invalid="ignore"):
            return dict(zip(self.estimates, map(float, np.sqrt(np.diag(self.covariance)))))

    @property
    def scale(self) -> float:
        return self.dispersion if self.family.free_dispersion else 1.0


def linear_predictor(estimates: dict[str, float], columns: dict[str, Column] | None = None) -> Column:
    """The fitted line as an expression over the design columns, by name or by definition."""
    eta = F.lit(estimates[INTERCEPT])
    for name, b in estimates.items():
        if name != INTERCEPT:
            eta = eta + F.lit(b) * (F.col(name) if columns is None else columns[name])
    return eta


def fitted_mean(fit: Fit, on_rows: bool = False) -> Column:
    """Fitted mean over the cell table, or over rows that hold the factors and covariates."""
    eta = linear_predictor(fit.estimates, design_columns(fit.design) if on_rows else None)
    return F.exp(eta) if fit.family.log_link else eta


def _assembled(table: DataFrame, names: Sequence[str], weight: str) -> DataFrame:
    """The cell table with its design columns as one vector, kept in memory for repeated fits."""
    kept = dict.fromkeys(["n", "mean", "ss", weight, *names])
    return VectorAssembler(inputCols=list(names), outputCol="x").transform(table).select(*[F.col(f"`{c}`") for c in kept], "x").cache()


def _fit_mean(table: DataFrame, design: Design, family: Family, weight: str, errors: bool) -> Fit:
    """The model without any term: one weighted mean, whatever the family."""
    w = F.col(weight)
    level = table.agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("m")).first()["m"]
    mu = F.lit(float(level))
    rows, pearson, deviance = _moments(table, family, mu, weight)
    unscaled = _unscaled_covariance(table, [], family, mu, weight) if errors else None
    estimates = {INTERCEPT: math.log(level) if family.log_link else float(level)}
    return Fit(table, design, family, weight, estimates, unscaled, rows, pearson / (rows - 1), deviance)


def _glm(label: str, weight: str, family: Family) -> GeneralizedLinearRegression:
    options = {"family": "gaussian"}
    if family.name in ("poisson", "negbin1"):
        options = {"family": "poisson", "link": "log"}
    elif family.name == "tweedie":
        options = {"family": "tweedie", "variancePower": family.power, "linkPower": 0.0}
    return GeneralizedLinearRegression(
        featuresCol="x", labelCol=label, weightCol=weight, linkPredictionCol="eta",
        maxIter=MAX_ROUNDS, tol=1e-12, regParam=0.0, **options,
    )


def _estimates(model: GeneralizedLinearRegressionModel, names: Sequence[str]) -> dict[str, float]:
    return {INTERCEPT: model.intercept, **dict(zip(names, map(float, model.coefficients)))}


def _unscaled_covariance(cells: DataFrame, names: Sequence[str], family: Family, mu: Column, weight: str) -> np.ndarray:
    """Covariance of the estimates for a dispersion of one: the inverse of X'WX.

    The sums of products come from one pass over the cells, a column for each pair of estimates;
    the driver inverts the small matrix. Saturated designs need no dispersion for that.
    """
    x = [F.lit(1.0), *[F.col(f"`{n}`") for n in names]]
    size = len(x)
    work = F.col(weight) * (mu * mu / variance(family, mu) if family.log_link else F.lit(1.0))
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    sums = cells.withColumn("tm_w", work).agg(*[F.sum(F.col("tm_w") * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    information = np.zeros((size, size))
    for i, j in pairs:
        information[i, j] = information[j, i] = float("nan") if sums[f"s{i}_{j}"] is None else sums[f"s{i}_{j}"]
    scale = np.sqrt(np.diag(information))
    try:
        return np.linalg.inv(information / np.outer(scale, scale)) / np.outer(scale, scale)
    except np.linalg.LinAlgError:  # columns that follow from each other
        return np.full((size, size), np.nan)


def _moments(table: DataFrame, family: Family, mu: Column, weight: str) -> tuple[float, float, float]:
    """Rows, Pearson sum and deviance of a fit; ``weight`` over ``n`` is the inverse dispersion of a cell."""
    y, n, w = F.col("mean"), F.col("n"), F.col(weight)
    pearson = (F.col("ss") + n * (y - mu) * (y - mu)) / variance(family, mu) * (w / n)
    row = table.agg(
        F.sum("n").alias("rows"),
        F.sum(pearson).alias("pearson"),
        F.sum(w * unit_deviance(family, y, mu)).alias("deviance"),
    ).first()
    return row["rows"], row["pearson"], row["deviance"]


def fit_glm(
    table: DataFrame, design: Design, family: Family, weight: str = "n", errors: bool = True
) -> Fit:
    """Fit a family to a :func:`~tidemark.operators.design.model_table`.

    ``errors=False`` leaves the standard errors out and saves the pass they need, for fits that
    are only compared by deviance.
    """
    if family.name == "negbin2":
        return fit_negbin2(table, design, weight, theta=family.theta, errors=errors)
    names = list(design_columns(design))
    if not names:
        return _fit_mean(table, design, family, weight, errors)
    cells = _assembled(table, names, weight)
    model = _glm("mean", weight, family).fit(cells)
    if model.summary.numIterations >= MAX_ROUNDS:
        warnings.warn(f"the fit stopped after {MAX_ROUNDS} rounds without settling", stacklevel=2)
    mu = F.exp("eta") if family.log_link else F.col("eta")
    fitted = model.transform(cells)
    rows, pearson, deviance = _moments(fitted, family, mu, weight)
    estimates = _estimates(model, names)
    unscaled = _unscaled_covariance(fitted, names, family, mu, weight) if errors else None
    cells.unpersist()
    return Fit(table, design, family, weight, estimates, unscaled, rows, pearson / (rows - len(estimates)), deviance)


def fit_negbin2(
    table: DataFrame,
    design: Design,
    weight: str = "n",
    theta: float | None = None,
    rounds: int = 100,
    tol: float = 1e-6,
    errors: bool = True,
) -> Fit:
    """Negative binomial with quadratic variance by iteratively reweighted least squares.

    Each round is a weighted linear fit of the working response, written as columns over the
    same cell table and the last model's prediction, so the plan does not grow. Unless given,
    theta follows from E[(y - mu)^2] = mu + mu^2 / theta, corrected for the number of estimates.
    """
    names = list(design_columns(design))
    if not names:
        return _negbin2_mean(table, design, weight, theta, errors)
    cells = _assembled(table, names, weight)
    fixed, mu = theta is not None, F.exp("eta")
    model = _glm("mean", weight, Family("poisson")).fit(cells)  # start from the Poisson fit
    line = _glm("z", "v", Family("gaussian"))
    done = 0
    for done in range(1, rounds + 1):
        before = _estimates(model, names)
        fitted = model.transform(cells)
        if not fixed:
            theta = _moment_theta(fitted, mu, len(before))
        work = fitted.select(
            "x",
            (F.col("eta") + (F.col("mean") - mu) / mu).alias("z"),
            (F.col(weight) * mu / (1 + mu / F.lit(theta))).alias("v"),
        )
        model = line.fit(work)
        after = _estimates(model, names)
        if max(abs(after[k] - before[k]) for k in after) < tol:
            break
    else:
        warnings.warn(f"estimates still moved by more than {tol} after {rounds} rounds", stacklevel=2)
    family = Family("negbin2", theta=theta)
    fitted = model.transform(cells)
    rows, pearson, deviance = _moments(fitted, family, mu, weight)
    estimates = _estimates(model, names)
    unscaled = _unscaled_covariance(fitted, names, family, mu, weight) if errors else None
    cells.unpersist()
    dispersion = pearson / (rows - len(estimates))
    return Fit(table, design, family, weight, estimates, unscaled, rows, dispersion, deviance, done)


def _negbin2_mean(table: DataFrame, design: Design, weight: str, theta: float | None, errors: bool) -> Fit:
    """The negative binomial without any term."""
    if theta is None:
        start = _fit_mean(table, design, Family("poisson"), weight, False)
        theta = _moment_theta(table, F.lit(math.exp(start.estimates[INTERCEPT])), 1)
    return _fit_mean(table, design, Family("negbin2", theta=theta), weight, errors)


def value_counts(df: DataFrame, design: Design, response: str) -> DataFrame:
    """(value, rows) of the response over the rows that :func:`~tidemark.operators.design.model_table` uses."""
    used = df.na.drop("any", subset=[response, *design.variables])
    for factor, levels in design.factors.items():
        used = used.where(F.col(factor).isin(list(levels)))
    counted = used.groupBy(F.col(response).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return settle(counted, "counts")


def _digamma(x: Column) -> tuple[Column, Column]:
    """First and second derivative of ln gamma: twelve steps of the recurrence, then the asymptotic series."""
    z = x + 12
    r = 1 / (z * z)
    first = F.ln(z) - 1 / (2 * z) - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    second = 1 / z + r / 2 + r / z * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    for j in range(12):
        first, second = first - 1 / (x + j), second + 1 / ((x + j) * (x + j))
    return first, second


def theta_score(cells: DataFrame, counts: DataFrame, mu: Column, theta: float) -> tuple[float, float]:
    """Derivatives of the log-likelihood of a negative binomial in its size: first and second.

    The gamma functions depend on the rows only through the distinct counts and how often each
    occurs, all else through the cells; both are single aggregations.
    """
    t, y, n = F.lit(float(theta)), F.col("mean"), F.col("n")
    (psi, psi1), (psi_0, psi1_0) = _digamma(F.col("value") + t), _digamma(t)
    own = counts.agg(F.sum(F.col("rows") * (psi - psi_0)).alias("s"), F.sum(F.col("rows") * (psi1 - psi1_0)).alias("d")).first()
    rest = cells.agg(
        F.sum(n * ((mu - y) / (mu + t) - F.log1p(mu / t))).alias("s"),
        F.sum(n * (mu / (t * (mu + t)) - (mu - y) / ((mu + t) * (mu + t)))).alias("d"),
    ).first()
    return own["s"] + rest["s"], own["d"] + rest["d"]


MOST_THETA = 1e8


def likelihood_theta(cells: DataFrame, counts: DataFrame, mu: Column, start: float, tol: float = 1e-10) -> float:
    """Size of a negative binomial with given means at the maximum of the likelihood, by Newton steps in its logarithm."""
    theta = min(max(start, 1e-4), MOST_THETA)
    for _ in range(100):
        first, second = theta_score(cells, counts, mu, theta)
        slope, bend = theta * first, theta * first + theta * theta * second
        step = -slope / bend if bend < 0 else math.copysign(2.0, slope)
        step = min(max(step, -2.0), 2.0)
        theta *= math.exp(step)
        if theta >= MOST_THETA:
            warnings.warn("counts spread no more than a Poisson; theta is taken as 1e8", stacklevel=2)
            return MOST_THETA
        if abs(step) < tol:
            return theta
    warnings.warn("theta still moved after 100 steps", stacklevel=2)
    return theta


def fit_negbin2_likelihood(table: DataFrame, counts: DataFrame, design: Design, rounds: int = 50, tol: float = 1e-8) -> Fit:
    """Negative binomial with mean and size at the maximum of their joint likelihood.

    Both are found in turn, each given the other, until the size settles; the start is the size from
    moments. ``counts`` are the :func:`value_counts` of the rows behind the ``table``.
    """
    fit = fit_negbin2(table, design, errors=False)
    start = theta = fit.family.theta or 1.0
    for _ in range(rounds):
        new = likelihood_theta(table, counts, fitted_mean(fit), theta)
        settled = abs(new - theta) <= tol * theta
        theta = new
        fit = fit_negbin2(table, design, theta=theta, errors=settled)
        if settled:
            return fit
    warnings.warn(f"theta still moved after {rounds} rounds, from {start} to {theta}", stacklevel=2)
    return fit_negbin2(table, design, theta=theta)


def _moment_theta(fitted: DataFrame, mu: Column, estimates: int) -> float:
    y, n = F.col("mean"), F.col("n")
    row = fitted.agg(
        F.sum(F.col("ss") + n * (y - mu) * (y - mu)).alias("squares"),
        F.sum(n * mu).alias("first"),
        F.sum(n * mu * mu).alias("second"),
        F.sum("n").alias("rows"),
    ).first()
    spread = row["squares"] * row["rows"] / (row["rows"] - estimates)
    excess = (spread - row["first"]) / row["second"]
    if excess < 1e-8:
        warnings.warn("counts spread no more than a Poisson; theta is taken as 1e8", stacklevel=3)
    return 1.0 / max(excess, 1e-8)


def tweedie_power(table: DataFrame, by: Sequence[str]) -> float:
    """Power of the variance, by a grid search over the profile likelihood of the group variances.

    The variance of a group with m rows and mean a is taken as gamma with mean phi * a**p and
    m - 1 degrees of freedom; phi is profiled out. All powers are judged in one pass over the
    groups. A best power at an end of the grid, or groups without spread, give a warning.
    """
    groups = table.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.sum(F.col("ss") + F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
    ).where((F.col("rows") > 1) & (F.col("total") > 0))
    mean = F.col("total") / F.col("rows")
    squares = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0))
    free = F.col("rows") - 1
    row = groups.agg(
        F.sum(free).alias("free"),
        F.sum(free * F.ln(mean)).alias("logs"),
        *[F.sum(squares / F.pow(mean, F.lit(p))).alias(f"p{k}") for k, p in enumerate(POWER_GRID)],
    ).first()
    if not row["free"] or not row["p0"]:
        warnings.warn("no group shows any spread; the power is taken as 1.5", stacklevel=2)
        return 1.5
    best = min(range(len(POWER_GRID)), key=lambda k: row["free"] * math.log(row[f"p{k}"]) + POWER_GRID[k] * row["logs"])
    if best in (0, len(POWER_GRID) - 1):
        warnings.warn(f"the best power, {POWER_GRID[best]}, is at the end of the grid", stacklevel=2)
    return POWER_GRID[best]


def dispersion_by_level(fit: Fit, by: Sequence[str]) -> DataFrame:
    """Pearson residual variance per level, from the cell table alone."""
    mu = fitted_mean(fit)
    pearson = (F.col("ss") + F.col("n") * F.pow(F.col("mean") - mu, F.lit(2.0))) / variance(fit.family, mu)
    return fit.table.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("rows"), (F.sum(pearson) / F.sum("n")).alias("dispersion")
    )


def refit_by_dispersion(fit: Fit, by: Sequence[str], along: str | None = None) -> Fit:
    """Second fit with cells weighted by the inverse dispersion of their level.

    With ``along``, a covariate among ``by``, ln(dispersion) is a straight line in it instead of a
    free value per level (a gamma fit of the level dispersions, weighted by their rows). A level
    without any spread tells nothing about its dispersion and takes that of the first fit. The
    levels stay with the result, so that residuals can be simulated with them.
    """
    levels = dispersion_by_level(fit, by)
    if along is not None:
        levels = _dispersion_line(settle(levels, "levels"), along)
    known = F.col("dispersion") > F.lit(1e-9 * fit.dispersion)
    levels = settle(levels.select(*by, F.when(known, F.col("dispersion")).otherwise(F.lit(fit.dispersion)).alias("dispersion")), "levels")
    table = join_groups(fit.table, levels, by, "inner")
    table = settle(table.withColumn("w", F.col("n") / F.col("dispersion")).drop("dispersion"), "cells")
    return replace(fit_glm(table, fit.design, fit.family, "w"), spread=levels, spread_by=tuple(by))


def _dispersion_line(levels: DataFrame, along: str) -> DataFrame:
    """Level dispersions on a log-linear trend."""
    rows = VectorAssembler(inputCols=["tm_along"], outputCol="tm_x").transform(levels.withColumn("tm_along", F.col(along).cast("double")))
    line = GeneralizedLinearRegression(featuresCol="tm_x", labelCol="dispersion", weightCol="tm_rows", family="gamma", link="log", predictionCol="tm_line")
    model = line.fit(rows.where("dispersion > 0").withColumn("tm_rows", F.col("rows").cast("double")))
    return model.transform(rows).withColumn("dispersion", F.col("tm_line")).select(*levels.columns)


def coef_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """Estimates with standard errors, Wald statistics and two-sided p values."""
    rows = []
    for name, b in fit.estimates.items():
        se = fit.unscaled_errors[name] * math.sqrt(fit.scale)
        stat = b / se if se > 0 else float("nan")  # no error without spread
        if math.isnan(stat):
            p = float("nan")
        elif fit.family.free_dispersion:
            p = t_two_sided(stat, fit.residual_df)
        else:
            p = normal_two_sided(stat)
        rows.append((name, float(b), float(se), float(stat), float(p)))
    return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, p_value double")


def compare_nested(small: Fit, large: Fit, scale: float) -> tuple[int, float, float, float]:
    """Degrees of freedom, scaled deviance difference, its p value and the change in AIC when dropping."""
    df = len(large.estimates) - len(small.estimates)
    stat = max(0.0, (small.deviance - large.deviance) / scale)
    if large.family.free_dispersion:
        p = f_upper(stat / df, df, large.residual_df)
    else:
        p = chi2_upper(stat, df)
    return df, stat, p, stat - 2.0 * df
