"""Term selection and type-II tests, by nested fits over one settled cell table or by the covariance of one fit."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.tails import chi2_upper
from tidemark.operators.design import Design, Term, term_columns, term_name
from tidemark.operators.glm import Fit, compare_nested, fit_glm

TEST_SCHEMA = "step int, term string, df int, statistic double, p_value double, delta_aic double, dropped boolean"


def drop_terms(fit: Fit) -> tuple[Fit, list[tuple]]:
    """Drop marginal terms one by one while that lowers AIC.

    Per step every term that no larger remaining term contains is left out in turn. Dispersion,
    power and theta stay those of the first model. The last term is compared with the mean alone. Returns the last fit and one record per try.
    """
    scale, family, records = fit.scale, fit.family, []
    for step in count(1):
        tries: list[tuple[float, Term, Fit, tuple]] = []
        for term in fit.design.marginal_terms():
            smaller = fit_glm(fit.table, fit.design.without(term), family, fit.weight, errors=False)
            df, stat, p, delta = compare_nested(smaller, fit, scale)
            tries.append((delta, term, smaller, (df, stat, p)))
        if not tries:
            break
        best = min(tries, key=lambda t: t[0])
        falls = best[0] < 0
        for delta, term, _, (df, stat, p) in tries:
            records.append((step, term_name(term), df, stat, p, delta, falls and term == best[1]))
        if not falls:
            break
        fit = best[2]
    if not fit.unscaled_errors:
        fit = fit_glm(fit.table, fit.design, family, fit.weight)
    return fit, records


def drop_table(spark: SparkSession, records: list[tuple]) -> DataFrame:
    return spark.createDataFrame(records, TEST_SCHEMA)


def type2_tests(spark: SparkSession, fit: Fit) -> DataFrame:
    """Each term against the model of all terms that do not contain it."""
    family, rows = fit.family, []
    fits: dict[frozenset, Fit] = {frozenset(fit.design.terms): fit}

    def fitted(design: Design) -> Fit:
        key = frozenset(design.terms)
        if key not in fits:
            fits[key] = fit_glm(fit.table, design, family, fit.weight, errors=False)
        return fits[key]

    for term in fit.design.terms:
        base = fit.design
        for larger in base.contains(term):
            base = base.without(larger)
        df, stat, p, _ = compare_nested(fitted(base.without(term)), fitted(base), fit.scale)
        rows.append((term_name(term), df, stat, p))
    return spark.createDataFrame(rows, "term string, df int, statistic double, p_value double")


def linear_hypothesis(fit: Fit, names: Sequence[str]) -> float:
    """Wald statistic of the hypothesis that all the named estimates are zero."""
    if fit.covariance is None:
        raise ValueError("the fit has no covariance; it was made with errors=False")
    if not names:
        return 0.0
    order = list(fit.estimates)
    at = [order.index(n) for n in names]
    b = np.array([fit.estimates[n] for n in names])
    block = fit.covariance[np.ix_(at, at)] * fit.scale
    width = np.sqrt(np.diag(block))  # a block of columns of very different size stays regular
    if not np.all(width > 0):
        return float("nan")
    try:
        return float((b / width) @ np.linalg.solve(block / np.outer(width, width), b / width))
    except np.linalg.LinAlgError:
        return float("nan")


def wald_type2(fit: Fit) -> list[tuple[str, int, float, float]]:
    """(term, df, chi-square, p) of each term after all terms that do not contain it, from one fit.

    The part of a term that is uncorrelated with the larger terms is tested: the statistic of the
    term and those together, less the statistic of those alone. No further fit is made.
    """
    rows = []
    for term in fit.design.terms:
        own = list(term_columns(fit.design, term))
        larger = [n for t in fit.design.contains(term) for n in term_columns(fit.design, t)]
        both, alone = linear_hypothesis(fit, [*own, *larger]), linear_hypothesis(fit, larger)
        stat = max(0.0, both - alone) if both == both and alone == alone else float("nan")
        rows.append((term_name(term), len(own), stat, chi2_upper(stat, len(own)) if stat == stat else float("nan")))
    return rows


def wald_tests(spark: SparkSession, fit: Fit) -> DataFrame:
    """:func:`wald_type2` as a table."""
    return spark.createDataFrame(wald_type2(fit), "term string, df int, statistic double, p_value double")
