"""Size to weight: log-log fits per group, prediction, and the confidence band of the line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.tails import t_quantile
from tidemark.operators.combine import join_groups
from tidemark.session import settle


def fit_loglog(df: DataFrame, by: Sequence[str], size: str, weight: str) -> DataFrame:
    """Slope, intercept and R2 of ln(weight) on ln(size); values that have no logarithm are left out."""
    x, y = F.ln(F.col(size)), F.ln(F.col(weight))
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def curve_table(
    spark: SparkSession, curves: Mapping[str, tuple[float, float]], by: str = "species"
) -> DataFrame:
    """Coefficient table from given (slope, intercept) pairs."""
    return spark.createDataFrame(
        [(k, a, b) for k, (a, b) in curves.items()], f"{by} string, slope double, intercept double"
    )


def curve_weight(size: Column) -> Column:
    """Weight on the curve whose ``slope`` and ``intercept`` stand in the row."""
    return F.exp(F.col("slope") * F.ln(size) + F.col("intercept"))


def predict_loglog(
    df: DataFrame, curves: DataFrame, by: Sequence[str], size: str, weight: str = "weight"
) -> DataFrame:
    """Add the predicted weight from each group's curve."""
    curves = settle(curves.select(*by, "slope", "intercept"), "curves")
    return (
        join_groups(df, curves, by)
        .withColumn(weight, curve_weight(F.col(size)))
        .drop("slope", "intercept")
    )


def regression_band(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    points: int = 80,
    level: float = 0.95,
    critical: float | None = None,
) -> DataFrame:
    """The fitted line of y on x with its confidence band at even steps over the range of x.

    The data are reduced to moments in one pass; only the grid is expanded. ``critical`` fixes
    the number of standard errors, otherwise it is the t quantile of each group.
    """
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    moments = df.where(fx.isNotNull() & fy.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(fx).alias("mx"),
        F.regr_sxx(fy, fx).alias("sxx"),
        F.regr_syy(fy, fx).alias("syy"),
        F.regr_sxy(fy, fx).alias("sxy"),
        F.avg(fy).alias("my"),
        F.min(fx).alias("x0"),
        F.max(fx).alias("x1"),
    ).where((F.col("n") > 2) & (F.col("sxx") > 0))
    slope = F.col("sxy") / F.col("sxx")
    spread = F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    moments = moments.withColumns(
        {
            "slope": slope,
            "spread": spread,
            "crit": _t_critical(level)(F.col("n") - 2) if critical is None else F.lit(float(critical)),
        }
    )
    grid = moments.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("step") / float(points - 1)
    away = F.col("at") - F.col("mx")
    return (
        grid.withColumn("at", at)
        .withColumn("fit", F.col("my") + F.col("slope") * away)
        .withColumn("se", F.col("spread") * F.sqrt(1 / F.col("n") + away * away / F.col("sxx")))
        .select(
            *by,
            "step",
            "at",
            "fit",
            "se",
            (F.col("fit") - F.col("crit") * F.col("se")).alias("lo"),
            (F.col("fit") + F.col("crit") * F.col("se")).alias("hi"),
        )
    )


def _t_critical(level: float):
    @F.pandas_udf(DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        known = {n: t_quantile((1 + level) / 2, n) for n in df.unique()}
        return df.map(known)

    return quantile
