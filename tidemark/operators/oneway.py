"""One-factor linear model and analysis of variance in closed form from group moments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.tails import f_upper, t_two_sided
from tidemark.session import settle


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of F for the rows of a variance table."""
    return pd.Series([None if any(map(pd.isna, row)) else f_upper(*row) for row in zip(f, df1, df2)], dtype=float)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of t for the rows of a coefficient table."""
    return pd.Series([None if any(map(pd.isna, row)) else t_two_sided(*row) for row in zip(t, df)], dtype=float)


def group_moments(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Size, mean and inner sum of squares per level: the only pass over the data."""
    y = F.col(value).cast("double")
    moments = (
        df.where(F.col(value).isNotNull() & F.col(factor).isNotNull())
        .groupBy(F.col(factor).alias("level"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("ss"),
        )
    )
    return settle(moments, "moments")


def _variance_table(moments: DataFrame) -> DataFrame:
    grand = moments.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")).scalar()
    away = F.col("mean") - grand
    return (
        moments.agg(
            (F.count(F.lit(1)) - 1).alias("df_between"),
            (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
            F.sum(F.col("n") * away * away).alias("ss_between"),
            F.sum("ss").alias("ss_within"),
        )
        .withColumn("ms_between", F.try_divide("ss_between", "df_between"))
        .withColumn("ms_within", F.try_divide("ss_within", "df_within"))
        .withColumn("f_value", F.try_divide("ms_between", "ms_within"))
        .withColumn("r2", F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")))
    )


def anova_oneway(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Sums of squares, degrees of freedom, mean squares, F with its p value, and R2 in one row."""
    table = _variance_table(group_moments(df, factor, value))
    return table.withColumn("p_value", f_p_value("f_value", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def oneway_ols(df: DataFrame, factor: str, value: str, baseline: str) -> DataFrame:
    """Coefficients of value ~ factor with treatment contrasts, standard errors, t with its p value, and R2."""
    cells = group_moments(df, factor, value)
    test = _variance_table(cells)
    base = cells.where(F.col("level") == baseline)
    mean0, n0 = base.select("mean").scalar(), base.select("n").scalar()
    at_base = F.col("level") == baseline
    share = F.when(at_base, 1 / F.col("n")).otherwise(1 / F.col("n") + 1 / n0)
    return (
        cells.withColumn("term", F.when(at_base, F.lit("intercept")).otherwise(F.col("level")))
        .withColumn("estimate", F.when(at_base, F.col("mean")).otherwise(F.col("mean") - mean0))
        .withColumn("se", F.sqrt(test.select("ms_within").scalar() * share))
        .withColumn("t_value", F.try_divide("estimate", "se"))
        .withColumn("df", test.select("df_within").scalar())
        .withColumn("r2", test.select("r2").scalar())
        .withColumn("p_value", t_p_value("t_value", F.col("df").cast("double")))
        .select("term", "estimate", "se", "t_value", "df", "p_value", "r2")
    )
