"""Logit of proportions or percentages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how far proportions are pulled in from 0 and 1 when the data touch them.
SQUEEZE = 0.025


def with_logit(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``ln(p / (1 - p))``.

    Values count as percentages when any exceeds 1. When the data touch 0 or 1, all proportions
    are squeezed to ``SQUEEZE + (1 - 2 * SQUEEZE) * p`` first. The two limits are scalar
    subqueries, computed in one pass, so rows are neither joined nor moved.
    """
    limits = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    scale = F.when(F.col("high") > 1, 100.0).otherwise(1.0)
    limits = limits.select(scale.alias("scale"), ((F.col("low") <= 0) | (F.col("high") >= scale)).alias("touches"))
    p = F.col(value) / limits.select("scale").scalar()
    p = F.when(limits.select("touches").scalar(), SQUEEZE + (1 - 2 * SQUEEZE) * p).otherwise(p)
    return df.withColumn(name, F.ln(F.try_divide(p, 1 - p)))
