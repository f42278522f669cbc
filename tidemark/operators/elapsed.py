"""Elapsed time since the first observation of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import weeks
from tidemark.operators.combine import join_groups
from tidemark.session import settle


def since_start(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    """Add ``days`` and ``timediff`` (weeks) since the first date of each group.

    The first dates come from one partially aggregated pass; rows never move by group, so a
    group that holds most of the data stays spread over its input partitions.
    """
    starts = settle(df.groupBy(*by).agg(F.min(date).alias("tm_start")), "starts")
    return (
        join_groups(df, starts, by)
        .withColumn("days", F.datediff(F.col(date), F.col("tm_start")))
        .withColumn("timediff", weeks(F.col("days")))
        .drop("tm_start")
    )
