"""Dates and elapsed time. Time is counted in whole days; weeks are days over seven."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_date(x: Column, strict: bool = True) -> Column:
    return F.to_date(x, "yyyy-MM-dd") if strict else F.try_to_date(x, "yyyy-MM-dd")


def us_date(x: Column, strict: bool = True) -> Column:
    return F.to_date(x, "M/d/yyyy") if strict else F.try_to_date(x, "M/d/yyyy")


def weeks(days: Column) -> Column:
    return days / F.lit(7.0)


def days_to_anchor(date: Column, group: Column, anchors: Mapping[str, str]) -> Column:
    """Signed days from the reference date of each group, given as ISO text."""
    days = F.lit(None).cast("int")
    for value, anchor in anchors.items():
        days = F.when(group == value, F.datediff(date, F.lit(anchor).cast("date"))).otherwise(days)
    return days


def since_anchor(df: DataFrame, date: str, anchor: str) -> DataFrame:
    """Add ``days`` and ``timediff`` (weeks) since a fixed date."""
    days = F.datediff(F.col(date), F.lit(anchor).cast("date"))
    return df.withColumn("days", days).withColumn("timediff", weeks(F.col("days")))
