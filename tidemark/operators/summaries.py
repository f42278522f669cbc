"""Summaries per cell: means with standard errors, two-stage reductions, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import max_of, mean_of, sd_of, se_of


def cell_summary(
    df: DataFrame, by: Sequence[str], value: str, na_rm: bool = False, prefix: str = ""
) -> DataFrame:
    """Size, mean, deviation, standard error and the bounds mean -/+ error of each cell."""
    return cell_summaries(df, by, {prefix: value}, na_rm)


def cell_summaries(
    df: DataFrame, by: Sequence[str], values: Mapping[str, str], na_rm: bool = False
) -> DataFrame:
    """The same for several values, whose columns get the prefix they are listed under.

    One partially aggregated pass: a cell that holds most rows is reduced where its rows lie.
    """
    columns, bounds = [], {}
    for prefix, value in values.items():
        av, se = f"{prefix}av", f"{prefix}se"
        columns += [
            F.count(F.lit(1)).alias(f"{prefix}n"),
            mean_of(value, na_rm).alias(av),
            sd_of(value, na_rm).alias(f"{prefix}sd"),
            se_of(value, na_rm).alias(se),
        ]
        bounds |= {f"{prefix}lo": F.col(av) - F.col(se), f"{prefix}hi": F.col(av) + F.col(se)}
    return df.groupBy(*by).agg(*columns).withColumns(bounds)


def peak_per_unit(
    df: DataFrame, by: Sequence[str], value: str, peak: str = "dm", na_rm: bool = True
) -> DataFrame:
    return df.groupBy(*by).agg(max_of(value, na_rm).alias(peak))


def mean_of_daily_peaks(
    df: DataFrame, unit: Sequence[str], day: str, value: str, na_rm: bool = True
) -> DataFrame:
    """Mean over days of each unit's daily maximum.

    Two partially aggregated shuffles. The first spreads a unit over its days, so one unit with
    most of the readings is no hot spot; the second moves one row per unit and day at most.
    """
    peaks = peak_per_unit(df, [*unit, day], value, na_rm=na_rm)
    return peaks.groupBy(*unit).agg(mean_of("dm").alias("adm"))


def daily_peak_band(
    df: DataFrame, site: Sequence[str], day: str, unit: str, value: str, na_rm: bool = False
) -> DataFrame:
    """Per site and day, the mean over units of their daily maximum, with its error band."""
    peaks = peak_per_unit(df, [*site, day, unit], value, na_rm=na_rm)
    return cell_summary(peaks, [*site, day], "dm")


def monthly_mean(
    df: DataFrame,
    year: str,
    month: str,
    value: str,
    by: Sequence[str] = (),
    first_year: int | None = None,
    before_year: int | None = None,
) -> DataFrame:
    """Mean per month over the values present, for a range of years; months without any are dropped."""
    if first_year is not None:
        df = df.where(F.col(year) >= first_year)
    if before_year is not None:
        df = df.where(F.col(year) < before_year)
    return df.groupBy(*by, year, month).agg(F.avg(value).alias(value)).na.drop("any")


def histogram(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    width: float = 1.0,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Counts in bins centred on multiples of ``width`` and closed on the right."""
    if low is not None:
        df = df.where(F.col(value) >= low)
    if high is not None:
        df = df.where(F.col(value) <= high)
    place = F.ceil(F.col(value) / width - 0.5).cast("bigint")
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("centre", F.col("bin") * F.lit(float(width)))
    )
