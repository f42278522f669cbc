"""Logger temperatures and monthly humidity of both sites."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import days_to_anchor, iso_date, us_date
from tidemark.operators.combine import drop_incomplete, full_join, stack_rows
from tidemark.operators.oneway import anova_oneway, oneway_ols
from tidemark.operators.quantiles import box_summary, exact_percentiles
from tidemark.operators.summaries import daily_peak_band, mean_of_daily_peaks, monthly_mean

# The solstice each site counts its days from. The second is as published; the
# readings start in December 2005, so pass another date to get small day numbers.
SOLSTICES = {"BP": "2006-06-21", "PA": "2009-12-21"}

# Regions of the two humidity stations, and the years they share.
NATIVE_REGION, INVADED_REGION = "BS", "NG"
FIRST_YEAR, BEFORE_YEAR = 2015, 2020


def temperature_clean(native: DataFrame, invaded: DataFrame, anchors: Mapping[str, str] = SOLSTICES) -> DataFrame:
    """Readings of both sites with days since the solstice; incomplete native readings are dropped."""

    def tagged(df: DataFrame, site: str) -> DataFrame:
        text = F.col("date_ibutton").cast("string")
        date = F.coalesce(us_date(text, strict=False), iso_date(text, strict=False))
        df = df.withColumns({"site": F.lit(site), "date_ibutton": date})
        return df.withColumn("dss", days_to_anchor(F.col("date_ibutton"), F.col("site"), anchors))

    return stack_rows(drop_incomplete(tagged(native, "BP")), tagged(invaded, "PA"))


def logger_summary(temperature: DataFrame) -> DataFrame:
    """Per site and logger: 99th percentile, and mean over days of the daily maximum."""
    keys = ["site", "number"]
    high = exact_percentiles(temperature, keys, "temp", [0.99]).withColumnRenamed("p99", "nnquant")
    return full_join(high, mean_of_daily_peaks(temperature, keys, "dss", "temp"), keys)


def temperature_band(temperature: DataFrame) -> DataFrame:
    """Per site and day: mean over loggers of the daily maximum, with its error band."""
    return daily_peak_band(temperature, ["site"], "dss", "number", "temp").orderBy("site", "dss")


def humidity_clean(native: DataFrame, invaded: DataFrame) -> DataFrame:
    """Monthly humidity of both regions over the years they share."""
    ours = monthly_mean(native, "year", "month", "humidity", before_year=BEFORE_YEAR)
    theirs = invaded.where((F.col("year") >= FIRST_YEAR) & (F.col("year") < BEFORE_YEAR))
    columns = ["year", "month", "humidity"]
    return stack_rows(
        ours.select(*columns, F.lit(NATIVE_REGION).alias("site")),
        theirs.select(*columns, F.lit(INVADED_REGION).alias("site")),
    )


def humidity_box(humidity: DataFrame) -> DataFrame:
    return box_summary(humidity, ["site"], "humidity")


def site_contrast(df: DataFrame, value: str, baseline: str) -> tuple[DataFrame, DataFrame]:
    """Coefficients and variance table of value ~ site."""
    return oneway_ols(df, "site", value, baseline), anova_oneway(df, "site", value)
