"""Daily maxima of logger readings that keep arriving: the streaming form of the batch operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_peaks(readings: DataFrame, unit: Sequence[str], time: str, value: str, lateness: str = "1 day") -> DataFrame:
    """Maximum per unit and day, emitted once the watermark has passed the day.

    State is one number per unit and open day. Readings later than ``lateness`` are not counted.
    """
    return (
        readings.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, lateness)
        .groupBy(*unit, F.window(time, "1 day").alias("span"))
        .agg(F.max(value).alias("dm"))
        .select(*unit, F.col("span.start").cast("date").alias("day"), "dm")
    )


def write_peaks(peaks: DataFrame, path: str, checkpoint: str):
    """Append finished days to a Parquet table, taking all data that is there and then stopping."""
    return (
        peaks.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
