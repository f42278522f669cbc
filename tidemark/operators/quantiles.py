"""Exact percentiles and box summaries for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a group is
first counted in narrow value buckets, the buckets that hold the wanted ranks are found from
the counts, and only the distinct values inside those buckets are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.combine import join_groups
from tidemark.session import settle

BUCKET_BITS = 14


def with_bucket(df: DataFrame, value: str, bits: int = BUCKET_BITS) -> DataFrame:
    """Add ``tm_bucket``, a whole number that never decreases as the value grows: sign, power of
    two, leading bits.

    A bucket spans 1/2**bits of its power of two, so there are at most a few thousand times
    2**bits buckets whatever the data.
    """
    x, size, power = F.col(value), F.abs(F.col(value)), F.col("tm_power")
    endless = size == float("inf")
    share = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * float(2**bits))
    step = F.when(endless, F.lit(0)).otherwise(F.least(F.greatest(share, F.lit(0)), F.lit(2**bits - 1)))
    rank = (power + 1075.0).cast("bigint") * F.lit(2**bits) + step + 1
    # power and rank are columns of their own, so that each is worked out once per row
    return (
        df.withColumn("tm_power", F.when(endless, 1024.0).otherwise(F.floor(F.log2(size)).cast("double")))
        .withColumn("tm_bucket", F.when(size == 0, F.lit(0)).otherwise(rank).cast("bigint"))
        .withColumn("tm_bucket", F.when(x < 0, -F.col("tm_bucket")).otherwise(F.col("tm_bucket")))
        .drop("tm_power")
    )


def percentile_name(prob: float) -> str:
    return "p" + f"{prob * 100:g}".replace(".", "_")


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], bits: int = BUCKET_BITS
) -> DataFrame:
    """Percentiles by linear interpolation between order statistics; missing values are skipped.

    Values are taken as double precision, so whole numbers beyond 2**53 are rounded to it first.

    Two scans of the needed columns, each reduced before it is shuffled: (group, bucket) counts,
    then (group, bucket, value) counts of the hit buckets. The largest unit one task sorts is
    the distinct values of one bucket of one group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("tm_v")).where(F.col("tm_v").isNotNull() & ~F.isnan("tm_v"))
    rows = with_bucket(rows, "tm_v", bits)
    group = Window.partitionBy(*by)
    counts = (
        rows.groupBy(*by, "tm_bucket")
        .agg(F.count(F.lit(1)).alias("tm_m"))
        .withColumn("tm_upto", F.sum("tm_m").over(group.orderBy("tm_bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("tm_total", F.sum("tm_m").over(group))
        .withColumn("tm_below", F.col("tm_upto") - F.col("tm_m"))
    )
    ranks = {p: _ranks(F.col("tm_total"), p) for p in probs}
    wanted = F.lit(False)
    for low, high, _ in ranks.values():
        wanted = wanted | _covers("tm_below", "tm_upto", low) | _covers("tm_below", "tm_upto", high)
    hits = settle(counts.where(wanted).select(*by, "tm_bucket", "tm_below", "tm_total"), "buckets")

    inside = Window.partitionBy(*by, "tm_bucket").orderBy("tm_v").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        join_groups(rows, hits, [*by, "tm_bucket"], "inner")
        .groupBy(*by, "tm_bucket", "tm_below", "tm_total", "tm_v")
        .agg(F.count(F.lit(1)).alias("tm_c"))
        .withColumn("tm_last", F.col("tm_below") + F.sum("tm_c").over(inside))
        .withColumn("tm_first", F.col("tm_last") - F.col("tm_c"))
    )
    picks, out = [F.max("tm_total").alias("tm_total")], []
    for i, p in enumerate(probs):
        low, high, _ = ranks[p]
        picks.append(F.max(F.when(_covers("tm_first", "tm_last", low), F.col("tm_v"))).alias(f"tm_low{i}"))
        picks.append(F.max(F.when(_covers("tm_first", "tm_last", high), F.col("tm_v"))).alias(f"tm_high{i}"))
        share = _ranks(F.col("tm_total"), p)[2]
        out.append(
            (F.col(f"tm_low{i}") + share * (F.col(f"tm_high{i}") - F.col(f"tm_low{i}"))).alias(percentile_name(p))
        )
    return values.groupBy(*by).agg(*picks).select(*by, *out)


def _ranks(total: Column, prob: float) -> tuple[Column, Column, Column]:
    place = (total - 1) * F.lit(float(prob))
    low = F.floor(place)
    return low, F.ceil(place), place - low


def _covers(first: str, last: str, rank: Column) -> Column:
    return (F.col(first) <= rank) & (rank < F.col(last))


def _present(value: str) -> Column:
    """Neither missing nor not-a-number: what quartiles, counts and outliers are about."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def box_summary(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, moments: bool = False) -> DataFrame:
    """Quartiles, whiskers to the last value within ``reach`` box lengths, and outlier count.

    ``moments`` adds mean ``av`` and deviation ``sd`` of the same rows in the same pass.
    """
    fenced = box_fences(df, by, value, reach)
    v = F.col(value)
    extra = [F.avg(v).alias("av"), F.stddev_samp(v).alias("sd")] if moments else []
    within = v.between(F.col("tm_low"), F.col("tm_high"))
    box = [F.max(c).alias(c) for c in ("q1", "median", "q3")]
    return (
        join_groups(df.where(_present(value)).select(*by, value), fenced, by, "inner")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *box,
            F.min(F.when(within, v)).alias("whisker_low"),
            F.max(F.when(within, v)).alias("whisker_high"),
            F.count(F.when(~within, v)).alias("outliers"),
            *extra,
        )
    )


def box_fences(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    box = exact_percentiles(df, by, value, [0.25, 0.5, 0.75]).select(
        *by, F.col("p25").alias("q1"), F.col("p50").alias("median"), F.col("p75").alias("q3")
    )
    length = F.col("q3") - F.col("q1")
    return settle(
        box.withColumns(
            {"tm_low": F.col("q1") - reach * length, "tm_high": F.col("q3") + reach * length}
        ),
        "fences",
    )


def box_outliers(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """The rows that lie outside of their group's fences."""
    fenced = box_fences(df, by, value, reach).select(*by, "tm_low", "tm_high")
    outside = ~F.col(value).between(F.col("tm_low"), F.col("tm_high"))
    return join_groups(df.where(_present(value)), fenced, by, "inner").where(outside).drop("tm_low", "tm_high")
