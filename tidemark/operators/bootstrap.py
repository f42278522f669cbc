"""Totals from counts: expected totals and reproducible draws from a pool of measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.combine import join_groups
from tidemark.session import settle

COPY_BLOCK = 100_000
# Fixed value: the prime 2**31 - 1, so that products stay within 64 bits.
PRIME = 2147483647


def number_pool(pool: DataFrame, by: str, ids: Sequence[str], digits: int = 3) -> DataFrame:
    """Number the members of each pool from 0 (``slot``); ``pool_n`` is the size of the group's pool.

    ``ids`` name columns that identify a member. Members are ordered by the hash of their id, so
    the numbers depend on nothing but the pool itself. A group is cut at its leading hash digits
    into 16**digits even chunks; members are numbered inside a chunk and shifted by the sizes of
    the chunks before it. No task orders more than one chunk of members, or the chunk sizes of
    one group.
    """
    keyed = pool.withColumn("tm_hash", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids])))
    keyed = keyed.withColumn("tm_chunk", F.substring("tm_hash", 1, digits))
    chunks = settle(keyed.groupBy(by, "tm_chunk").agg(F.count(F.lit(1)).alias("tm_m")), "chunks")
    before = (Window.unboundedPreceding, -1)
    groups = chunks.groupBy(by).agg(F.sum("tm_m").alias("pool_n"))
    inner = Window.partitionBy(by).orderBy("tm_chunk").rowsBetween(*before)
    shifts = chunks.withColumn("tm_shift", F.coalesce(F.sum("tm_m").over(inner), F.lit(0))).drop("tm_m")
    shifts = settle(join_groups(shifts, groups, [by], "inner"), "shifts")
    place = Window.partitionBy(by, "tm_chunk").orderBy("tm_hash", *ids)
    return (
        join_groups(keyed, shifts, [by, "tm_chunk"], "inner")
        .withColumn("slot", F.col("tm_shift") + F.row_number().over(place) - 1)
        .drop("tm_hash", "tm_chunk", "tm_shift")
    )


def spread_blocks(df: DataFrame, count: str, by: Sequence[str], block: int = COPY_BLOCK) -> DataFrame:
    """Cut counts into blocks, nearly always one per row, and spread those over the cluster.

    So no task expands more than its share, even when one row counts most units. Rows without
    units are left out; ``by`` names columns that tell rows apart.
    """
    some = df.where(F.col(count) > 0).withColumn(count, F.col(count).cast("bigint"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(block).cast("bigint"))
    return some.withColumn("tm_block", F.explode(starts)).repartition(*by, "tm_block")


def expand_blocks(blocks: DataFrame, count: str, copy: str, block: int = COPY_BLOCK) -> DataFrame:
    """One row per unit, numbered from 1 over all blocks of a row."""
    last = F.least(F.col("tm_block") + F.lit(block).cast("bigint"), F.col(count))
    return blocks.withColumn(copy, F.explode(F.sequence(F.col("tm_block") + 1, last))).drop("tm_block")


def with_copies(df: DataFrame, count: str, copy: str, block: int = COPY_BLOCK) -> DataFrame:
    """One row per unit counted, numbered from 1; rows with no units give none."""
    return expand_blocks(spread_blocks(df, count, df.columns, block), count, copy, block)


def pool_from_sizes(sizes: DataFrame, by: str, size: str) -> DataFrame:
    """A pool with identified members from bare measurements: repeats get copy numbers."""
    counts = sizes.where(F.col(size).isNotNull()).groupBy(by, size).agg(F.count(F.lit(1)).alias("repeats"))
    return with_copies(counts, "repeats", "copy").drop("repeats")


def with_draw_seeds(df: DataFrame, seed: int, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add eight whole numbers below PRIME per row, from one hash of the seed and the row key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    parts = {
        name: F.conv(F.substring("tm_row_hash", 8 * i + 1, 8), 16, 10).cast("bigint") % PRIME for i, name in enumerate(names)
    }
    return df.withColumn("tm_row_hash", F.sha2(text, 256)).withColumns(parts).drop("tm_row_hash")


def draw_slot(seeds: Sequence[Column], draw: Column, pool_n: Column) -> Column:
    """Pool number of one draw.

    Two cubic polynomials in the draw number over the field of PRIME, with the row's seeds as
    coefficients, give 62 bits that are uniform and independent for any four draws of a row
    (Wegman and Carter 1981). A draw costs six multiplications instead of a hash of its own.
    """
    high, low = _cubic(seeds[:4], draw), _cubic(seeds[4:], draw)
    return (high * PRIME + low) % pool_n


def _cubic(c: Sequence[Column], d: Column) -> Column:
    value = c[3]
    for k in (2, 1, 0):
        value = (value * d + c[k]) % PRIME
    return value


def bootstrap_total(
    counts: DataFrame,
    pool: DataFrame,
    keys: Sequence[str],
    species: str,
    count: str,
    weight: str,
    total: str = "total",
    seed: int = 26,
    carry: Sequence[str] = (),
    block: int = COPY_BLOCK,
) -> DataFrame:
    """Per row of ``counts``, the summed weight of ``count`` draws with replacement from its pool.

    ``keys`` and the species identify a row, ``carry`` names further columns to keep; ``pool``
    comes from :func:`number_pool` and carries ``weight``. A count of 0 totals 0; a missing
    count, or a species without a pool, totals NULL.

    Draws depend on the seed and the row key only, hence neither on order nor on partitions.
    Rows are expanded where they lie, in one pass with those that draw nothing; only rows with more
    than ``block`` units are set aside first and spread over the cluster. The numbered pool is a
    written table: it is broadcast when its files are small, and then the draws of a row are summed
    where they are made. Otherwise draws and pool meet on species and slot, which spreads a
    dominant species over all its members.
    """
    pool = settle(pool.select(species, "slot", "pool_n", weight), "pool")
    runs = settle(pool.where("slot = 0").select(species, "pool_n"), "pool_runs")
    columns = [*keys, *carry, species, count]
    rows = join_groups(counts.select(*columns).withColumn("tm_units", F.col(count).cast("bigint")), runs, [species])
    draws_any = F.coalesce(F.col("pool_n").isNotNull() & (F.col("tm_units") > 0), F.lit(False))
    many = draws_any & (F.col("tm_units") > block)
    names = [f"tm_seed{i}" for i in range(8)]
    heavy = spread_blocks(settle(rows.where(many), "heavy"), "tm_units", keys, block)
    heavy = expand_blocks(with_draw_seeds(heavy, seed, [*keys, species], names), "tm_units", "tm_draw", block)
    none = F.array(F.lit(0).cast("bigint"))
    numbers = F.when(draws_any, F.sequence(F.lit(1).cast("bigint"), F.greatest("tm_units", F.lit(1)))).otherwise(none)
    light = with_draw_seeds(rows.where(~many), seed, [*keys, species], names).withColumn("tm_draw", F.explode(numbers))
    slot = draw_slot([F.col(n) for n in names], F.col("tm_draw") % PRIME, F.col("pool_n"))
    # -1 is no member: a row without draws passes the join with a missing weight
    found = F.coalesce(F.when(F.col("tm_draw") > 0, slot), F.lit(-1)).alias("slot")
    draws = light.unionByName(heavy).select(*columns, "tm_units", found)
    sums = join_groups(draws, pool.select(species, "slot", weight), [species, "slot"]).groupBy(*columns, "tm_units").agg(F.sum(weight).alias("tm_sum"))
    return sums.select(*columns, F.when(F.col("tm_units") == 0, F.lit(0.0)).otherwise(F.col("tm_sum")).alias(total))


def expected_total(
    counts: DataFrame, pool: DataFrame, by: str, count: str, weight: str, total: str = "expected"
) -> DataFrame:
    """The mean of :func:`bootstrap_total` over all draws: count times the mean pool weight."""
    means = settle(pool.groupBy(by).agg(F.avg(weight).alias("tm_mean")), "pool_means")
    return (
        join_groups(counts, means, [by])
        .withColumn(total, F.when(F.col(count) == 0, F.lit(0.0)).otherwise(F.col(count) * F.col("tm_mean")))
        .drop("tm_mean")
    )
