"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str,
    value: str,
    fill: float | None = None,
) -> DataFrame:
    """One row per id and column, missing values kept, or replaced by ``fill``."""
    wide = df.select(*[f"`{c}`" for c in ids], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in columns], name, value)
    return long if fill is None else long.withColumn(value, F.coalesce(value, F.lit(float(fill))))


def to_long_by_prefix(
    df: DataFrame, ids: Sequence[str], prefix: str | tuple[str, ...], date: str, value: str
) -> DataFrame:
    """One row per id and column whose name starts with a prefix; the name is an ISO date."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    long = to_long(df, ids, columns, date, value)
    return long.withColumn(date, F.to_date(F.col(date), "yyyy-MM-dd"))


def families_to_long(
    df: DataFrame,
    ids: Sequence[str],
    families: Mapping[str, Sequence[str]],
    name: str,
    fill: float | None = None,
    faults: str | None = None,
    whole: str = "record",
) -> DataFrame:
    """Several groups of columns to one name column and one value column per group.

    All groups come out of a single scan. A row carries the value of its own group; the value
    columns of the other groups are NULL. ``fill`` replaces missing values in the own group only.
    Fields that the array column ``faults`` names (entry ``field``; ``whole`` stands for all of them)
    are not missing but unknown: they stay NULL.
    """
    spoilt = F.lit(False) if faults is None else F.array_contains(F.col(f"{faults}.field"), whole)
    cells = []
    for family, columns in families.items():
        for column in columns:
            measure = F.col(f"`{column}`").cast("double")
            if fill is not None:
                unknown = spoilt if faults is None else spoilt | F.array_contains(F.col(f"{faults}.field"), column)
                measure = F.coalesce(measure, F.when(~unknown, F.lit(float(fill))))
            cells.append(F.lit(column))
            cells += [measure if f == family else F.lit(None).cast("double") for f in families]
    count = sum(len(c) for c in families.values())
    return df.select(
        *[F.col(f"`{c}`") for c in ids], F.stack(F.lit(count), *cells).alias(name, *families)
    )


MOST_COLUMNS = 500


def to_wide(
    df: DataFrame, by: Sequence[str], name: str, names: Sequence[str] | None, value: str, how: str = "first"
) -> DataFrame:
    """One column per name. ``names`` None: all that the table holds, found first and sorted (missing: ``NA``).

    Names that are given save that pass; rows with other names then go nowhere. More than
    ``MOST_COLUMNS`` names outgrow a schema: :func:`to_wide_map` keeps them in one column.
    """
    cell = {"first": F.first, "mean": F.avg, "sum": F.sum, "max": F.max}[how]
    if names is None:
        df = df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("NA")))
        found = [r[0] for r in df.select(name).distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{name} has more than {MOST_COLUMNS} values; use to_wide_map")
        names = sorted(found)
    return df.groupBy(*by).pivot(name, list(names)).agg(cell(value))


def to_wide_map(df: DataFrame, by: Sequence[str], name: str, value: str, how: str = "first", into: str = "values") -> DataFrame:
    """One row per group with a map from name to cell, for names without a bound (missing: ``NA``)."""
    cell = {"first": F.first, "mean": F.avg, "sum": F.sum, "max": F.max}[how]
    cells = df.groupBy(*by, F.coalesce(F.col(name).cast("string"), F.lit("NA")).alias("tm_name")).agg(cell(value).alias("tm_cell"))
    return cells.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tm_name", "tm_cell")))).alias(into))
