"""Unions, joins and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is NULL there.

    This is the full join of inputs that share no row, without its shuffle.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    renamed = right.withColumnsRenamed({k: f"right__{k}" for k in keys})
    match = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"right__{k}"]) for k in keys]
    )
    return renamed, match


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach a per-group table; a missing key is a group like any other."""
    renamed, match = _null_safe(df, groups, keys)
    joined = df.join(renamed, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"right__{k}" for k in keys])


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join of two summaries on shared keys, where missing keys match each other."""
    renamed, match = _null_safe(left, right, keys)
    joined = left.join(renamed, match, "full")
    values = [c for c in [*left.columns, *right.columns] if c not in keys]
    return joined.select(
        *[F.coalesce(left[k], renamed[f"right__{k}"]).alias(k) for k in keys], *values
    )


def keep_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_groups(df, other, keys, "left_semi")


def keep_unmatched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_groups(df, other, keys, "left_anti")


def drop_when(df: DataFrame, condition: Column) -> DataFrame:
    """Drop the rows that meet the condition, and those where it is unknown."""
    return df.where(~condition)


def drop_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Drop rows whose text contains the phrase; rows without text stay."""
    return df.where(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)
