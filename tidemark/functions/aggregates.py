"""Aggregate columns with an explicit policy for missing values.

Spark's aggregates skip NULL. With ``na_rm=False`` these return NULL as soon as one value of
the group is missing, which is what survey summaries expect unless they ask otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complete_only(aggregate: Column, x: Column | str) -> Column:
    """``aggregate`` when no value of ``x`` in the group is missing, else NULL."""
    return F.when(F.count(_column(x)) == F.count(F.lit(1)), aggregate)


def mean_of(x: Column | str, na_rm: bool = False) -> Column:
    x = _column(x)
    return F.avg(x) if na_rm else complete_only(F.avg(x), x)


def sum_of(x: Column | str, na_rm: bool = False) -> Column:
    x = _column(x)
    return F.sum(x) if na_rm else complete_only(F.sum(x), x)


def max_of(x: Column | str, na_rm: bool = False) -> Column:
    """Largest value; a group without any value gives NULL."""
    x = _column(x)
    return F.max(x) if na_rm else complete_only(F.max(x), x)


def sd_of(x: Column | str, na_rm: bool = False) -> Column:
    x = _column(x)
    return F.stddev_samp(x) if na_rm else complete_only(F.stddev_samp(x), x)


def se_of(x: Column | str, na_rm: bool = False) -> Column:
    """Standard error of the mean: sample deviation over the root of the group size."""
    x = _column(x)
    if na_rm:
        # a group without any value must not divide by zero under ANSI rules
        return F.stddev_samp(x) / F.sqrt(F.nullif(F.count(x), F.lit(0)))
    return complete_only(F.stddev_samp(x), x) / F.sqrt(F.count(F.lit(1)))
