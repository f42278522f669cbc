"""Checks of a survey table against its data dictionary, and corrections by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.combine import join_groups
from tidemark.session import settle


def code_lists(factors: DataFrame, attribute: str = "attributeName", code: str = "code") -> DataFrame:
    """(field, code) of a data dictionary."""
    return factors.select(F.col(attribute).alias("field"), F.col(code).cast("string").alias("code")).distinct()


def declared_ranges(variables: DataFrame, name: str = "attributeName", text: str = "attributeDefinition") -> DataFrame:
    """(field, low, high) of ranges written as ``Range low-high`` in the definitions of a data dictionary."""
    number = r"Range (\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)"
    return variables.where(F.col(text).rlike(number)).select(
        F.col(name).alias("field"),
        F.regexp_extract(text, number, 1).cast("double").alias("low"),
        F.regexp_extract(text, number, 2).cast("double").alias("high"),
    )


def dictionary_violations(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str], codes: DataFrame | None = None, ranges: DataFrame | None = None
) -> DataFrame:
    """Like :func:`violations`, for code lists and ranges that are tables of any size.

    ``codes`` has columns field and code, ``ranges`` field, low and high. Only declared fields are
    judged, by their text or number; missing values break no rule. The distinct values of the
    fields are looked up first, so the rows meet nothing but the table of bad values, whose size
    is known when they are joined.
    """
    cells = df.select(
        *[F.col(f"`{k}`") for k in keys],
        F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields])),
    ).where(F.col("value").isNotNull())
    seen = settle(cells.groupBy("field", "value").count().select("field", "value"), "values")
    bad = []
    if codes is not None:
        listed = seen.join(codes.select("field").distinct(), "field", "left_semi")
        known = codes.select("field", F.col("code").cast("string").alias("value"))
        bad.append(listed.join(known, ["field", "value"], "left_anti").withColumn("rule", F.lit("code")))
    if ranges is not None:
        number = F.col("value").try_cast("double")
        outside = seen.join(ranges.select("field", "low", "high"), "field").where(~number.between(F.col("low"), F.col("high")))
        bad.append(outside.select("field", "value").distinct().withColumn("rule", F.lit("range")))
    if not bad:
        return cells.limit(0).withColumn("rule", F.lit("")).select(*keys, "field", "rule", "value")
    broken = settle(reduce(DataFrame.unionByName, bad), "bad_values")
    return cells.join(broken, ["field", "value"]).select(*[F.col(f"`{k}`") for k in keys], "field", "rule", "value")


def violations(
    df: DataFrame,
    keys: Sequence[str],
    codes: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    required: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per broken rule: keys, field, rule and offending value. One scan, no shuffle.

    A missing value breaks only the ``required`` rule. ``rules`` maps a name to a condition that
    holds for bad rows.
    """
    checks: list[tuple[str, str, Column, Column]] = []
    for c, allowed in (codes or {}).items():
        checks.append((c, "code", F.col(f"`{c}`"), ~F.col(f"`{c}`").isin(list(allowed))))
    for c, (low, high) in (ranges or {}).items():
        checks.append((c, "range", F.col(f"`{c}`"), ~F.col(f"`{c}`").between(low, high)))
    for c in required:
        checks.append((c, "required", F.col(f"`{c}`"), F.col(f"`{c}`").isNull()))
    for rule, bad in (rules or {}).items():
        checks.append(("", rule, F.lit(None), bad))
    # clean rows, the bulk of a table, leave at once; the others get one array entry per broken rule
    suspect = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for *_, bad in checks])
    found = F.array(
        *[
            F.when(
                bad,
                F.struct(F.lit(c).alias("field"), F.lit(rule).alias("rule"), value.cast("string").alias("value")),
            )
            for c, rule, value, bad in checks
        ]
    )
    broken = F.explode(F.filter(found, lambda x: x.isNotNull())).alias("broken")
    return df.where(suspect).select(*[F.col(f"`{k}`") for k in keys], broken).select(
        *[F.col(f"`{k}`") for k in keys], "broken.field", "broken.rule", "broken.value"
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace values by those of a corrections table, matched on ``keys``; NULL there leaves a value."""
    changed = [c for c in corrections.columns if c not in keys]
    fixes = corrections.withColumnsRenamed({c: f"fix__{c}" for c in changed})
    joined = join_groups(df, fixes, keys)
    return joined.select(
        *[F.coalesce(F.col(f"fix__{c}"), F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns]
    )
