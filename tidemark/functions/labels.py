"""Labels, codes and ordered levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def relabel(x: Column, rules: Mapping[str, str]) -> Column:
    """Apply regex replacements one after the other, each to the outcome of the one before."""
    for pattern, text in rules.items():
        x = F.regexp_replace(x, pattern, text.replace("\\", "\\\\").replace("$", "\\$"))
    return x


def recode(x: Column, codes: Mapping[str, str], keep_others: bool = True) -> Column:
    """Replace whole values by their code; other values stay, or become NULL."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    found = table[x]
    return F.coalesce(found, x) if keep_others else found


def within_levels(x: Column, levels: Sequence[str]) -> Column:
    """The value when it is a declared level, else NULL."""
    return F.when(x.isin(list(levels)), x)


def level_index(x: Column, levels: Sequence[str]) -> Column:
    """1-based place of the value in the declared order, NULL outside of it: a sort key."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), x)
    return F.when(place > 0, place.cast("int"))


def joined_text(columns: Sequence[str], sep: str) -> Column:
    """Columns joined as text, a missing one shown as ``NA`` instead of being skipped."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def composite_key(*columns: str) -> Column:
    return joined_text(columns, "_")


def label_of(*columns: str) -> Column:
    return joined_text(columns, " ")
