"""Model tables: treatment contrasts, interactions, and the reduction of rows to design cells."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

Term = tuple[str, ...]


@dataclass(frozen=True)
class Design:
    """Factors with their ordered levels (the first is the baseline), covariates and terms."""

    factors: Mapping[str, Sequence[str]]
    covariates: Sequence[str]
    terms: tuple[Term, ...]
    kept: tuple[Term, ...] = ()  # terms that are never tested, e.g. blocks

    @property
    def variables(self) -> list[str]:
        return [*self.factors, *self.covariates]

    def without(self, term: Term) -> Design:
        return replace(self, terms=tuple(t for t in self.terms if t != term))

    def contains(self, term: Term) -> list[Term]:
        """Other terms of the model that include all variables of this one."""
        return [t for t in self.terms if t != term and set(term) < set(t)]

    def marginal_terms(self) -> list[Term]:
        return [t for t in self.terms if t not in self.kept and not self.contains(t)]


def crossed(
    factors: Mapping[str, Sequence[str]],
    covariates: Sequence[str] = (),
    order: int | None = None,
    kept: Mapping[str, Sequence[str]] | None = None,
) -> Design:
    """All main effects and interactions up to ``order``; ``kept`` factors enter as main effects only."""
    names = [*factors, *covariates]
    top = len(names) if order is None else order
    terms = [t for k in range(1, top + 1) for t in combinations(names, k)]
    blocks = tuple((b,) for b in (kept or {}))
    return Design({**factors, **(kept or {})}, tuple(covariates), (*blocks, *terms), blocks)


def term_name(term: Term) -> str:
    return ":".join(term)


def level_names(variable: str, levels: Sequence[str]) -> list[str]:
    """Column names of levels: other characters than letters and digits become ``_``; names that then are equal get the number of their level."""
    names = [f"{variable}_{re.sub(r'[^0-9A-Za-z]+', '_', level)}" for level in levels]
    return [n if names.count(n) == 1 else f"{n}_{k}" for k, n in enumerate(names, 1)]


def term_columns(design: Design, term: Term) -> dict[str, Column]:
    """The columns of one term: dummies of all levels but the first, covariates, and their products."""
    parts: list[list[tuple[str, Column]]] = []
    for variable in term:
        if variable in design.factors:
            levels = list(design.factors[variable])
            names = level_names(variable, levels)
            parts.append([(n, (F.col(variable) == level).cast("double")) for n, level in list(zip(names, levels))[1:]])
        else:
            parts.append([(variable, F.col(variable).cast("double"))])
    columns = [("", F.lit(1.0))]
    for part in parts:
        columns = [
            (f"{name}_x_{n}" if name else n, c if not name else column * c)
            for name, column in columns
            for n, c in part
        ]
    named = dict(columns)
    if len(named) < len(columns):
        raise ValueError(f"columns of {term_name(term)} share a name")
    return named


def design_columns(design: Design) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for term in design.terms:
        own = term_columns(design, term)
        if both := columns.keys() & own.keys():
            raise ValueError(f"several terms have a column {min(both)}")
        columns |= own
    return columns


def design_matrix(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """The design columns of every row, next to ``keep``. Levels outside of a factor give no row."""
    columns = design_columns(design)
    known = [F.col(f).isin(list(levels)) for f, levels in design.factors.items()]
    rows = df.where(reduce(lambda a, b: a & b, known)) if known else df
    clash = [c for c in keep if c in columns]
    return rows.select(*[c for c in keep if c not in clash], *[c.alias(n) for n, c in columns.items()])


def model_table(df: DataFrame, design: Design, response: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per design cell: size ``n``, ``mean`` and inner sum of squares ``ss`` of the response.

    The score equations, deviance differences and Pearson sums of the families fitted here depend
    on the rows only through these three numbers. So the data are read once, shuffled once after
    partial aggregation, and every later fit works on the table of cells. Rows that miss a
    variable are left out. The result also holds the design columns.
    """
    y = F.col(response).cast("double")
    used = df.na.drop("any", subset=[response, *design.variables])
    cells = used.groupBy(*design.variables, *extra).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss"),
    )
    known = [F.col(f).isin(list(levels)) for f, levels in design.factors.items()]
    for condition in known:
        cells = cells.where(condition)
    columns = {n: c for n, c in design_columns(design).items() if n not in design.covariates}
    casts = {c: F.col(c).cast("double") for c in design.covariates}
    return settle(cells.withColumns({**casts, **columns}), "cells")
