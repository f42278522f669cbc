"""The nine response models as fixed-effects approximations.

Random intercepts of blocks are replaced by block main effects. Estimates therefore need not
equal those of a mixed model fitted by maximum likelihood.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.logit import with_logit
from tidemark.operators.design import Design, crossed, model_table
from tidemark.operators.glm import Family, Fit, fit_glm, fit_negbin2_likelihood, refit_by_dispersion, tweedie_power, value_counts
from tidemark.operators.residuals import durbin_watson, residual_summary, simulated_residuals
from tidemark.operators.terms import drop_table, drop_terms
from tidemark.session import settle

# Factor levels, baseline first.
LEVELS = {
    "location": ["BP", "PA"],
    "barnacles": ["no", "yes"],
    "herbivores": ["con", "in", "out"],
}
BLOCKS = {"block": ["A", "B", "C", "D", "E", "F"]}


@dataclass(frozen=True)
class ModelPlan:
    name: str
    response: str
    factors: Sequence[str]
    order: int
    family: str
    blocks: bool = True
    dispersion: Sequence[str] = ()


# Terms, family and dispersion of each model; every model also has time in weeks.
MODELS = [
    ModelPlan("biomass", "biomass_g", ["location", "barnacles"], 3, "tweedie", dispersion=["barnacles"]),
    ModelPlan("lottia", "count", ["barnacles"], 2, "negbin1", dispersion=["timediff"]),
    ModelPlan("littorina", "count", ["barnacles", "herbivores"], 3, "negbin1", dispersion=["barnacles"]),
    ModelPlan("siphonaria", "count", ["barnacles"], 2, "negbin1", blocks=False),
    ModelPlan("ephemerals", "percent_cover", ["herbivores", "barnacles", "location"], 2, "tweedie"),
    ModelPlan("perennials_first", "percent_cover", ["barnacles", "location", "herbivores"], 3, "tweedie", dispersion=["location"]),
    ModelPlan("perennials", "logit_pc", ["barnacles", "location", "herbivores"], 3, "gaussian", dispersion=["location", "barnacles"]),
    ModelPlan("canopy", "percent_cover", ["barnacles", "herbivores"], 3, "tweedie"),
    ModelPlan("balanus", "count", ["location", "barnacles", "herbivores"], 3, "negbin2", dispersion=["location", "herbivores"]),
    ModelPlan("chthamalus", "count", ["barnacles", "herbivores"], 3, "negbin2", dispersion=["timediff"]),
]


def model_named(name: str) -> ModelPlan:
    return next(m for m in MODELS if m.name == name)


def design_of(plan: ModelPlan, df: DataFrame) -> Design:
    """Design of a plan; blocks that the data lack are left out, as their columns would be empty."""
    kept = {}
    if plan.blocks:
        known = BLOCKS["block"]
        found = {r["block"] for r in df.where(F.col("block").isin(known)).select("block").distinct().collect()}
        kept = {"block": [b for b in known if b in found]} if len(found) > 1 else {}
    return crossed({f: LEVELS[f] for f in plan.factors}, ["timediff"], plan.order, kept)


def fit_plan(plan: ModelPlan, df: DataFrame, by_dispersion: bool = False) -> Fit:
    """Fit one model to its rows; ``by_dispersion`` adds the second fit weighted by dispersion level."""
    if plan.response == "logit_pc" and "logit_pc" not in df.columns:
        df = with_logit(df, "percent_cover", "logit_pc")
    design = design_of(plan, df)
    table = model_table(df, design, plan.response)
    family = Family(plan.family)
    if plan.family == "tweedie":
        family = Family("tweedie", power=tweedie_power(table, [*plan.factors, "timediff"]))
    if plan.family == "negbin2":
        fit = fit_negbin2_likelihood(table, value_counts(df, design, plan.response), design)
    else:
        fit = fit_glm(table, design, family)
    if not (by_dispersion and plan.dispersion):
        return fit
    # a dispersion that follows time is a trend, not a level for each date
    return refit_by_dispersion(fit, plan.dispersion, along="timediff" if "timediff" in plan.dispersion else None)


def simplified(fit: Fit) -> tuple[Fit, DataFrame]:
    """The model after dropping terms while that lowers AIC, and the record of tries."""
    last, records = drop_terms(fit)
    return last, drop_table(fit.table.sparkSession, records)


def checked(plan: ModelPlan, fit: Fit, df: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Scaled residuals per row, their autocorrelation in time, and their spread per factor and time."""
    if plan.response == "logit_pc" and "logit_pc" not in df.columns:
        df = with_logit(df, "percent_cover", "logit_pc")
    rows = settle(simulated_residuals(df, fit, plan.response, keys), "residuals")
    return {
        "rows": rows,
        "time": durbin_watson(rows, "scaled", "timediff", []),
        **{f"by_{v}": residual_summary(rows, "scaled", [v]) for v in [*plan.factors, "timediff"]},
    }
