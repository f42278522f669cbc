"""Grazer counts to biomass: subset, size pools, size-weight curves and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import sum_of
from tidemark.functions.labels import composite_key, recode
from tidemark.operators.allometry import curve_table, fit_loglog, predict_loglog
from tidemark.operators.bootstrap import bootstrap_total, expected_total, number_pool, pool_from_sizes
from tidemark.operators.combine import drop_when, stack_rows
from tidemark.operators.quality import apply_corrections

# The three grazers, and the species codes of the size tables.
GRAZERS = ["Lottia", "Siphonaria", "Littorina"]
LIMPETS = ["Lottia", "Siphonaria"]
SIZE_CODES = {"siphonaria": "Siphonaria", "lsc": "Littorina", "ldig": "Lottia"}
WEIGHT_CODES = {"littorina": "Littorina", "lottia": "Lottia"}

# Rounded (slope, intercept) of ln weight (g) on ln size (mm).
ROUNDED_CURVES = {
    "Siphonaria": (2.8318, -10.6002),
    "Littorina": (2.45328, -9.67482),
    "Lottia": (1.55329, -6.51138),
}
# The published biomass used the Siphonaria curve for both limpets.
PUBLISHED_CURVES = {**ROUNDED_CURVES, "Lottia": ROUNDED_CURVES["Siphonaria"]}

ROW_KEYS = ["location", "block", "barnacles", "herbivores", "plot", "date"]
CARRIED = ["timediff", "days"]


def herbivore_abundance(responses: DataFrame) -> DataFrame:
    """Grazer counts; limpets only where their density was left alone."""
    grazers = responses.where(F.col("species").isin(GRAZERS))
    natural = drop_when(grazers, F.col("species").isin(LIMPETS) & (F.col("herbivores") != "con"))
    return natural.drop("percent_cover").withColumn("plot_location", composite_key("plot", "location"))


def size_table(sizes: DataFrame) -> DataFrame:
    return sizes.select(recode(F.col("sp"), SIZE_CODES).alias("species"), "size_mm")


def size_weight_curves(weights: DataFrame, limpet_weights: DataFrame) -> DataFrame:
    """Fitted curve of each species."""
    pairs = stack_rows(
        weights.select(recode(F.col("sp"), WEIGHT_CODES).alias("species"), "size_mm", "dw_g"),
        limpet_weights.select(F.lit("Siphonaria").alias("species"), "size_mm", "dw_g"),
    )
    return fit_loglog(pairs, ["species"], "size_mm", "dw_g")


def weighed_pool(sizes: DataFrame, curves: DataFrame) -> DataFrame:
    """Identified pool members with their predicted weight, so that a draw needs no arithmetic."""
    return predict_loglog(pool_from_sizes(size_table(sizes), "species", "size_mm"), curves, ["species"], "size_mm", "dw_g")


def published_curves(spark) -> DataFrame:
    return curve_table(spark, PUBLISHED_CURVES)


def abundance_weights(abundance: DataFrame, pool: DataFrame, seed: int = 26) -> DataFrame:
    """Drawn dry weight of each count."""
    numbered = number_pool(pool, "species", ["size_mm", "copy"])
    return bootstrap_total(abundance, numbered, ROW_KEYS, "species", "count", "dw_g", "total_dw_g", seed, CARRIED)


def expected_weights(abundance: DataFrame, pool: DataFrame) -> DataFrame:
    return expected_total(abundance, pool, "species", "count", "dw_g", "total_dw_g")


def herbivore_biomass(weights: DataFrame) -> DataFrame:
    """Total grazer weight per plot and date."""
    keys = ["location", "timediff", "days", "plot", "block", "barnacles"]
    totals = weights.groupBy(*keys).agg(sum_of("total_dw_g").alias("biomass_g"))
    return totals.withColumn("plot_location", composite_key("plot", "location"))


def corrected(responses: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Responses with the values of a corrections table, e.g. for mistyped dates or treatments."""
    return apply_corrections(responses, corrections, keys)
