"""The tables behind the figures: treatment by time summaries with labels and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_of, level_index, recode
from tidemark.functions.logit import with_logit
from tidemark.operators.allometry import regression_band
from tidemark.operators.combine import distinct_values, drop_when, keep_matching, keep_unmatched, stack_rows
from tidemark.operators.summaries import cell_summaries, cell_summary, histogram

# Labels and their order.
HERBIVORE_LABELS = {"con": "Control", "in": "Inclusion", "out": "Exclusion"}
BARNACLE_LABELS = {"no": "-B", "yes": "+B"}
HERBIVORE_ORDER = ["Control", "Inclusion", "Exclusion"]
TREATMENT_ORDER = ["+B PA", "-B PA", "+B BP", "-B BP"]
BIOMASS_ORDER = ["+B BP", "-B BP", "+B PA", "-B PA"]

# The surveys nearest to the equinoxes that the cover models use.
EQUINOX_DATES = {
    "PA": ["2006-04-26", "2006-10-07", "2007-02-19"],
    "BP": ["2006-10-06", "2007-04-06", "2007-07-17"],
}


def of_species(responses: DataFrame, *species: str) -> DataFrame:
    return responses.where(F.col("species").isin(list(species)))


def ephemerals(responses: DataFrame) -> DataFrame:
    """Ephemeral cover without the first date of the invaded site, an artefact of the treatment."""
    return drop_when(of_species(responses, "Ephemerals"), (F.col("location") == "PA") & (F.col("days") == 0))


def perennials(responses: DataFrame) -> DataFrame:
    return of_species(responses, "Perennials")


def equinox_subset(df: DataFrame) -> DataFrame:
    return stack_rows(
        *[
            df.where((F.col("location") == site) & F.col("date").isin([F.lit(d).cast("date") for d in dates]))
            for site, dates in EQUINOX_DATES.items()
        ]
    )


def labelled(summary: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Treatment labels, and the rows in the order of panels, series and time."""
    by = []
    if "herbivores" in summary.columns:
        summary = summary.withColumn("herbivores", recode(F.col("herbivores"), HERBIVORE_LABELS))
        by.append(level_index(F.col("herbivores"), HERBIVORE_ORDER))
    summary = summary.withColumn("barnacles", recode(F.col("barnacles"), BARNACLE_LABELS))
    if order is not None:
        summary = summary.withColumn("treatment", label_of("barnacles", "location"))
        by.append(level_index(F.col("treatment"), order))
    return summary.orderBy(*by, "barnacles", "days" if "days" in summary.columns else "timediff")


def series(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str] | None = None) -> DataFrame:
    """Mean, error and bounds per treatment and survey."""
    return labelled(cell_summary(df, [*by, "days", "timediff"], value), order)


def split_analysed(summary: DataFrame, analysed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells at surveys that were analysed, and the rest."""
    days = distinct_values(analysed_rows, "days")
    return keep_matching(summary, days, ["days"]), keep_unmatched(summary, days, ["days"])


def ephemeral_cover(responses: DataFrame) -> DataFrame:
    return series(ephemerals(responses), ["location", "barnacles", "herbivores"], "percent_cover", TREATMENT_ORDER)


def perennial_cover(responses: DataFrame) -> DataFrame:
    """Cover in percent, and the same on the logit scale with prefix ``log_``, in one pass."""
    by = ["location", "barnacles", "herbivores", "days", "timediff"]
    rows = with_logit(perennials(responses), "percent_cover", "logit_pc")
    return labelled(cell_summaries(rows, by, {"": "percent_cover", "log_": "logit_pc"}), TREATMENT_ORDER)


def balanus_recruits(responses: DataFrame) -> DataFrame:
    return series(of_species(responses, "Balanus_recruits"), ["location", "barnacles", "herbivores"], "count", TREATMENT_ORDER)


def chthamalus_recruits(responses: DataFrame) -> DataFrame:
    return series(of_species(responses, "Chthamalus_recruits"), ["barnacles", "herbivores"], "count")


def siphonaria_recruits(responses: DataFrame) -> DataFrame:
    return series(of_species(responses, "Siphonaria_recruits"), ["barnacles", "herbivores"], "count")


def littorina_abundance(abundance: DataFrame) -> DataFrame:
    return series(of_species(abundance, "Littorina"), ["barnacles", "herbivores"], "count")


def limpet_abundance(abundance: DataFrame) -> DataFrame:
    return series(of_species(abundance, "Lottia", "Siphonaria"), ["barnacles", "location", "species"], "count", TREATMENT_ORDER)


def biomass(biomass_table: DataFrame) -> DataFrame:
    by = [c for c in ("location", "barnacles", "days", "timediff") if c in biomass_table.columns]
    return labelled(cell_summary(biomass_table, by, "biomass_g"), BIOMASS_ORDER)


def canopy_cover(canopy: DataFrame) -> DataFrame:
    return series(canopy, ["barnacles", "herbivores"], "percent_cover")


def size_histogram(sizes: DataFrame) -> DataFrame:
    """Shell lengths in 1 mm bins from 0 to 20 mm, per species."""
    return histogram(sizes, ["species"], "size_mm", 1.0, 0.0, 20.0).orderBy("species", "bin")


def allometry_line(weights: DataFrame) -> DataFrame:
    """Fitted line of ln weight on ln size with its 95 % band."""
    logs = weights.select(F.lit("Siphonaria").alias("species"), F.ln("size_mm").alias("ln_size"), F.ln("dw_g").alias("ln_weight"))
    return regression_band(logs, ["species"], "ln_size", "ln_weight")
