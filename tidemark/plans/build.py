"""All end products from the raw tables, written to one folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.allometry import curve_table
from tidemark.plans import climate as C
from tidemark.plans import figures as G
from tidemark.plans import grazers as Z
from tidemark.plans.surveys import bio_responses, canopy_clean, unreadable_report
from tidemark.session import settle
from tidemark.sources.tables import read_responses, write_responses


def build_products(
    spark: SparkSession, raw: Mapping[str, DataFrame], out: str, published: bool = False, seed: int = 26
) -> dict[str, DataFrame]:
    """Write the clean tables and the table behind each figure as Parquet and return them by name.

    ``raw`` holds native, community, adults, start, canopy, sizes, weights, limpet_weights,
    native_humidity and invaded_humidity, and may hold native_temperature and
    invaded_temperature. ``published`` weighs grazers as the published totals did.
    """
    done: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{out}/{name}")
        done[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
        return done[name]

    def contrast(name: str, df: DataFrame, value: str) -> None:
        """The one-factor model of a value by site: coefficients and variance table."""
        coefs, variances = C.site_contrast(df.where(F.col(value).isNotNull()), value, C.NATIVE_REGION)
        keep(f"{name}_model", coefs)
        keep(f"{name}_anova", variances)

    write_responses(bio_responses(raw["native"], raw["community"], raw["adults"], raw["start"]), f"{out}/bio_responses")
    responses = done["bio_responses"] = read_responses(spark, f"{out}/bio_responses")
    keep("unreadable", unreadable_report(raw["native"], raw["community"], raw["adults"], raw["start"]))
    canopy = keep("canopy_clean", canopy_clean(raw["canopy"]))
    humidity = keep("humidity_clean", C.humidity_clean(raw["native_humidity"], raw["invaded_humidity"]))

    abundance = keep("herbivore_abundance", Z.herbivore_abundance(responses))
    fitted = Z.size_weight_curves(raw["weights"], raw["limpet_weights"])
    curves = curve_table(spark, Z.PUBLISHED_CURVES) if published else fitted
    pool = settle(Z.weighed_pool(raw["sizes"], curves), "pool")
    biomass = keep("herbivore_biomass", Z.herbivore_biomass(Z.abundance_weights(abundance, pool, seed)))

    keep("size_weight_curves", fitted)
    keep("humidity_box", C.humidity_box(humidity))
    contrast("humidity", humidity, "humidity")
    keep("littorina_abundance", G.littorina_abundance(abundance))
    keep("limpet_abundance", G.limpet_abundance(abundance))
    keep("biomass", G.biomass(biomass))
    for name, cover, rows in (
        ("ephemeral_cover", G.ephemeral_cover(responses), G.ephemerals(responses)),
        ("perennial_cover", G.perennial_cover(responses), G.perennials(responses)),
    ):
        summary = keep(name, cover)
        analysed, rest = G.split_analysed(summary, G.equinox_subset(rows))
        keep(f"{name}_analysed", analysed)
        keep(f"{name}_other", rest)
    keep("balanus_recruits", G.balanus_recruits(responses))
    keep("chthamalus_recruits", G.chthamalus_recruits(responses))
    keep("siphonaria_recruits", G.siphonaria_recruits(responses))
    keep("canopy_cover", G.canopy_cover(canopy))
    keep("size_histogram", G.size_histogram(Z.size_table(raw["sizes"])))
    keep("allometry_line", G.allometry_line(raw["limpet_weights"]))

    if "native_temperature" in raw and "invaded_temperature" in raw:
        temperature = keep("temperature_clean", C.temperature_clean(raw["native_temperature"], raw["invaded_temperature"]))
        keep("temperature_band", C.temperature_band(temperature))
        loggers = keep("logger_summary", C.logger_summary(temperature))
        for value in [c for c in loggers.columns if c not in ("site", "number")]:
            contrast(f"temperature_{value}", loggers, value)
    return done
