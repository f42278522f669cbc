"""Survey tables of both sites to one long table of responses, and the canopy cover table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import relabel
from tidemark.functions.dates import iso_date
from tidemark.operators.combine import distinct_rows, drop_containing, stack_rows
from tidemark.operators.elapsed import since_start
from tidemark.operators.quality import dictionary_violations, violations
from tidemark.operators.reshape import families_to_long, to_long_by_prefix
from tidemark.functions.dates import since_anchor
from tidemark.sources.schemas import BIO_RESPONSES
from tidemark.sources.tables import UNREADABLE, unreadable_fields

NATIVE, INVADED = "BP", "PA"

# First survey of the invaded site, and its only block.
INVADED_FIRST_DATE = "2005-12-12"
INVADED_BLOCK = "A"

# Measures and their labels, applied as patterns in this order. The limpet counts
# after treatment corrections therefore end up as "Lottia_plus_added".
NATIVE_COUNTS = ["Bgrec", "Cdrec", "Lot", "Lot_plus_added", "Lit"]
NATIVE_COVERS = ["%U", "%P", "%s", "%ephem", "%peren"]
NATIVE_LABELS = {
    "Bgrec": "Balanus_recruits",
    "Cdrec": "Chthamalus_recruits",
    "Lot": "Lottia",
    "Lit": "Littorina",
    "%U": "Ulva",
    "%P": "Pyropia",
    "%s": "Scunge",
    "%ephem": "Ephemerals",
    "%peren": "Perennials",
}
INVADED_COUNTS = ["Dens Siph", "Bgrec", "mussels", "Tegula"]
INVADED_COVERS = ["cover Ralfsia sp.", "cover Blindigia", "cover Porphyra", "polysiphonia", "%ephem"]
INVADED_LABELS = {
    "cover Ralfsia sp.": "Perennials",
    "Dens Siph": "Siphonaria_recruits",
    "cover Blindigia": "Blindigia",
    "cover Porphyra": "Porphyra",
    "polysiphonia": "Polysiphonia",
    "%ephem": "Ephemerals",
    "Bgrec": "Balanus_recruits",
    "mussels": "Mussels",
}
START_COUNTS = ["Dens Siph"]
START_COVERS = ["%ephem", "%peren"]
START_LABELS = {"Dens Siph": "Siphonaria", "%ephem": "Ephemerals", "%peren": "Perennials"}


def _faults(df: DataFrame) -> str | None:
    """The column of faults of a table from :func:`~tidemark.sources.tables.read_csv_checked`."""
    return UNREADABLE if UNREADABLE in df.columns else None


def native_responses(community: DataFrame) -> DataFrame:
    """Missing measures count as 0, unreadable ones stay missing; weeks run from the first date of the table."""
    long = families_to_long(
        community,
        ["date", "block", "barnacles", "herbivores", "plot"],
        {"count": NATIVE_COUNTS, "percent_cover": NATIVE_COVERS},
        "species",
        fill=0.0,
        faults=_faults(community),
    ).withColumns({"location": F.lit(NATIVE), "species": relabel(F.col("species"), NATIVE_LABELS)})
    return since_start(long, "date", ["location"])


def invaded_responses(community: DataFrame, adults: DataFrame, start: DataFrame) -> DataFrame:
    """Plots noted as lost are left out and other missing measures count as 0; adult limpets and unreadable fields keep theirs."""
    later = families_to_long(
        drop_containing(community, "notes", "lost"),
        ["date", "barnacles", "herbivores", "plot"],
        {"count": INVADED_COUNTS, "percent_cover": INVADED_COVERS},
        "species",
        fill=0.0,
        faults=_faults(community),
    ).withColumn("species", relabel(F.col("species"), INVADED_LABELS))
    limpets = to_long_by_prefix(adults, ["barnacles", "herbivores", "plot"], "200", "date", "count").withColumn(
        "species", F.lit("Siphonaria")
    )
    first = families_to_long(
        start,
        ["barnacles", "herbivores", "plot"],
        {"count": START_COUNTS, "percent_cover": START_COVERS},
        "species",
        fill=0.0,
        faults=_faults(start),
    ).withColumns(
        {"species": relabel(F.col("species"), START_LABELS), "date": iso_date(F.lit(INVADED_FIRST_DATE))}
    )
    tagged = stack_rows(later, limpets, distinct_rows(first)).withColumns(
        {"location": F.lit(INVADED), "block": F.lit(INVADED_BLOCK)}
    )
    return since_anchor(tagged, "date", INVADED_FIRST_DATE)


def bio_responses(native: DataFrame, community: DataFrame, adults: DataFrame, start: DataFrame) -> DataFrame:
    """The long table of both sites: one row per site, plot, date and species."""
    both = stack_rows(native_responses(native), invaded_responses(community, adults, start))
    return distinct_rows(both.select(*BIO_RESPONSES.names))


def canopy_clean(canopy: DataFrame) -> DataFrame:
    """Cover in percent and weeks since the first date."""
    one_site = canopy.withColumn("location", F.lit(NATIVE))
    return since_start(one_site, "date", ["location"]).withColumn(
        "percent_cover", F.col("fucus_cover") * 100
    ).drop("location")


REPORT_KEYS = {"location": "string", "plot": "int", "date": "date", "species": "string"}


def unreadable_report(native: DataFrame, community: DataFrame, adults: DataFrame, start: DataFrame) -> DataFrame:
    """Fields of the raw survey tables that are no values of their type, in the form of :func:`survey_report`.

    Tables that were read without a check have none. The counts of adult limpets carry the date in
    the name of their column.
    """
    none = F.lit(None)
    first = iso_date(F.lit(INVADED_FIRST_DATE))
    parts = [
        (native, NATIVE, F.col("date"), NATIVE_LABELS),
        (community, INVADED, F.col("date"), INVADED_LABELS),
        (adults, INVADED, F.try_to_date("field", "yyyy-MM-dd"), {}),
        (start, INVADED, first, START_LABELS),
    ]
    found = []
    for df, site, date, labels in parts:
        if UNREADABLE not in df.columns:
            continue
        fields = unreadable_fields(df, [k for k in ("plot", "date") if k in df.columns])
        species = relabel(F.col("field"), labels) if labels else F.lit("Siphonaria")
        found.append(
            fields.select(
                F.lit(site).alias("location"), "plot", date.alias("date"),
                F.when(~F.col("field").isin("date", "plot", "record"), species).alias("species"),
                "field", F.lit("unreadable").alias("rule"), "value",
            )
        )
    if not found:
        return native.limit(0).select(*[none.cast(k).alias(c) for c, k in {**REPORT_KEYS, **dict.fromkeys(["field", "rule", "value"], "string")}.items()])
    return stack_rows(*found)


def survey_report(responses: DataFrame, codes: DataFrame, last_date: str, unreadable: DataFrame | None = None) -> DataFrame:
    """Broken codes, covers outside of 0-100, missing plots and impossible dates, by plot and date.

    ``codes`` is a table of fields and their codes (:func:`~tidemark.operators.quality.code_lists`),
    ``unreadable`` what :func:`unreadable_report` found in the raw tables.
    """
    keys = list(REPORT_KEYS)
    late: Column = F.col("date") > F.lit(last_date).cast("date")
    rules = violations(responses, keys, ranges={"percent_cover": (0.0, 100.0)}, required=["plot"], rules={"after the study": late})
    fields = [c for c in ("block", "barnacles", "herbivores") if c in responses.columns]
    found = rules.unionByName(dictionary_violations(responses, keys, fields, codes))
    return found if unreadable is None else found.unionByName(unreadable)
