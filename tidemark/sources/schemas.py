"""Column layouts of the survey, size and climate tables. Headers are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T


def _layout(text: str) -> T.StructType:
    """``name:type`` items separated by ``|``; names may hold spaces, signs and dots."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "t": T.DateType()}
    fields = [item.strip().rsplit(":", 1) for item in text.split("|")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Survey with counts and covers of the native site, all dates.
NATIVE_COMMUNITY = _layout(
    "date:t|block:s|barnacles:s|herbivores:s|plot:i|Bgrec:i|Cdrec:i|Lot:i|Lot_plus_added:i|Lit:i"
    "|rawU:d|rawP:d|raws:d|rawperen:d|%U:d|%P:d|%s:d|%ephem:d|%peren:d|note:s"
)
# First survey of the invaded site.
INVADED_START = _layout("barnacles:s|herbivores:s|Dens Siph:i|%ephem:i|%peren:i|plot:i")
# Later surveys of the invaded site.
INVADED_COMMUNITY = _layout(
    "herbivores:s|barnacles:s|plot:i|date:t|Dens Siph:i|Bgrec:i|mussels:i|cover Ralfsia sp.:d|cover Blindigia:d"
    "|cover Porphyra:d|polysiphonia:d|%ephem:d|Tegula:i|notes:s"
)
# Adult limpets of the invaded site: a month and a density column per survey. The file repeats
# its headers, so the density columns are named by position with the dates of the surveys.
ADULT_LIMPET_DATES = [
    "2006-04-26", "2006-05-12", "2006-06-12", "2006-08-09", "2006-09-09",
    "2006-10-07", "2006-11-09", "2006-12-04", "2007-01-06", "2007-02-19",
]
ADULT_LIMPETS = _layout(
    "barnacles:s|herbivores:s|plot:i"
    + "".join(f"|month{i}:s|{date}:i" for i, date in enumerate(ADULT_LIMPET_DATES, 1))
)
CANOPY_COVER = _layout("date:t|block:s|barnacles:s|herbivores:s|fucus_raw:d|fucus_cover:d|plot:i")
GRAZER_SIZES = _layout("date:t|sp:s|barnacles:s|size_mm:d")
SIZE_WEIGHTS = _layout("size_mm:d|dw_g:d|sp:s")
LIMPET_WEIGHTS = _layout("size_mm:d|dw_mg:d|dw_g:d")
NATIVE_HUMIDITY = _layout("year:i|month:i|humidity:d|site:s")
INVADED_HUMIDITY = _layout(
    "month:i|year:i|humidity:d|mean_temp:d|mean_max_temp:d|mean_min_temp:d|max_temp:d|min_temp:d"
)
LOGGER_READINGS = _layout("date_ibutton:s|time_ibutton:s|number:i|temp:d")
FACTOR_CODES = _layout("attributeName:s|code:s|definition:s")
VARIABLES = _layout("attributeName:s|attributeDefinition:s|formatString:s|unit:s|numberType:s")

# The harmonised table; ``days`` is the exact form of ``timediff`` (weeks).
BIO_RESPONSES = _layout(
    "date:t|block:s|barnacles:s|herbivores:s|plot:i|species:s|count:d|percent_cover:d|location:s|timediff:d|days:i"
)
