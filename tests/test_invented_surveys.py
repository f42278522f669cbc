"""The survey products on small invented tables in the survey layouts, worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import code_lists, dictionary_violations
from tidemark.plans.climate import humidity_clean, site_contrast
from tidemark.plans.surveys import bio_responses, canopy_clean, survey_report
from tidemark.sources import schemas as S


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def responses(spark):
    raws = (None,) * 4
    native = [
        (day("2006-01-01"), "A", "no", "con", 1, 3, None, 2, 5, 1, *raws, 10.0, None, 0.0, 20.0, 30.0, None),
        (day("2006-01-15"), "A", "no", "con", 1, 4, 2, 0, 0, 9, *raws, 15.0, 1.0, 0.0, 25.0, 35.0, "windy"),
        (day("2008-02-01"), "B", "yes", "open", 2, 0, 0, 0, 0, 0, *raws, 140.0, 0.0, 0.0, 0.0, 0.0, None),
    ]
    community = [
        ("con", "no", 7, day("2006-01-09"), 4, 1, None, 5.0, None, 0.0, 2.0, 3.0, 6, None),
        ("con", "no", 8, day("2006-01-09"), 40, 10, 0, 50.0, 0.0, 0.0, 20.0, 30.0, 60, "plot lost"),
    ]
    adults = [("no", "con", 7, *[x for k in range(10) for x in (f"m{k}", 11 if k == 0 else None)])]
    start = [("no", "con", 9, 12, 25, 7), ("no", "con", 9, 12, 25, 7)]
    tables = [(native, S.NATIVE_COMMUNITY), (community, S.INVADED_COMMUNITY), (adults, S.ADULT_LIMPETS), (start, S.INVADED_START)]
    return bio_responses(*[spark.createDataFrame(rows, schema) for rows, schema in tables]).cache()


def test_rows_and_values(responses):
    rows = responses.collect()
    assert len(rows) == 3 * 10 + 9 + 10 + 3
    at = {(r["location"], r["plot"], str(r["date"]), r["species"]): r for r in rows}
    first = at["BP", 1, "2006-01-01", "Chthamalus_recruits"]
    assert first["count"] == 0 and first["percent_cover"] is None and first["days"] == 0
    again = at["BP", 1, "2006-01-15", "Pyropia"]
    assert again["percent_cover"] == 1 and again["count"] is None and (again["days"], again["timediff"]) == (14, 2.0)
    assert at["BP", 1, "2006-01-01", "Lottia_plus_added"]["count"] == 5
    later = at["PA", 7, "2006-01-09", "Siphonaria_recruits"]
    assert (later["count"], later["days"], later["timediff"], later["block"]) == (4, 28, 4.0, "A")
    assert at["PA", 7, "2006-01-09", "Mussels"]["count"] == 0 and at["PA", 7, "2006-01-09", "Perennials"]["percent_cover"] == 5
    assert at["PA", 7, "2006-04-26", "Siphonaria"]["count"] == 11 and at["PA", 7, "2006-05-12", "Siphonaria"]["count"] is None
    assert at["PA", 7, "2005-12-12", "Siphonaria"]["count"] == 9 and at["PA", 7, "2005-12-12", "Perennials"]["percent_cover"] == 25
    assert not [k for k in at if k[1] == 8]


def test_report(spark, responses):
    factors = [("herbivores", c, "") for c in ("con", "in", "out", "con")] + [("elsewhere", "x", "")]
    codes = code_lists(spark.createDataFrame(factors, S.FACTOR_CODES))
    report = survey_report(responses, codes, "2007-12-31").groupBy("rule", "field").count().collect()
    assert {(r["rule"], r["field"]): r["count"] for r in report} == {("code", "herbivores"): 10, ("range", "percent_cover"): 1, ("after the study", ""): 10}


def test_dictionaries_are_tables(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, 50.0), (3, "z", None), (4, "b", float("nan"))], "id int, kind string, x double")
    codes = spark.createDataFrame([("kind", "a"), ("kind", "b"), ("kind", None), ("other", "z")], "field string, code string")
    ranges = spark.createDataFrame([("x", 0.0, 10.0)], "field string, low double, high double")
    found = dictionary_violations(df, ["id"], ["kind", "x"], codes, ranges).collect()
    assert {(r["id"], r["field"], r["rule"]) for r in found} == {(3, "kind", "code"), (2, "x", "range"), (4, "x", "range")}
    assert dictionary_violations(df, ["id"], ["kind"]).count() == 0


def test_canopy_and_humidity(spark):
    canopy = spark.createDataFrame([(day("2006-01-01"), "A", "no", "con", 1.0, 0.25, 1), (day("2006-01-08"), "A", "no", "con", 1.0, 0.5, 1)], S.CANOPY_COVER)
    assert sorted((r["percent_cover"], r["timediff"]) for r in canopy_clean(canopy).collect()) == [(25.0, 0.0), (50.0, 1.0)]
    native = spark.createDataFrame([(2016, 1, h, "x") for h in (80.0, 90.0)] + [(2016, 2, 70.0, "x")], S.NATIVE_HUMIDITY)
    invaded = spark.createDataFrame([(m, 2016, 60.0 + m, *[None] * 5) for m in (1, 2)], S.INVADED_HUMIDITY)
    clean = humidity_clean(native, invaded)
    assert sorted((r["site"], r["month"], r["humidity"]) for r in clean.collect()) == [("BS", 1, 85.0), ("BS", 2, 70.0), ("NG", 1, 61.0), ("NG", 2, 62.0)]
    coefs, variances = site_contrast(clean, "humidity", "BS")
    slope = coefs.where(F.col("term") == "NG").first()
    assert slope["estimate"] == pytest.approx(-16.0) and slope["p_value"] == pytest.approx(variances.first()["p_value"])
