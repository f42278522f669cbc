"""Harmonised tables against values measured on the survey files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import code_lists, declared_ranges
from tidemark.plans import figures as G
from tidemark.plans.surveys import canopy_clean, survey_report
from tidemark.sources.schemas import BIO_RESPONSES, _layout
from tidemark.sources.tables import read_responses, write_responses

# (site, species): rows, counted rows, sum of counts, sum of covers
EXPECTED = {
    ("BP", "Balanus_recruits"): (360, 360, 3397, None),
    ("BP", "Chthamalus_recruits"): (360, 360, 1265, None),
    ("BP", "Littorina"): (360, 360, 2599, None),
    ("BP", "Lottia"): (360, 360, 760, None),
    ("BP", "Lottia_plus_added"): (360, 360, 764, None),
    ("BP", "Ephemerals"): (360, 0, None, 2935.367521),
    ("BP", "Perennials"): (360, 0, None, 1901.021368),
    ("BP", "Pyropia"): (360, 0, None, 269.235043),
    ("BP", "Scunge"): (360, 0, None, 1227.205128),
    ("BP", "Ulva"): (360, 0, None, 1438.927350),
    ("PA", "Balanus_recruits"): (332, 332, 219, None),
    ("PA", "Mussels"): (332, 332, 12, None),
    ("PA", "Siphonaria"): (375, 369, 1182, None),
    ("PA", "Siphonaria_recruits"): (332, 332, 58, None),
    ("PA", "Tegula"): (332, 332, 1, None),
    ("PA", "Blindigia"): (332, 0, None, 129),
    ("PA", "Ephemerals"): (368, 0, None, 1542),
    ("PA", "Perennials"): (368, 0, None, 21077),
    ("PA", "Polysiphonia"): (332, 0, None, 4),
    ("PA", "Porphyra"): (332, 0, None, 17),
}


def test_long_table(responses):
    assert responses.columns == BIO_RESPONSES.names
    assert responses.count() == 7035
    got = {
        (r["location"], r["species"]): r
        for r in responses.groupBy("location", "species")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("count").alias("k"),
            F.sum("count").alias("c"),
            F.sum("percent_cover").alias("p"),
        )
        .collect()
    }
    assert set(got) == set(EXPECTED)
    for key, (n, k, c, p) in EXPECTED.items():
        row = got[key]
        assert (row["n"], row["k"]) == (n, k), key
        assert row["c"] == (pytest.approx(c) if c is not None else None), key
        assert row["p"] == (pytest.approx(p, abs=1e-5) if p is not None else None), key


def test_weeks(responses):
    last = responses.where(F.col("date") == "2007-02-19").where("location = 'PA'").first()
    assert (last["days"], last["timediff"]) == (434, 62.0)
    day = responses.where(F.col("date") == "2006-12-02").where("location = 'BP'").first()
    assert day["days"] == 170
    assert day["timediff"] == pytest.approx(24.2916666667, abs=0.01)


def test_double_checked_plot_survives_and_lost_plots_do_not(raw):
    from tidemark.operators.combine import drop_containing

    kept = drop_containing(raw["community"], "notes", "lost")
    assert raw["community"].count() - kept.count() == 8
    assert kept.where(F.col("notes").contains("double-check")).count() == 1


def test_long_table_round_trip(spark, responses, tmp_path):
    path = str(tmp_path / "responses")
    write_responses(responses, path)
    back = read_responses(spark, path)
    assert back.columns == responses.columns
    assert back.exceptAll(responses).count() == responses.exceptAll(back).count() == 0
    plan = back.where("species = 'Lottia' and location = 'BP'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(species" in plan


def test_canopy_equals_shipped_table(raw, find):
    shipped = find(
        _layout("date:t|block:s|barnacles:s|herbivores:s|fucus_raw:d|fucus_cover:d|plot:i|timediff:d|percent_cover:d"),
        "date", "block", "balanus", "herbivores", "fucus_raw",
    )
    ours = canopy_clean(raw["canopy"])
    keys = ["date", "plot"]
    both = ours.join(shipped.select(*keys, F.col("timediff").alias("t"), F.col("percent_cover").alias("p")), keys)
    assert ours.count() == shipped.count() == both.count() == 360
    worst = both.agg(
        F.max(F.abs(F.col("timediff") - F.col("t"))).alias("t"), F.max(F.abs(F.col("percent_cover") - F.col("p"))).alias("p")
    ).first()
    assert worst["t"] < 0.01 and worst["p"] < 1e-9


def test_canopy_means(raw):
    rows = G.canopy_cover(canopy_clean(raw["canopy"])).where("days = 400").collect()
    got = {(r["barnacles"], r["herbivores"]): (r["av"], r["se"], r["n"]) for r in rows}
    expected = {
        ("-B", "Control"): (0, 0),
        ("-B", "Inclusion"): (0.641025633, 0.641025633),
        ("-B", "Exclusion"): (1.923076917, 1.923076917),
        ("+B", "Control"): (11.378205133, 2.983525047),
        ("+B", "Inclusion"): (25.961538450, 15.502353960),
        ("+B", "Exclusion"): (25.0, 12.223268144),
    }
    assert set(got) == set(expected)
    for key, (av, se) in expected.items():
        assert got[key] == (pytest.approx(av, abs=1e-7), pytest.approx(se, abs=1e-7), 6)


def test_report_finds_the_known_bad_rows(raw, responses):
    codes = code_lists(raw["factors"])
    assert {r["code"] for r in codes.where("field = 'herbivores'").collect()} == {"con", "in", "out"}
    ranges = {r["field"]: (r["low"], r["high"]) for r in declared_ranges(raw["variables"]).collect()}
    assert ranges["%ephem"] == (0, 100) and ranges["plot"] == (0, 36)
    report = survey_report(responses, codes, "2007-12-31")
    late = report.where("rule = 'after the study'")
    assert sorted(r["plot"] for r in late.select("plot").distinct().collect()) == [19, 20, 21, 22]
    assert report.where("rule = 'required'").count() == 5
    assert report.where("rule = 'code'").count() == 0
    canopy = canopy_clean(raw["canopy"]).withColumns({"location": F.lit("BP"), "species": F.lit("Fucus")})
    swapped = survey_report(canopy, codes, "2007-12-31").where("rule = 'code'").collect()
    assert {(r["field"], r["value"], r["date"]) for r in swapped} == {
        ("barnacles", "out", dt.date(2006, 6, 12)),
        ("herbivores", "no", dt.date(2006, 6, 12)),
    }


def test_corrections(spark, responses):
    from tidemark.plans.grazers import corrected

    fixes = spark.createDataFrame(
        [("PA", 19, dt.date(2021, 12, 6), "no")], "location string, plot int, date date, barnacles string"
    )
    before = responses.where("location = 'PA' and plot = 19 and date = '2021-12-06'")
    after = corrected(responses, fixes, ["location", "plot", "date"])
    assert after.columns == responses.columns
    assert after.count() == responses.count()
    changed = after.where("location = 'PA' and plot = 19 and date = '2021-12-06'")
    assert changed.where("barnacles = 'no'").count() == before.count() > 0
