"""How missing values behave, on small literal tables: the driver tables hold none."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.aggregates import max_of, mean_of, sd_of, se_of, sum_of
from tidemark.functions.dates import days_to_anchor, iso_date, us_date
from tidemark.functions.labels import composite_key, label_of, level_index, recode, relabel, within_levels
from tidemark.operators import combine as J
from tidemark.operators import reshape as R
from tidemark.operators.bootstrap import with_copies
from tidemark.operators.quantiles import exact_percentiles
from tidemark.operators.summaries import cell_summary, histogram, monthly_mean
from tidemark.sources.tables import read_csv, read_csv_inferred, write_csv
from tidemark.sources.schemas import _layout


def test_text_filter_keeps_rows_without_text(spark):
    df = spark.createDataFrame([(1, None), (2, "lost plot"), (3, "fine")], "id int, notes string")
    assert [r["id"] for r in J.drop_containing(df, "notes", "lost").orderBy("id").collect()] == [1, 3]


def test_conditional_exclusion_drops_unknown(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None), ("b", "y")], "k string, t string")
    kept = J.drop_when(df, (F.col("k") == "a") & (F.col("t") != "y"))
    assert sorted((r["k"], r["t"]) for r in kept.na.fill("-").collect()) == [("b", "-"), ("b", "y")]


def test_joins_match_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    rows = {(r["k"], r["a"], r["b"]) for r in J.full_join(a, b, ["k"]).collect()}
    assert rows == {("x", 1, None), (None, 2, 10), ("y", None, 20)}
    assert [r["a"] for r in J.keep_matching(a, b, ["k"]).collect()] == [2]
    assert [r["a"] for r in J.keep_unmatched(a, b, ["k"]).collect()] == [1]
    assert J.stack_rows(a, b).count() == 4


def test_aggregates_propagate_missing_unless_told_not_to(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0), ("c", None)], "k string, x double")
    out = {
        r["k"]: r
        for r in df.groupBy("k")
        .agg(
            mean_of("x").alias("m"), mean_of("x", True).alias("mr"), sum_of("x").alias("s"), sum_of("x", True).alias("sr"),
            max_of("x").alias("x0"), max_of("x", True).alias("x1"), sd_of("x").alias("d"), sd_of("x", True).alias("dr"),
            se_of("x").alias("e"), se_of("x", True).alias("er"),
        )
        .collect()
    }
    a, b, c = out["a"], out["b"], out["c"]
    assert [a[k] for k in ("m", "s", "x0", "d", "e")] == [None] * 5
    assert (a["mr"], a["sr"], a["x1"]) == (2.0, 4.0, 3.0)
    assert a["er"] == pytest.approx(a["dr"] / 2**0.5)
    assert (b["m"], b["s"], b["d"], b["e"]) == (2.0, 2.0, None, None)
    assert (c["mr"], c["x1"], c["er"]) == (None, None, None)


def test_missing_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, x double")
    rows = {r["k"]: r for r in cell_summary(df, ["k"], "x").collect()}
    assert (rows[None]["n"], rows[None]["av"], rows[None]["lo"]) == (2, 2.0, 1.0)
    assert {r["k"]: r["p50"] for r in exact_percentiles(df, ["k"], "x", [0.5]).collect()} == {None: 2.0, "a": 5.0}


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4)] + [("a", None), ("b", None)], "k string, x double")
    rows = exact_percentiles(df, ["k"], "x", [0.99]).collect()
    assert [(r["k"], pytest.approx(r["p99"])) for r in rows] == [("a", 3.96)]


def test_relabel_runs_in_order(spark):
    df = spark.createDataFrame([("Lot",), ("Lot_plus_added",), (None,)], "x string")
    rules = {"Lot": "Lottia", "Lot_plus_added": "Lottia_replaced"}
    assert [r[0] for r in df.select(relabel(F.col("x"), rules)).collect()] == ["Lottia", "Lottia_plus_added", None]
    dollars = spark.createDataFrame([("a.b",)], "x string").select(relabel(F.col("x"), {r"\.": "$1\\"})).first()[0]
    assert dollars == "a$1\\b"


def test_recode_and_levels(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("out",), (None,)], "x string")
    x = F.col("x")
    rows = df.select(
        recode(x, {"no": "-B", "yes": "+B"}), recode(x, {"no": "-B"}, False), within_levels(x, ["no", "yes"]), level_index(x, ["yes", "no"])
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("-B", "-B", "no", 2), ("+B", None, "yes", 1), ("out", None, None, None), (None, None, None, None),
    ]


def test_keys_show_missing_parts(spark):
    df = spark.createDataFrame([(None, "PA"), (3, "BP")], "plot int, location string")
    assert [tuple(r) for r in df.select(composite_key("plot", "location"), label_of("location", "plot")).collect()] == [
        ("NA_PA", "PA NA"), ("3_BP", "BP 3"),
    ]


def test_no_copies_of_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", 2), ("c", None), ("d", 5)], "k string, n int")
    for block in (100, 2):
        rows = with_copies(df, "n", "i", block).groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
        assert {r["k"]: r["i"] for r in rows} == {"b": [1, 2], "d": [1, 2, 3, 4, 5]}


def test_dates(spark):
    df = spark.createDataFrame([("6/3/2006", "2006-06-03", "BP"), ("x", "y", "QQ")], "us string, iso string, site string")
    rows = df.select(
        us_date(F.col("us"), strict=False), iso_date(F.col("iso"), strict=False),
        days_to_anchor(F.lit("2006-06-01").cast("date"), F.col("site"), {"BP": "2006-06-21"}),
    ).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2006, 6, 3), dt.date(2006, 6, 3), -20), (None, None, None)]


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 5.0)], "id int, `a b.c` double, `2006-01-02` double")
    long = R.to_long(df, ["id"], ["a b.c", "2006-01-02"], "name", "x")
    assert long.count() == 4 and long.where("x is null").count() == 2
    assert R.to_long(df, ["id"], ["a b.c"], "name", "x", fill=0).agg(F.sum("x")).first()[0] == 2.0
    dated = R.to_long_by_prefix(df, ["id"], "200", "date", "x").collect()
    assert {(r["id"], r["date"], r["x"]) for r in dated} == {(1, dt.date(2006, 1, 2), None), (2, dt.date(2006, 1, 2), 5.0)}
    back = R.to_wide(long, ["id"], "name", ["a b.c", "2006-01-02"], "x").select(*[F.col(f"`{c}`") for c in df.columns])
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0


def test_two_families(spark):
    df = spark.createDataFrame([(1, 2, None, 7.0)], "id int, c int, d int, p double")
    rows = {tuple(r) for r in R.families_to_long(df, ["id"], {"count": ["c", "d"], "cover": ["p"]}, "s", fill=0.0).collect()}
    assert rows == {(1, "c", 2.0, None), (1, "d", 0.0, None), (1, "p", None, 7.0)}


def test_histogram_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(4.5,), (4.51,), (5.5,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in histogram(df, [], "x").collect()} == {4: 1, 5: 2}


def test_monthly_mean_drops_empty_months(spark):
    df = spark.createDataFrame([(2015, 1, 2.0), (2015, 1, None), (2015, 2, None), (2020, 1, 9.0)], "y int, m int, h double")
    assert [tuple(r) for r in monthly_mean(df, "y", "m", "h", before_year=2020).collect()] == [(2015, 1, 2.0)]


def test_csv_missing_values_and_headers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿a,b,b\r\n1,NA,x\r\n,2.5,\r\nz,3,NA\r\n", encoding="utf-8")
    schema = _layout("a:i|b:d|c:s")
    rows = [tuple(r) for r in read_csv(spark, str(path), schema).collect()]
    assert rows == [(1, None, "x"), (None, 2.5, None), (None, 3.0, None)]
    out = str(tmp_path / "out")
    write_csv(read_csv(spark, str(path), schema).coalesce(1), out)
    again = read_csv(spark, out, schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, read_csv(spark, str(path), schema).collect()))
    assert dict(read_csv_inferred(spark, out).dtypes)["b"] == "double"


def test_distinct_treats_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert J.distinct_rows(df).count() == 2
    assert J.distinct_values(df, "b").count() == 2
    assert J.drop_incomplete(df).count() == 1
