"""Delimited files whose fields are no values of their type."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tidemark.operators.quality import code_lists
from tidemark.plans.surveys import bio_responses, native_responses, survey_report, unreadable_report
from tidemark.sources import schemas as S
from tidemark.sources.tables import UNREADABLE, read_csv_checked, unreadable_fields

LAYOUT = T.StructType(
    [T.StructField(c, k) for c, k in {"id": T.IntegerType(), "on day": T.DateType(), "x.y": T.DoubleType(), "note": T.StringType()}.items()]
)


def write(folder, *lines):
    path = folder / "table.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def faults(row):
    return [(f["field"], f["value"]) for f in row[UNREADABLE]]


def test_faults_of_each_kind(spark, tmp_path):
    path = write(
        tmp_path, "a,b,b,d", "1,2006-01-02,2.5,fine", "2x,2006-01-02,1d,odd", "3,02.01.2006,NaN,", "4,NA,,NA", "5,2006-02-30,Infinity,q",
        "6,2006-01-02", "7,2006-01-02,1.0,more,fields", "12.5,2006-01-02,1e3,half",
    )
    rows = read_csv_checked(spark, path, LAYOUT).collect()
    assert (rows[0]["id"], rows[0]["on day"], rows[0]["x.y"], rows[0]["note"]) == (1, dt.date(2006, 1, 2), 2.5, "fine") and not faults(rows[0])
    assert faults(rows[1]) == [("id", "2x"), ("x.y", "1d")] and rows[1]["id"] is None and rows[1]["note"] == "odd"
    assert faults(rows[2]) == [("on day", "02.01.2006"), ("x.y", "NaN")]
    assert tuple(rows[3])[:4] == (4, None, None, None) and not faults(rows[3])
    assert faults(rows[4]) == [("on day", "2006-02-30"), ("x.y", "Infinity")]
    assert faults(rows[5]) == [("record", "6,2006-01-02")] and rows[5]["id"] == 6
    assert faults(rows[6]) == [("record", "7,2006-01-02,1.0,more,fields")]
    assert faults(rows[7]) == [("id", "12.5")] and rows[7]["x.y"] == 1000.0


def test_faults_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    df = read_csv_checked(spark, write(tmp_path, "a,b,c,d", "1x,2006-01-02,2,n", "2"), LAYOUT)
    assert [faults(r) for r in df.select(UNREADABLE).collect()] == [[("id", "1x")], [("record", "2")]]
    assert [r["id"] for r in df.select("id").collect()] == [None, 2]
    assert [(r["note"], r["field"], r["value"]) for r in unreadable_fields(df, ["note"]).collect()] == [("n", "id", "1x"), (None, "record", "2")]


def test_empty_file_and_taken_name(spark, tmp_path):
    df = read_csv_checked(spark, write(tmp_path, "a,b,c,d"), LAYOUT)
    assert df.count() == 0 and unreadable_fields(df, ["id"]).count() == 0
    with pytest.raises(ValueError):
        read_csv_checked(spark, "nowhere", T.StructType([T.StructField(UNREADABLE, T.StringType())]))


@pytest.fixture
def surveys(spark, tmp_path):
    def read(name, schema, *lines):
        (tmp_path / name).mkdir()
        return read_csv_checked(spark, write(tmp_path / name, ",".join(schema.names), *lines), schema)

    adults = ",".join(f"m{k},{'?' if k == 1 else 11}" for k in range(10))
    return [
        read("native", S.NATIVE_COMMUNITY, "2006-01-01,A,no,con,1,12x,,2,5,1,,,,,10,ca. 3,0,20,30,", "2006-01-15,A,no,con,1,4"),
        read("community", S.INVADED_COMMUNITY, "con,no,7,2006-01-09,4,1,,5,,0,2,3,6,"),
        read("adults", S.ADULT_LIMPETS, f"no,con,7,{adults}"),
        read("start", S.INVADED_START, "no,con,nine,12,25,7"),
    ]


def test_unreadable_measures_are_not_filled(surveys):
    rows = {(str(r["date"]), r["species"]): r for r in native_responses(surveys[0]).collect()}
    assert rows["2006-01-01", "Balanus_recruits"]["count"] is None  # 12x
    assert rows["2006-01-01", "Chthamalus_recruits"]["count"] == 0  # missing
    assert rows["2006-01-01", "Pyropia"]["percent_cover"] is None and rows["2006-01-01", "Ulva"]["percent_cover"] == 10
    assert rows["2006-01-15", "Balanus_recruits"]["count"] == 4  # a short record: what is there counts, the rest is unknown
    assert rows["2006-01-15", "Lottia"]["count"] is None
    limpets = bio_responses(*surveys).where("species = 'Siphonaria' and count is null").collect()
    assert sorted(str(r["date"]) for r in limpets) == ["2005-12-12", "2006-05-12"]


def test_report_names_them(spark, surveys):
    codes = code_lists(spark.createDataFrame([("herbivores", "con", "")], S.FACTOR_CODES))
    report = survey_report(bio_responses(*surveys), codes, "2007-12-31", unreadable_report(*surveys))
    got = {(r["location"], r["plot"], str(r["date"]), r["species"], r["value"]) for r in report.where("rule = 'unreadable'").collect()}
    assert got == {
        ("BP", 1, "2006-01-01", "Balanus_recruits", "12x"),
        ("BP", 1, "2006-01-01", "Pyropia", "ca. 3"),
        ("BP", 1, "2006-01-15", None, "2006-01-15,A,no,con,1,4"),
        ("PA", 7, "2006-05-12", "Siphonaria", "?"),
        ("PA", 7, "2005-12-12", "Siphonaria", "nine"),
    }
    assert unreadable_report(*[df.drop(UNREADABLE) for df in surveys]).count() == 0
