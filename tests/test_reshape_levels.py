import pytest

from tidemark.operators import reshape as R

ROWS = [("p", "a", 1.0), ("p", "b", 2.0), ("q", "c", 3.0), ("q", None, 4.0), ("q", "c", 5.0)]


def test_levels_that_the_code_does_not_name(spark):
    df = spark.createDataFrame(ROWS, "k string, name string, v double")
    wide = R.to_wide(df, ["k"], "name", None, "v", "sum")
    assert wide.columns == ["k", "NA", "a", "b", "c"]
    assert sorted(map(tuple, wide.collect())) == [("p", None, 1.0, 2.0, None), ("q", 4.0, None, None, 8.0)]
    assert R.to_wide(df.limit(0), ["k"], "name", None, "v").count() == 0


def test_names_without_a_bound(spark):
    df = spark.createDataFrame(ROWS, "k string, name string, v double")
    cells = {r["k"]: r["values"] for r in R.to_wide_map(df, ["k"], "name", "v", "sum").collect()}
    assert cells == {"p": {"a": 1.0, "b": 2.0}, "q": {"NA": 4.0, "c": 8.0}}
    many = spark.range(R.MOST_COLUMNS + 1).selectExpr("1 AS k", "id AS name", "id AS v")
    with pytest.raises(ValueError, match="to_wide_map"):
        R.to_wide(many, ["k"], "name", None, "v")
    assert len(R.to_wide_map(many, ["k"], "name", "v").first()["values"]) == R.MOST_COLUMNS + 1
