"""The driver contract, every query against its SQL on the smallest tables, and plan shapes."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as E  # noqa: E402
from compare import TABLES, same, sort_key  # noqa: E402


@pytest.fixture(scope="module")
def con(tables):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return con


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship(spark, tables):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(E.queries()))
def test_query(name, spark, tables, con):
    df = E.queries()[name](spark, tables)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=sort_key)
    assert rows
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    other = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=sort_key)
    assert len(rows) == len(other)
    for a, b in zip(rows, other):
        assert all(map(same, a, b)), (a, b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_level_queries_do_not_shuffle(spark, tables):
    for name in ("scan", "unpivot_fill", "two_family_union", "quality_codes", "design_matrix", "exclude_keep_null", "weeks_since_start"):
        assert "Exchange hashpartitioning" not in plan(E.queries()[name](spark, tables)), name


def test_scans_read_only_what_they_need(spark, tables):
    text = plan(E.queries()["cell_mean_se"](spark, tables))
    read = text.split("ReadSchema:")[1]
    assert "l_quantity" in read and "l_extendedprice" not in read and "l_partkey" not in read
    filtered = plan(E.queries()["monthly_mean_range"](spark, tables))
    assert "PushedFilters: [IsNotNull(" in filtered


def test_summaries_reduce_before_they_shuffle(spark, tables):
    text = plan(E.queries()["cell_mean_se"](spark, tables))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning")
    assert text.count("Exchange hashpartitioning") == 1
