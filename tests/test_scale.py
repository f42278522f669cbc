"""Percentiles, pools and settled tables where a group is large, skewed or awkward."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.bootstrap import bootstrap_total, number_pool, pool_from_sizes
from tidemark.operators.quantiles import box_summary, exact_percentiles, with_bucket
from tidemark.session import scratch_root, settle


def test_percentiles_of_a_dominant_group(spark):
    rng = np.random.default_rng(0)
    groups = {
        "huge": np.concatenate([rng.normal(1.7e9, 1e3, 4000), np.full(4000, 1.7e9)]),
        "signed": rng.normal(0, 1e-3, 500),
        "tiny": np.array([3.0]),
        "ends": np.array([-1e300, -0.0, 0.0, 1e-310, 1e300]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()
    assert len(got) == 4
    for r in got:
        for p, v in zip(probs, list(r)[1:]):
            assert v == pytest.approx(np.quantile(groups[r["k"]], p), rel=1e-12, abs=1e-300), (r["k"], p)


def test_buckets_never_decrease(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.normal(0, 10.0 ** rng.integers(-300, 300, 4000)), 2.0 ** np.arange(-1070, 1023), -(2.0 ** np.arange(-60, 60)), np.nextafter(2.0 ** np.arange(-60, 60), 0), [math.inf, -math.inf, 0.0]]))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").orderBy("v")
    buckets = [r[0] for r in with_bucket(df, "v").orderBy("v").select("tm_bucket").collect()]
    assert buckets == sorted(buckets)


def test_box_of_constant_group(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.lit(2.0).alias("v"))
    row = box_summary(df, ["k"], "v").first()
    assert (row["q1"], row["q3"], row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (2, 2, 2, 2, 0, 100)


def test_pool_numbers_are_runs(spark):
    sizes = spark.range(5000).select(
        F.when(F.col("id") < 4000, "a").otherwise("b").alias("s"), (F.col("id") % 37).cast("double").alias("size")
    )
    pool = number_pool(pool_from_sizes(sizes, "s", "size"), "s", ["size", "copy"]).collect()
    for s, n in (("a", 4000), ("b", 1000)):
        mine = [r for r in pool if r["s"] == s]
        assert len(mine) == n and {r["pool_n"] for r in mine} == {n}
        assert sorted(r["slot"] for r in mine) == list(range(n))


def test_bootstrap_edges(spark):
    pool = number_pool(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "s string, id int, w double"), "s", ["id"])
    counts = spark.createDataFrame([(1, "a", 3), (2, "a", 0), (3, "a", None), (4, "z", 2), (5, "z", 0)], "id int, s string, n int")
    got = {r["id"]: r["total"] for r in bootstrap_total(counts, pool, ["id"], "s", "n", "w").collect()}
    assert got == {1: 6.0, 2: 0.0, 3: None, 4: None, 5: 0.0}


def test_draws_are_uniform_and_independent(spark):
    pool = number_pool(spark.range(10).select(F.lit("a").alias("s"), F.col("id"), F.pow(F.lit(2.0), F.col("id") * 5).alias("w")), "s", ["id"])
    slots = pool.select("slot", "w").collect()
    rows = spark.range(4000).select("id", F.lit("a").alias("s"), F.lit(5).alias("n"))
    totals = [int(r["total"]) for r in bootstrap_total(rows, pool, ["id"], "s", "n", "w").collect()]
    hits = np.zeros((4000, 10))
    for i, total in enumerate(totals):  # five bits per member hold its number of draws
        hits[i] = [(total >> (5 * k)) & 31 for k in range(10)]
    assert len(slots) == 10 and (hits.sum(axis=1) == 5).all()
    share = hits.sum(axis=0) / hits.sum()
    assert np.abs(share - 0.1).max() < 0.01
    # multinomial variance n p (1 - p) = 0.45
    assert np.allclose(hits.var(axis=0), 0.45, atol=0.05)


def test_large_pool_is_not_broadcast(spark):
    pool = number_pool(spark.range(2000).select(F.lit("a").alias("s"), "id", (F.col("id") + 1.0).alias("w")), "s", ["id"])
    rows = spark.range(50).select("id", F.lit("a").alias("s"), F.lit(4).alias("n"))
    wide = {r["id"]: r["total"] for r in bootstrap_total(rows, pool, ["id"], "s", "n", "w").collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bootstrap_total(rows, pool, ["id"], "s", "n", "w")
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["total"] for r in df.collect()} == wide
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settled_tables_lie_in_the_named_folder(spark):
    df = settle(spark.range(3))
    assert df.count() == 3
    assert scratch_root(spark) in df.inputFiles()[0]


def test_scratch_folder_follows_the_cluster():
    class Session:
        class sparkContext:
            applicationId = "app-1"

        class conf:
            values = {"spark.master": "spark://host"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(ValueError):
        scratch_root(Session)
    Session.conf.values = {"spark.master": "spark://host", "spark.checkpoint.dir": "hdfs://shared/ck/"}
    assert scratch_root(Session) == "hdfs://shared/ck"
    Session.conf.values = {"spark.master": "local[2]"}
    assert scratch_root(Session) == scratch_root(Session) != "hdfs://shared/ck"


def test_one_row_with_most_units(spark):
    pool = number_pool(spark.range(50).select(F.lit("a").alias("s"), "id", (F.col("id") % 5 + 1.0).alias("w")), "s", ["id"])
    counts = spark.createDataFrame([(1, "a", 250_000), (2, "a", 1), (3, "a", 0)], "id int, s string, n int")
    got = {r["id"]: r["total"] for r in bootstrap_total(counts, pool, ["id"], "s", "n", "w").collect()}
    # mean 3 and variance 2 per draw; five standard deviations of the sum
    assert abs(got[1] - 750_000) < 5 * math.sqrt(2 * 250_000)
    assert 1 <= got[2] <= 5 and got[3] == 0
    few = bootstrap_total(counts, pool, ["id"], "s", "n", "w", block=1000).collect()
    assert {r["id"]: r["total"] for r in few} == got


def test_bootstrap_reads_its_counts_once(spark, tables):
    import __spark_entry__ as E

    plan = E.queries()["bootstrap_total"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_scratch_scope_removes_its_tables(spark, tmp_path):
    from tidemark.session import scratch_scope

    with scratch_scope(spark):
        inner = settle(spark.range(5), "inner")
        folder = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert Path(folder).exists()
        inner.write.parquet(str(tmp_path / "kept"))
    assert not Path(folder).exists() and spark.read.parquet(str(tmp_path / "kept")).count() == 5
