import math
from collections import Counter

from pyspark.sql import functions as F
from tidemark.llm import mixing as M


def test_weights_are_met(spark, make):
    rows = [(k, "x" * 100, "big" if k % 4 else "small") for k in range(4000)]
    docs = make(rows)
    even = M.mix_sources(docs).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 5 * math.sqrt(2000) for r in even)
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("none", 9.0)], "source string, weight double")
    found = {r["source"]: r["count"] for r in M.mix_sources(docs, weights.where("source <> 'none'"), amount=8e5).groupBy("source").count().collect()}
    assert abs(found["big"] - 2000) < 250 and abs(found["small"] - 6000) < 400


def test_counts_are_poisson(spark, make):
    docs = make([(k, "y" * 10, "s") for k in range(3000)])
    for rate in (0.7, 40.0):
        counts = Counter(r["doc_id"] for r in M.mix_sources(docs, amount=30000 * rate).select("doc_id").collect())
        values = [counts.get(k, 0) for k in range(3000)]
        mean = sum(values) / 3000
        spread = sum((v - mean) ** 2 for v in values) / 3000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 3000) and abs(spread / rate - 1) < 0.2


def test_tables_end_at_one(spark):
    for rate in (0.01, 1.0, M.STEP):
        table = spark.range(1).select(M.poisson_table(F.lit(rate)).alias("t")).first()["t"]
        assert abs(table[-1] - 1) < 1e-12 and abs(table[0] - math.exp(-rate)) < 1e-15 and table == sorted(table)


def test_draws_do_not_depend_on_partitions_and_odd_rows(make):
    rows = [(k, None if k % 9 == 0 else "z" * (k % 50), None if k % 5 == 0 else f"s{k % 4}") for k in range(300)] + [(None, "t", "s1"), (None, None, None), (7, "q", "s3"), (7, "q", "s3"), (900, "", "empty")]
    docs = make(rows)
    one, two = (sorted(((r["doc_id"], r["source"], r["number"]) for r in M.mix_sources(d, result_cols=("number", "order")).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert one == two and one
    assert {"table", "draws", "copies"} <= set(M.mix_sources(docs).columns)
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_no_python_in_the_plan_and_random_order(make):
    docs = make([(k, "w" * 20, "s") for k in range(2000)])
    mixed = M.mix_sources(docs, result_cols=("number", "order"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    ids = [r["doc_id"] for r in mixed.collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6
