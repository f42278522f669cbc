import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import url_filter as U
from tidemark.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def verdicts(spark, rows, rules=URL_RULES):
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("host", "path", "rule", "page", "rules")})
    found = U.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}


def test_rules(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/en/12#t", "http://notexample.org/es/", "x://b.com/fr/", "http://com/de/", "http://net/a", None, "no host", "http://org", "http://x.com/de", "a://b.org/x://c.com/de/", "http://x.com?/de/"]
    found = verdicts(spark, [(k, u, None) for k, u in enumerate(urls)])
    assert [found[k] for k in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("b.com", "/fr/", "com/fr/", "allow"),
        ("com", "/de/", "com/de/", "block"),
        ("net", "/a", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("org", "", None, "allow"),
        ("x.com", "/de", None, "allow"),
        ("b.org", "/x://c.com/de/", "org/", "allow"),
        ("x.com", "", None, "allow"),
    ]
    assert verdicts(spark, []) == {}


def test_trust_and_distrust_spread(spark):
    rules = [("good.org", "/", "allow"), ("bad.com", "/", "block")]
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">x</a><a href="/own">o</a>' for h in hosts)
    rows = [(1, "http://good.org/", link("near.net", "far.net")), (2, "http://bad.com/", link("good.org")), (3, "http://farm.net/", link("bad.com", "bad.com")), (4, "http://near.net/", None), (5, "http://farm.net/p", "<a href=//BAD.com>"), (6, "http://outer.net/", link("farm.net")), (7, "http://alone.net/", "")]
    found = verdicts(spark, rows, rules)
    assert {k: v[3] for k, v in found.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow"}


def test_rank_against_power_iteration(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((8, 8)) < 0.3) * rng.integers(1, 5, (8, 8))
    np.fill_diagonal(a, 0)
    a[2] = 0  # no links
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i in range(8) for j in range(8) if a[i, j]], "source string, target string, links long")
    seed = np.array([3, 1, 0, 0, 0, 0, 0, 0]) / 4
    found = {r["host"]: r["rank"] for r in U.personalised_rank(edges, spark.createDataFrame([("h0", 3), ("h1", 1), ("h5", 0)], "host string, mass long")).collect()}
    p = seed.copy()
    out = np.maximum(a.sum(axis=1, keepdims=True), 1)
    for _ in range(300):
        moved = p @ (a / out)
        p = U.DAMPING * moved + seed * (1 - U.DAMPING * moved.sum())
    assert np.allclose([found.get(f"h{k}", 0) for k in range(8)], p, atol=1e-7)
