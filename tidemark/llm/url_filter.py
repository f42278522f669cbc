"""URL verdicts from rules and from trust that spreads over links between hosts.

A rule (host, path) fits a host and its subdomains where the path starts with the rule's; the
longest rule decides. Pages without a rule get the verdict of their host: personalised PageRank
spreads trust along links from hosts whose pages are allowed, and distrust against the links from
hosts whose pages are blocked; a host is blocked when distrust makes up most of what reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link to another host, by scheme or from // on. Links without a host stay on their own.
OUTWARD = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
PRECISION = 1e-9
MOST_ROUNDS = 100  # DAMPING ** 100 is below 1e-7
BLOCK_SHARE = 0.8


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (length, rule, path, verdict) of each host and the domains above it.

    ``rules`` has columns host, path and verdict ("allow" or "block").
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("domain"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r")).distinct()
    fits = hosts.where("host <> ''").select("host", F.explode(above).alias("domain")).join(named, "domain")
    return fits.groupBy("host").agg(F.collect_list("r").alias("rules"))


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """(source, target, links) between different hosts, from ``host`` and the links in the page."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(OUTWARD), F.lit(1))
    each = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    lowered = each.select("source", F.translate("target", UPPER, LOWER).alias("target"))
    return lowered.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def personalised_rank(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, rank): PageRank that starts and restarts at the seeds (host, mass); ranks sum to 1.

    Hosts without outgoing links pass their rank to the seeds. Each round is written to the shared
    folder; rounds end when the ranks move by less than PRECISION in all.
    """
    total = seeds.agg(F.sum("mass")).first()[0]
    start = settle(seeds.where("mass > 0").select("host", (F.col("mass") / (total or 1)).alias("seed")), "seeds")
    out = edges.groupBy("source").agg(F.sum("links").alias("all"))
    shares = settle(edges.join(out, "source").select("source", "target", (F.col("links") / F.col("all")).alias("share")), "shares")
    ranks = start.select("host", F.col("seed").alias("rank"))
    for _ in range(MOST_ROUNDS):
        moved = ranks.join(shares, ranks["host"] == shares["source"]).groupBy(F.col("target").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        passed = moved.agg(F.coalesce(F.sum("got"), F.lit(0.0))).first()[0]
        back = 1 - DAMPING + DAMPING * (1 - passed)  # also what hosts without links held
        joined = moved.join(start, "host", "full").join(ranks.withColumnRenamed("rank", "old"), "host", "full")
        value = F.coalesce(F.col("got"), F.lit(0.0)) * DAMPING + F.coalesce(F.col("seed"), F.lit(0.0)) * back
        following = settle(joined.select("host", value.alias("rank"), F.abs(value - F.coalesce("old", F.lit(0.0))).alias("moved")), "ranks")
        change = following.agg(F.coalesce(F.sum("moved"), F.lit(0.0))).first()[0]
        ranks = following.select("host", "rank")
        if change < PRECISION:
            break
    return ranks


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed.
    A host that neither trust nor distrust reaches is allowed; of two equal rules with different
    verdicts, "block" wins. A null page text has no links. Other columns are not read.
    """
    named = pages.select(F.col(id_col).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    hosts = settle(named.groupBy("host").count().select("host"), "hosts")
    known = settle(rules_by_host(hosts, rules), "host-rules")
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    ruled = settle(named.join(known, "host", "left").select("page", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("ruled")), "ruled")

    edges = settle(host_edges(named, "html"), "edges")
    masses = settle(ruled.where("ruled IS NOT NULL").groupBy("host").agg(*[F.sum((F.col("ruled") == v).cast("long")).alias(v) for v in ("allow", "block")]), "masses")
    sums = masses.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    trust = personalised_rank(edges, masses.select("host", F.col("allow").alias("mass"))).select("host", (F.col("rank") * float(sums[0])).alias("trust"))
    backward = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "links")
    distrust = personalised_rank(backward, masses.select("host", F.col("block").alias("mass"))).select("host", (F.col("rank") * float(sums[1])).alias("distrust"))
    reached = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    judged = settle(reached.where(F.col("distrust") > BLOCK_SHARE * (F.col("trust") + F.col("distrust"))).select("host", F.lit(True).alias("bad")), "judged")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return ruled.join(judged, "host", "left").select(F.col("page").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
