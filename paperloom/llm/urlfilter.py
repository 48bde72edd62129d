"""URL filters: host rules, and trust and distrust propagated over the host graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster

DAMPING = 0.85
#: Share of all score that may still move when propagation ends: damping ** steps of it at most.
TOLERANCE = 1e-3
#: Edges that one task moves score over in a step, about.
TASK_EDGES = 500_000
#: A host is blocked where its distrust is over this share of its trust and distrust together.
BLOCK_SHARE = 0.75


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.  Rules are (verdict, host and path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def parents_of(host: Column) -> Column:
    """A host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(
        n >= 3, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    ).otherwise(F.array(host))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): absolute links of pages between different hosts, and each host with its parent domain both ways.

    A link with a scheme, or with the page's own (``//host/``), counts once for
    a page and target host.  Sibling hosts vouch for each other through their
    parent domain, which joins sites without links.  Null urls and html give
    no edge, repeated pages count each.
    """
    found = pages.select(F.monotonically_increasing_id().alias("row"), host_of(F.col(url_col)).alias("src"), F.col(html_col).alias("html"))
    links = (
        found.where("src <> ''")
        .select("row", "src", F.explode(F.expr(r"""regexp_extract_all(html, '(?i)href\\s*=\\s*["\']?((?:[a-z][a-z0-9+.-]*:)?//[^"\'\\s>]+)', 1)""")).alias("to"))
        .select("row", "src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("dst"))
        .where("dst <> '' and dst <> src")
        .distinct()
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = found.where("src <> ''").select("src").union(links.select("dst")).distinct()
    chain = hosts.select(parents_of(F.col("src")).alias("c")).where("size(c) > 1")
    up = chain.select(F.explode(F.expr("arrays_zip(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1))")).alias("e")).select(
        F.col("e.0").alias("src"), F.col("e.1").alias("dst")
    ).distinct()
    tree = up.union(up.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return links.union(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def steps_for(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Steps after which no more than ``tolerance`` of the score can still move."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) by two personalised PageRanks.

    seeds is (host, trusted, blocked) with weights of 0 or more.  Trust flows
    along edges from trusted seeds, distrust against them from blocked ones; a
    host shares its score over its edges by weight, and what a host without
    edges holds is lost.  Both ranks move in one join a step, until less than
    ``tolerance`` of each can move.
    """
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    both = cluster.checkpoint(both.join(out, ["kind", "src"]).select(F.col("kind").alias("e_kind"), "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    # A step of a small graph is a few tasks, whatever the session's number of partitions.
    tasks = max(8, -(-both.count() // TASK_EDGES))
    both = cluster.checkpoint(both.coalesce(tasks))
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("trusted").alias("seed")).union(
        seeds.select(F.lit(1).alias("kind"), "host", F.col("blocked").alias("seed"))
    )
    total = start.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = cluster.checkpoint(
        start.join(F.broadcast(total), "kind").where("seed > 0").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")).coalesce(tasks)
    )  # a total for each kind
    rank = start.withColumnRenamed("seed", "rank")
    for step in range(steps_for(damping, tolerance)):
        moved = (
            rank.join(both, (F.col("host") == F.col("src")) & (F.col("kind") == F.col("e_kind")))
            .select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            .union(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank")))
        )
        rank = moved.groupBy("kind", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
        if step % 4 == 3:
            rank = cluster.checkpoint(rank)
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("rank")).otherwise(0.0)).alias("distrust"),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    block_share: float = BLOCK_SHARE,
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """The input columns and host, path, rule, verdict.

    A rule decides where one fits: it fits its host and all subdomains if the
    path starts with its own, and the longest wins.  Elsewhere the host
    decides: hosts are seeds of trust and distrust by their shares of pages
    that rules allow and block, scores are propagated, and a host is blocked
    when its distrust is over ``block_share`` of both; a host that no score
    reaches is allowed.  Null urls, and urls without ``://``, have empty host
    and path and are allowed.  Repeated pages are judged alike.  Input columns
    of the added names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumns(
        {"rule": rule, "_pl_verdict": verdict}
    )
    seeds = (
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            F.avg(F.col("_pl_verdict").eqNullSafe("allow").cast("double")).alias("trusted"),
            F.avg(F.col("_pl_verdict").eqNullSafe("block").cast("double")).alias("blocked"),
        )
        .where("trusted > 0 or blocked > 0")
    )
    ranks = propagate(host_edges(pages, url_col, html_col), seeds)
    blocked = ranks.where(F.col("distrust") > block_share * (F.col("trust") + F.col("distrust"))).select(
        F.col("host").alias("_pl_host")
    )
    return (
        judged.join(blocked, F.col("host") == F.col("_pl_host"), "left")
        .withColumn("verdict", F.coalesce("_pl_verdict", F.when(F.col("_pl_host").isNotNull(), "block").otherwise("allow")))
        .drop("_pl_verdict", "_pl_host")
    )
