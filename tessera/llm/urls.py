"""URL filter: longest-prefix rules first, link-graph propagation for the rest; DataFrame functions only.

Host edges: every absolute or protocol-relative link of a page, from its host to the link's, and
from each host to the domain above it and back (a subdomain stands in for its domain where pages
link only within themselves). Edges are summed per pair of hosts before anything is dealt out, so
a host with a third of all pages is one row from then on. Trust is personalised PageRank along
the edges from hosts by the share of their pages that allow rules fit; distrust runs on the
reversed edges from the share that block rules fit. Rounds go on until no host's rank changes by more
than TOLERANCE of itself in STEP rounds, so that every host that a seed reaches has its rank. A host is blocked if its distrust is at least
RATIO times its trust and above LEAST.

Defined results: null urls, and urls without "://", have an empty host and path; an empty host
fits no rule, has no edge and is allowed. No pages, no rows. Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settled

DAMPING, TOLERANCE, STEP, RATIO, LEAST = 0.85, 1e-3, 6, 1.0, 1e-12
#: Up to so many edges between hosts a round is one task over all of them; beyond, rounds are dealt by host. Results are the same.
SMALL_EDGES = 1 << 20
#: (pattern, verdict): a host without its subdomains, then a path prefix.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end; A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) over hosts, from pages(host, html)."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?(//[^/?#\"'\s>]+)"), F.lit(1))
    out = pages.select("host", F.explode(links).alias("to")).select(F.col("host").alias("src"), ascii_lower(F.substring("to", 3, 1 << 30)).alias("dst"))
    linked = out.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.filter("host <> ''").select("host").distinct()
    names = F.split("host", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.struct(F.array_join(F.slice(names, i, F.size(names)), ".").alias("src"), F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("dst")))
    up = hosts.filter(F.size(names) > 1).select(F.explode(ups).alias("e")).select("e.*").distinct()
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(0.5))
    return linked.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): personalised PageRank of seeds(kind, host, seed), each kind along its own edges.

    edges: (kind, src, dst, share), the shares of a source summing to 1. The seeds of a kind sum to 1,
    and so do its ranks: what reaches a host without edges goes back to the seeds, which is the same as
    scaling the ranks of a walk that ends there.
    """
    whole = seeds.groupBy(F.col("kind").alias("_kind")).agg(F.sum("seed").alias("_sum"))
    seeds = settled(seeds.join(F.broadcast(whole), F.col("kind") == F.col("_kind")).select("kind", "host", (F.col("seed") / F.col("_sum")).alias("seed")))  # two rows
    small = edges.count() <= SMALL_EDGES
    held = lambda df: df.coalesce(1) if small else df  # noqa: E731  one partition needs no exchange
    seeds, edges = held(seeds), held(edges)
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    stays = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    while True:
        before = ranks
        for i in range(STEP):
            at = ranks.select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), "rank")
            sent = at.join(edges, (at["_kind"] == edges["kind"]) & (at["_host"] == edges["src"])).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            ranks = held(sent.union(stays)).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if i % 3 == 2:
                ranks = held(settled(ranks))
        both = before.select("kind", "host", F.col("rank").alias("old")).join(ranks, ["kind", "host"], "full").na.fill(0.0, ["old", "rank"])
        if both.filter(F.abs(F.col("rank") - F.col("old")) > F.greatest("rank", "old") * tolerance).isEmpty():
            whole = ranks.groupBy(F.col("kind").alias("_kind")).agg(F.sum("rank").alias("_sum"))
            return ranks.join(F.broadcast(whole), F.col("kind") == F.col("_kind")).select("kind", "host", (F.col("rank") / F.col("_sum")).alias("rank"))


def _shares(edges: DataFrame) -> DataFrame:
    """Both kinds of edges, "trust" along the links and "distrust" against them, each with its share of its source's weight."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html"))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    judged = seen.select("page_id", "host", "path", hit["rule"].alias("rule"), hit["verdict"].alias("ruled"))
    share = lambda v: (F.count_if(F.col("ruled") == v) / F.count("*"))
    hosts = settled(judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    edges = settled(_shares(host_edges(seen.select("host", "html"))))
    seeds = hosts.unpivot("host", ["trust", "distrust"], "kind", "seed").filter("seed > 0").select("kind", "host", "seed")
    ranks = page_rank(edges, seeds).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("trust", "distrust")))
    rated = hosts.select("host").join(ranks, "host", "left").na.fill(0.0)
    rated = rated.select("host", "trust", "distrust", F.when((F.col("distrust") >= F.col("trust") * ratio) & (F.col("distrust") > LEAST), "block").otherwise("allow").alias("rated"))
    return judged.join(settled(rated), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "rated", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
