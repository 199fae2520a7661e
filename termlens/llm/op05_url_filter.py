"""URL filters: host rules, and link-graph propagation for what no rule decides.

Trust is a personalised PageRank from trusted hosts along host edges; distrust is the same from
blocked hosts along the reversed edges.  Edges are the links of the pages between hosts, and links
between a host and its parent domain (not the top-level domain), so hosts of one owner share their
fate.  A host that gathers more distrust than trust, and at least ``FLOOR`` of it, is blocked; all
others are allowed.  Pages are reduced to host edges with counts before any iteration; each
iteration joins edges with scores and sums by host.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, verdict
``allow``; repeated rows and ids are judged one by one; ties between equally long rules go to the
earlier rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import keep, table

DAMPING = 0.85
ROUNDS = 12
FLOOR = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    tests = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.text))
    ]
    return F.coalesce(*tests, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight) from the links of the pages and the domain tree; needs column ``host``."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    targets = F.transform(links, lambda x: F.translate(F.regexp_extract(x, r"//([^/?#]*)", 1), UPPER, LOWER))
    out = pages.select(F.col("host").alias("src"), F.explode_outer(targets).alias("dst")).where("dst IS NOT NULL AND dst <> '' AND src <> '' AND dst <> src")
    out = out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").where("host <> ''").union(out.select("dst")).distinct()
    # every host with its parents down to two labels: a.b.c.d -> b.c.d -> c.d
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain) - 1).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
    tree = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    tree = tree.union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("weight")))
    return out.union(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, score) after ``rounds`` steps of restart at ``seeds`` (host, score; any positive sum).

    Hosts that no walk from a seed reaches have no row.  Weight at hosts without an edge leaves.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    # a transition table of its own, so that both sides of each step's join are shuffled (and a hub's
    # edges can be split there)
    moves = keep(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "moves")
    total = seeds.agg(F.sum("score")).first()[0]
    if not total:
        return seeds.where("false")
    start = seeds.select("host", (F.col("score") / F.lit(total)).alias("score"))
    score = start
    for i in range(rounds):
        sent = moves.join(score, moves["src"] == score["host"]).groupBy("dst").agg((F.sum(F.col("share") * F.col("score")) * damping).alias("score"))
        both = sent.select(F.col("dst").alias("host"), "score").union(start.select("host", F.col("score") * (1 - damping)))
        score = both.groupBy("host").agg(F.sum("score").alias("score"))
        if i % 3 == 2 or i == rounds - 1:  # cut the lineage; files in the shared folder
            score = keep(score, "rank")
    return score


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with columns host, path, rule, verdict, trust, distrust."""
    base = pages.select(F.struct("*").alias("row"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    edges = keep(host_edges(base), "edges")
    votes = base.where("hit IS NOT NULL").groupBy("host").agg(
        F.sum(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("allow"),
        F.sum(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("block"),
    )
    votes = keep(votes, "votes")
    trust = personalised_pagerank(edges, votes.where("allow > 0").select("host", F.col("allow").alias("score")))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_pagerank(reverse, votes.where("block > 0").select("host", F.col("block").alias("score")))
    marks = [trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")), distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust"))]
    hosts = reduce(DataFrame.union, marks).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    rows = base.drop("html").join(keep(hosts, "hosts"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    guess = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= FLOOR), "block").otherwise("allow")
    return rows.select("row", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", guess).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = judge(pages)
    return rows.select("row.page_id", "host", "path", "rule", "verdict", "trust", "distrust")
