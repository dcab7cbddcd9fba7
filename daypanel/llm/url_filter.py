"""URL filter: rules first, then trust and distrust propagated over the host graph.

A rule has a host and a path; it fits its host and all subdomains when the url's path starts with the rule's,
and the longest fitting rule decides. Every host whose pages a rule allows is a trusted seed, every host with
blocked pages a distrusted one, each in proportion to its number of such pages. Trust is a personalised
PageRank from the trusted seeds along host edges; distrust runs from the blocked seeds against them, for who
links to blocked hosts is suspect. A host is blocked when its share ``trust / (trust + distrust)`` is below the
threshold; hosts that neither reaches are allowed.

Host edges are hyperlinks to other hosts, weighted by the logarithm of their number, and the domain tree, in
which a host and its parent domain vouch for each other. Nobody vouches through a bare suffix: that is every last
label and every domain of ``suffixes``, the caller's table of domains under which strangers register (``co.uk``); no list
is built in. Addresses and hosts with a port or a user name have no parent. Links and pages are added up per host before any
shuffle by host, and the graph has one row per pair of hosts, so a host with most pages is a row like any
other. The iterations work on that graph alone, packed into partitions by its size, and are checkpointed every few rounds. They go on until no new
host is reached and no host's rank changes by more than ``SETTLED`` of itself. Ranks shrink as the corpus grows,
so they are never rounded, only the share is; what a double cannot hold (below 1e-300) flows no further.

A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Null html has no
links. Rows that repeat are judged one by one (and weigh as pages of their own). Empty tables give empty
results. Only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from .components import packed

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
DAMPING = 0.85
ROUNDS = 16
SETTLED = 1e-4
THRESHOLD = 0.5
DOMAIN_WEIGHT = 1.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# An address (its last label is a number), or a host with more than a name.
_UNNAMED = r"(^|\.)(\d+|0x[0-9a-f]*)\.?$|[:@\[\]]"
_LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'>\s]+)"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, rule, verdict)."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def ancestors(host: Column) -> Column:
    """The host and all domains it is part of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domains(host: Column) -> Column:
    """The host and the domains it belongs to; of an address, or a host with a port or user, the host alone."""
    return F.when(host.rlike(_UNNAMED), F.array(host)).otherwise(ancestors(host))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules whose host covers each host, the longest first."""
    covered = hosts.select("host", F.explode(ancestors(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    longest = F.struct((-F.char_length("rule")).alias("order"), "rule", "rule_path", "verdict")
    return covered.groupBy("host").agg(F.array_sort(F.collect_set(longest)).alias("rules"))


def host_edges(pages: DataFrame, suffixes: Iterable[str] = ()) -> DataFrame:
    """(src, dst, weight) between different hosts: hyperlinks of ``pages`` (host, html) and the domain tree."""
    targets = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    links = links.withColumn("dst", _ascii_lower(F.col("dst"))).filter("src != dst and dst != ''")
    links = links.groupBy("src", "dst").agg(F.log1p(F.count(F.lit(1))).alias("weight"))
    known = pages.select("host").union(links.select("dst")).filter("host != ''").distinct()
    # Parents down to the registered domain: a bare suffix such as "com" vouches for nobody.
    line = F.filter(domains(F.col("host")), lambda a: a.contains("."))
    steps = known.select(F.explode(F.arrays_zip(line.alias("a"), F.slice(line, F.lit(2), F.size(line)).alias("b"))).alias("s"))
    steps = steps.select(F.col("s.a").alias("src"), F.col("s.b").alias("dst")).filter("dst is not null").distinct()
    bare = pages.sparkSession.createDataFrame([(s,) for s in suffixes], "dst string")
    steps = steps.join(bare, "dst", "left_anti").select("src", "dst")
    tree = steps.union(steps.select("dst", "src")).withColumn("weight", F.lit(DOMAIN_WEIGHT))
    return links.union(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, settled: float | None = None) -> DataFrame:
    """(host, kind, rank) of personalised PageRank per kind from seeds (host, kind, share).

    After ``rounds`` rounds it goes on, if ``settled`` is given, until the last round reached no new host and
    changed no host's rank by more than this part of it.
    ``trust`` follows the edges, ``distrust`` goes against them. A host with nowhere to go keeps its rank.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(
        edges.select(F.lit("distrust"), "dst", "src", "weight")
    )
    total = flows.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    flows = flows.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("total")).alias("part"))
    stuck = seeds.join(total, ["kind", "host"], "left_anti").select("kind", "host", F.col("host").alias("to"), F.lit(1.0).alias("part"))
    flows = cut(flows.union(stuck))
    size = flows.count()
    flows = packed(flows, size)
    start = seeds.select("kind", F.col("host"), ((1 - DAMPING) * F.col("share")).alias("rank"))
    ranks = seeds.select("kind", "host", F.col("share").alias("rank"))
    turn = 0
    while True:
        turn += 1
        before = ranks
        moved = flows.join(ranks, ["kind", "host"]).select("kind", F.col("to").alias("host"), (DAMPING * F.col("rank") * F.col("part")).alias("rank"))
        # Packed before they are added up: the sums of a graph of one partition need no shuffle.
        ranks = packed(moved.union(start), size).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).filter("rank > 1e-300")
        if turn % 4 == 0:
            if settled is not None and turn >= rounds:
                # The round's start rides along, so that the comparison needs no second pass over the flows.
                both = before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old")).union(ranks.select("kind", "host", "rank", F.lit(0.0)))
                both = packed(cut(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))), size)
                ranks = both.filter("rank > 0").select("kind", "host", "rank")
                if both.filter(F.abs(F.col("rank") - F.col("old")) > settled * F.col("rank")).isEmpty():
                    return ranks
            else:
                ranks = packed(cut(ranks), size)
        if turn == rounds and settled is None:
            return ranks


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, suffixes: Iterable[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust_share) per row of ``pages``; ``suffixes`` part the domains under them."""
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    counted = cut(split.select("host").distinct())
    counted = packed(counted, counted.count())
    by_host = rules_by_host(counted, rule_table(pages.sparkSession, rules))
    ruled = split.join(by_host, "host", "left")
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    ruled = cut(ruled.withColumn("fit", F.get(fitting, F.lit(0))).select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("verdict")))

    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")
    seeds = ruled.filter("verdict is not null").groupBy("host", kind).agg(F.count(F.lit(1)).alias("n"))
    whole = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(seeds.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("share")))
    seeds = packed(seeds, seeds.count())
    edges = cut(host_edges(pages.select(host_of(url).alias("host"), "html"), suffixes))
    edges = packed(edges, edges.count())
    ranks = propagated(edges, seeds, settled=SETTLED)
    trust = F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0))
    distrust = F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0))
    hosts = ranks.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))
    share = F.when(F.col("trust") + F.col("distrust") > 0, F.round(F.col("trust") / (F.col("trust") + F.col("distrust")), 9))  # the order of additions does not decide
    hosts = hosts.select("host", share.alias("trust_share"))
    by_method = F.when(F.col("trust_share") < threshold, "block").otherwise("allow")
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.coalesce("trust_share", F.lit(1.0)).alias("trust_share")
    )
