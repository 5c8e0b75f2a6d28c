"""URL filters: rules first, then trust and distrust over the graph of hosts.

Trust is a personalised PageRank from trusted hosts along links; distrust runs
from blocked hosts against the links, to those that point at them. Both are
iterated over one table of aggregated host edges. All of it is built-in
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, written

# (host and path prefix, verdict); a rule holds for the host and all its subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, ROUNDS, EVERY = 0.85, 20, 5
BLOCK_AT = 0.5  # share of distrust in a host's evidence above which it is blocked
TIE = 1e-9  # shares that differ by less are equal, so that the order of sums decides nothing
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Longest rule that fits, else null; of equal lengths the first in the list."""
    tests = []
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(text)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, relative ones to the own host.

    A host and its parent domains of two labels or more are linked both ways once.
    """
    targets = F.transform(
        F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK)),
        lambda u: F.when(u.contains("://"), host_of(u)).when(u.startswith("//"), host_of(F.concat(F.lit("x:"), u))).otherwise(F.col("host")),
    )
    links = (
        pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("dst <> ''")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels) - 1, F.lit(2))),
        lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), n), "."),
    )
    up = pages.select("host").filter("host <> ''").distinct().select(F.col("host").alias("src"), F.explode(parents).alias("dst")).filter("src <> dst")
    both = up.union(up.select("dst", "src")).select("src", "dst", F.lit(1.0).alias("weight"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) of both walks; kind is trust or distrust.

    ``seeds``: (kind, host, weight). Weights are scaled to one for each kind.
    Weight that leaves a host without edges is lost.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    leaving = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    steps = written(
        both.join(leaving, ["kind", "src"]).select("kind", "src", "dst", (DAMPING * F.col("weight") / F.col("out")).alias("share")),
        folder, "edges",
    )
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = written(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("score")), folder, "seeds")  # two rows
    back = start.select("kind", "host", ((1 - DAMPING) * F.col("score")).alias("score"))
    scores = start
    for turn in range(1, rounds + 1):
        moved = steps.join(scores.select("kind", F.col("host").alias("src"), "score"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score")
        )
        scores = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % EVERY == 0:
            scores = written(scores, folder, f"scores{turn}")
    return scores


def judged(pages: DataFrame, rules=RULES, trusted: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    Hosts that rules allow or block are seeds, by their number of such pages;
    ``trusted`` and ``blocked`` (host, weight) add to them. Without a rule a page
    is blocked if distrust makes up more than BLOCK_AT of its host's evidence, and
    allowed otherwise, as are hosts without evidence and urls that are null or
    have no host. Null html has no links. Repeated pages count as often as they
    come. Other columns are not looked at.
    """
    folder = scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    kinds = dict(rules)
    fits = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", fits.alias("rule"))
    name = {"allow": "trust", "block": "distrust"}
    kind = F.coalesce(*(F.when(F.col("rule") == r, F.lit(name[v])) for r, v in kinds.items()), F.lit(None).cast("string"))
    seeds = ruled.filter("rule is not null").groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    for more, what in ((trusted, "trust"), (blocked, "distrust")):
        if more is not None:
            seeds = seeds.unionByName(more.select(F.lit(what).alias("kind"), "host", F.col("weight").cast("double").alias("weight")))
    seeds = written(seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight")), folder, "given")
    scores = propagate(edges_of(rows), seeds, folder)
    hosts = written(
        scores.groupBy("host").agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
        ),
        folder, "hosts",
    )
    evidence = F.col("trust") + F.col("distrust")
    by_graph = F.when((evidence > 0) & (F.col("distrust") > (BLOCK_AT + TIE) * evidence), F.lit("block")).otherwise(F.lit("allow"))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in kinds.items()), F.lit(None).cast("string"))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_graph).alias("verdict"), "trust", "distrust"
    )
