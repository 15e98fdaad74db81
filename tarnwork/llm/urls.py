"""URL filters: rules first, then propagation of trust and distrust over the link graph of hosts.

A rule names a host, which stands for its subdomains too, and the beginning of a path; the longest rule that fits a
url decides. Other urls are judged by their host. Hosts most of whose decided pages are allowed are trusted seeds,
those with mostly blocked ones are blocked seeds. Personalised PageRank spreads trust from the trusted seeds along
links, and distrust from the blocked seeds against them: who links to blocked hosts is distrusted. Scores are relative
to an even share; a host is blocked if its distrust reaches ``threshold`` and exceeds its trust.

Edges come from the absolute links in the pages, one for each pair of hosts with the number of links as its weight,
and from each host to the parent it is a subdomain of, and back, up to the registered domain; their weight is one by
the number of the parent's children. A parent needs no pages of its own: scores reach siblings through it. All tables
are host-level and stay in Spark; scores are written after every few rounds.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; null
html has no links; repeated rows count as further pages; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm._common import ascii_lower, discard, materialize, small, table


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
#: Hosts whose registered domain has three labels, as that of a.b.co.uk; a fixed stand-in for the list of public suffixes.
SECOND_LEVEL = r"\.(?:co|com|net|org|gov|edu|ac)\.[a-z]{2}$"
#: Scores along links and against them.
KINDS = ("trust", "distrust")
#: Edges of one host that a task meets at once, rounds between two writings, and bytes that may be broadcast.
HUB, STRIDE, BROADCAST = 50_000, 8, 32_000_000
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    found = [F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_parents(hosts: DataFrame) -> DataFrame:
    """``host, parent`` for each of ``hosts(host)`` and its parents below their registered domain."""
    named = hosts.where(~F.col("host").rlike(r"(^|\.)\d+(:\d+)?$|\]")).select("host", F.split(F.regexp_replace("host", r":\d+$", ""), r"\.").alias("labels"))
    own = F.when(F.array_join("labels", ".").rlike(SECOND_LEVEL), 3).otherwise(2)
    above = named.where(F.size("labels") > own).select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels") - own)).alias("at"))
    part = lambda at: F.array_join(F.slice("labels", at, F.size("labels")), ".")
    return above.select(F.when(F.col("at") == 1, F.col("host")).otherwise(part(F.col("at"))).alias("host"), part(F.col("at") + 1).alias("parent")).distinct()


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` of the graph, from ``pages(host, html)``."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")).select("src", ascii_lower(F.regexp_replace("dst", r":\d+$", "")).alias("dst"))
    links = links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    parents = host_parents(hosts)
    degrees = parents.groupBy("parent").agg((1.0 / F.count("*")).alias("weight"))
    family = parents.join(degrees, "parent")
    both = family.select(F.col("host").alias("src"), F.col("parent").alias("dst"), "weight").union(family.select("parent", "host", "weight"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _in_pieces(rows: DataFrame, host: str, hubs: DataFrame | None) -> DataFrame:
    """``rows`` once for each piece of their host's edges."""
    if hubs is None:
        return rows.withColumn("piece", F.lit(0))
    return rows.join(hubs.withColumnRenamed("hub", host), host, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")


def _spread_once(scores: DataFrame, moves: DataFrame, seeds: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """What the seeds give and what ``scores`` pass on, by host."""
    sent = _in_pieces(scores.withColumnRenamed("host", "src"), "src", hubs)
    got = sent.join(moves, ["src"] if hubs is None else ["src", "piece"]).select(F.col("dst").alias("host"), *[(F.col(c) * F.col(f"{c}_share")).alias(c) for c in KINDS])
    return got.union(seeds).groupBy("host").agg(*[F.sum(c).alias(c) for c in KINDS])


def spread_scores(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank along ``edges(src, dst, weight)``, and against them.

    ``seeds(host, trust, distrust)`` are weights that sum up to 1, or to 0. A score is what arrives over walks of any
    length, scaled to a sum of 1; so what a host without links out would pass on goes back to the seeds. Rounds end when
    the scores of all hosts together are off by at most ``tolerance``: that is so once ``2 * damping / (1 - damping)``
    times the last growth of the sum is no more, and after ``log(tolerance * (1 - damping) / 2) / log(damping)`` rounds
    in any case. ``rounds`` ends them earlier. Hosts that nothing reaches have no row.

    Both directions are columns of one table, which is written after every ``STRIDE`` rounds. The edges of a host are met
    in pieces of some ``HUB``, so that no task has all those of a hub.
    """
    both = edges.select("src", "dst", F.col("weight").alias("trust_weight"), F.lit(0.0).alias("distrust_weight"))
    both = both.union(edges.select("dst", "src", F.lit(0.0), "weight")).groupBy("src", "dst").agg(F.sum("trust_weight").alias("trust_weight"), F.sum("distrust_weight").alias("distrust_weight"))
    pairs = materialize(both, "rank-pairs")
    pieces = F.ceil(F.count("*") / F.lit(HUB)).cast("int").alias("pieces")
    nodes = materialize(pairs.groupBy("src").agg(*[F.sum(f"{c}_weight").alias(f"{c}_total") for c in KINDS], pieces), "rank-nodes")
    hubs = nodes.where("pieces > 1").select(F.col("src").alias("hub"), "pieces")
    hubs = None if hubs.isEmpty() else small(hubs, 100_000, BROADCAST)
    totals = _in_pieces(nodes.drop("pieces"), "src", hubs)
    if hubs is None:
        placed = pairs.withColumn("piece", F.lit(0))
    else:
        piece = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("pieces")), F.lit(0)).cast("int")
        placed = pairs.join(hubs.withColumnRenamed("hub", "src"), "src", "left").withColumn("piece", piece).drop("pieces")
    share = lambda c: F.coalesce(damping * F.try_divide(f"{c}_weight", f"{c}_total"), F.lit(0.0)).alias(f"{c}_share")
    moves = materialize(placed.join(totals, ["src", "piece"]).select("src", *([] if hubs is None else ["piece"]), "dst", *map(share, KINDS)), "rank-moves")
    seeds = materialize(seeds.select("host", *[F.col(c).cast("double").alias(c) for c in KINDS]), "rank-seeds")
    near = small(moves, 200_000, BROADCAST)
    rest = damping / (1 - damping)
    most = max(1, math.ceil(math.log(tolerance / (2 * rest)) / math.log(damping)))
    most = most if rounds is None else min(most, rounds)
    scores, before, done, written = seeds, 0.0, 0, [pairs, nodes, moves, seeds]
    while done < most:
        step, new = min(STRIDE, most - done), scores
        for _ in range(step):
            new = _spread_once(new, near, seeds, hubs)
        new = materialize(new, "rank-scores")
        written.append(new)
        sums = new.agg(*[F.sum(c).alias(c) for c in KINDS]).first()
        # All terms are positive, so the sum's growth over these rounds is at least that of the last.
        scores, done, grown, before = new, done + step, (sums["trust"] or 0.0) + (sums["distrust"] or 0.0) - before, (sums["trust"] or 0.0) + (sums["distrust"] or 0.0)
        if 2 * rest * grown <= tolerance:
            break
    sums = scores.agg(*[F.sum(c).alias(c) for c in KINDS]).first()
    scaled = materialize(scores.select("host", *[(F.col(c) / F.lit(sums[c] or 1.0)).alias(c) for c in KINDS]), "rank-scaled")
    discard(*written)
    return scaled


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``host, score`` after spreading the weights of ``seeds(host, weight)``, which sum up to 1, along ``edges``; see ``spread_scores``."""
    told = seeds.select("host", F.col("weight").alias("trust"), F.lit(0.0).alias("distrust"))
    return spread_scores(edges, told, damping=damping, rounds=rounds, tolerance=tolerance).where("trust > 0").select("host", F.col("trust").alias("score"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, *, threshold: float = 1.0, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """A row for each row of ``pages(page_id, url, html)``: ``page_id, host, path, rule, verdict, trust, distrust``.

    ``trust`` and ``distrust`` are the host's scores times the number of hosts, off by at most ``tolerance`` and rounded to
    nine places, so that the order of sums decides nothing. Nulls and ties are those of the module.
    """
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    told = told.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.count_if(F.coalesce(F.col("found.verdict"), F.lit("")) == verdict)
    hosts = materialize(told.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")), "url-hosts")
    edges = materialize(host_edges(told), "url-edges")
    seeds = hosts.select("host", F.when(F.col("allowed") > F.col("blocked"), F.col("allowed")).otherwise(0).alias("trust"), F.when(F.col("blocked") > F.col("allowed"), F.col("blocked")).otherwise(0).alias("distrust"))
    totals = seeds.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in KINDS]).first()
    n = totals["n"]
    seeds = seeds.where("trust > 0 OR distrust > 0").select("host", *[(F.col(c) / F.lit(totals[c] or 1)).alias(c) for c in KINDS])
    spread = spread_scores(edges, seeds, damping=damping, rounds=rounds, tolerance=tolerance / max(n, 1))
    scored = hosts.select("host").join(spread, "host", "left")
    scored = materialize(scored.select("host", *[F.round(F.coalesce(F.col(c), F.lit(0.0)) * n, 9).alias(c) for c in KINDS]), "url-scores")
    discard(hosts, edges, spread)
    judged = told.drop("html").join(small(scored, 1_000_000, BROADCAST), "host", "left")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), *KINDS)


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the rules, else by its host's trust and distrust."""
    return judge_urls(table(spark, sf_dir, "pages"))
