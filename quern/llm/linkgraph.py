"""URL filters by rules and by trust spread over the host graph.

Rules decide where one fits. Elsewhere a host's verdict comes from two personalised PageRanks on the graph of hosts:
trust spreads along links from hosts with pages that an allow rule fits, distrust against them from hosts with pages
that a block rule fits (who links to a blocked host is suspect). Seeds weigh by their numbers of such pages. Links are the
absolute and scheme-relative addresses in pages' html; a host and the same host behind ``www.`` or ``m.`` also link to each
other. A third rank spreads like trust from all hosts by their pages without a rule, as what is neither good nor bad. A
host is blocked where distrust is over ``THRESHOLD`` of the three together. A host without links keeps its rank.

Each iteration is a join and a sum over host pairs (one row per pair, whatever the number of links); ranks are written
to shared storage every ``WRITTEN`` iterations.

Defined cases: a null url or one without ``://`` has empty host and path and its page is allowed unless a rule fits; an
empty host takes no part in the graph; repeated rows count each and are judged each by itself; a null html has no
links; with no seeds of a kind its rank is 0 everywhere; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, only

ITERATIONS, WRITTEN, DAMPING, THRESHOLD = 20, 5, 0.85, 0.5
MOST_RULES = 1000  # rules become one expression; longer lists are refused
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    rule: str  # host, then a path from its first slash

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address."""
    cut = lambda i: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(cut(1), _UPPER, _LOWER), cut(2)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (block before allow among equals), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.verdict == "block", r.rule)):
        out = F.when(r.fits(host, path), r.rule).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts by number, from ``pages`` (host, html)."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), 1)
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    counts = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    return counts


def _variants(hosts: DataFrame) -> DataFrame:
    """Links both ways between hosts that differ by a leading ``www.`` or ``m.`` alone."""
    bare = hosts.select("host", F.regexp_replace("host", r"^(www|m)\.", "").alias("bare")).where("host <> bare")
    return bare.selectExpr("host as src", "bare as dst", "1.0d as n").unionAll(bare.selectExpr("bare as src", "host as dst", "1.0d as n"))


#: Kinds of rank: the seeds' column, and whether it spreads along links or against them.
KINDS = {"trust": ("allow", True), "distrust": ("block", False), "neutral": ("other", True)}


def ranks(links: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """host, trust, distrust, neutral: personalised PageRanks over ``links`` (src, dst, n) from ``seeds`` (host, allow,
    block, other: one row per host, zeros where it is none)."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    summed = None
    for kind, (_, along) in KINDS.items():
        one = (links.select("src", "dst", "n") if along else back).groupBy("src", "dst").agg(F.sum("n").alias("n"))
        # who has no link of this direction keeps its rank
        one = one.unionAll(seeds.join(one, F.col("host") == F.col("src"), "left_anti").select("host", F.col("host").alias("dst"), F.lit(1.0).alias("n")))
        one = one.select(F.lit(kind).alias("kind"), "src", "dst", "n")
        summed = one if summed is None else summed.unionAll(one)
    out = summed.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = keep(summed.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("w")))
    total = seeds.agg(*[F.sum(c).alias(c) for c, _ in KINDS.values()]).first()
    each = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(c) / F.lit(float(total[c] or 1))).alias("s")) for k, (c, _) in KINDS.items()])
    start = keep(seeds.select("host", F.explode(each).alias("x")).select("x.kind", "host", "x.s").where("s > 0"))
    rank, stale = start.withColumnRenamed("s", "r"), None
    base = start.select("kind", "host", ((1 - DAMPING) * F.col("s")).alias("r"))
    for i in range(iterations):
        moved = edges.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("w") * F.col("r")).alias("r"))
        rank = moved.unionAll(base).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if (i + 1) % WRITTEN == 0 or i + 1 == iterations:
            rank = keep(rank)
            if stale is not None:
                drop(stale)
            stale = rank
    drop(edges, start)
    return rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(k) for k in KINDS])


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, neutral for each row of ``pages`` (page_id, url, html)."""
    pages = only(pages, page_id="long", url="string", html="string")
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(F.col("rule") == r.rule, r.verdict).otherwise(said)
    placed = cut.withColumn("rule", ruled(F.col("host"), F.col("path"), rules)).withColumn("said", said)
    seen = keep(placed.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").cast("double").alias("allow"), F.count_if(F.col("said") == "block").cast("double").alias("block"), F.count_if(F.col("said").isNull()).cast("double").alias("other")))
    links = keep(host_links(cut))
    nodes = keep(seen.unionByName(links.select(F.col("dst").alias("host"), *[F.lit(0.0).alias(c) for c in ("allow", "block", "other")])).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("allow", "block", "other")]))
    found = ranks(links.unionByName(_variants(nodes)), nodes)
    drop(seen, links, nodes)
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + F.col("neutral"))
    verdict = F.coalesce("said", F.when(bad, "block").otherwise("allow"))
    known = placed.select("page_id", "host", "path", "rule", "said").join(found, "host", "left")
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), number("trust"), number("distrust"), number("neutral"))


def filter_pages(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, trust, distrust of the allowed pages alone."""
    return judge(pages, rules).where("verdict = 'allow'").select("page_id", "host", "path", "rule", "trust", "distrust")
