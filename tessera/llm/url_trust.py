"""URL filter: rules first, then trust and distrust spread over the host graph.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path goes on to ``?``, ``#`` or the end. A rule
(``host/path``) fits its host and all subdomains if the url's path starts with
the rule's; the longest rule that fits decides.

Other pages are judged by their host. Links to other hosts in the pages' html
are counted per (host, host). Trust is personalised PageRank: a host's seed is
the share of its pages that rules allow, and trust flows along links in
proportion to their counts. Distrust flows against the links from seeds that are
the share of pages that rules block: a host takes on the distrust of each host
that it links to by the share of its own links that go there. How many others
link to a blocked host doesn't matter. Reach is PageRank from all hosts that have pages:
trust divided by it is the part of a host's PageRank that comes from allowed pages, from
0 to 1 however many link to the host. All three spread until no score moves by
``tolerance`` or more. A host is blocked if its distrust, less ``TRUST_WEIGHT`` times
that part, reaches ``threshold``. Neither side grows with the number of links, so
hosts are judged the same on tables of every size; trust decides about hosts
whose links are mixed or that are some links away, and never clears one all of whose links
go to wholly blocked hosts (0.1275 - 0.05 is over the threshold).

Links are counted by partial aggregates before any shuffle by host; each round
is a join and an aggregate over host rows, written to the shared folder.

Nulls: a null url, or one without ``://``, has empty host and path, no rule and
the verdict of the empty host, which is never a seed and never linked: allow. A
null html has no links. Repeated rows are judged each and counted each. Very long
html is searched whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: ``spread`` goes on until scores move by less than ``TOLERANCE``; its SQL sums ``ROUNDS`` steps, after which less is left.
DAMPING, ROUNDS, THRESHOLD = 0.85, 85, 0.075
#: What full trust takes off a host's distrust.
TRUST_WEIGHT = 0.05
TOLERANCE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:^|[^\w-])href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, null if none does."""
    out = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, under = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + under)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    allowed = [r for v, r in rules if v == "allow"]
    return F.when(rule.isNull(), F.lit(None)).when(rule.isin(allowed), "allow").otherwise("block")


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, links) between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("to"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    return found.select("src", dst.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): ``seeds`` (kind, host, seed) spread along (trust, reach) and against (distrust) the links.

    All weigh a link by its share of the linking host's links. Changes shrink by ``damping`` a round, so this ends.
    A round's table goes when the next one is written.
    """
    parts = links.join(links.groupBy("src").agg(F.sum("links").alias("of")), "src").withColumn("part", F.col("links") / F.col("of"))
    forth = parts.select(F.explode(F.array(F.lit("trust"), F.lit("reach"))).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), "part")
    back = parts.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"), "part")
    edges = cut(forth.union(back), "host-edges")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), F.lit(0.0).alias("before"))
    state, moved, written = base, 0.0 if edges.isEmpty() else tolerance, None
    while moved >= tolerance:
        flow = state.join(edges, ["kind", "host"]).select("kind", F.col("next").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"), F.lit(0.0).alias("before"))
        last = state.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        state = cut(base.union(flow).union(last).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "host-scores")
        if written is not None:
            discard(written)
        written = state
        moved = state.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0
    discard(edges)
    return state.drop("before")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    url = F.col(url_col)
    placed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    placed = placed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("ruled", rule_verdict(F.col("rule"), rules))
    share = lambda v: F.count_if(F.coalesce(F.col("ruled") == v, F.lit(False))) / F.count("*")
    hosts = placed.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = cut(hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust", F.lit("reach"), F.lit(1.0))).alias("kind", "seed")).filter("seed > 0"), "host-seeds")
    links = cut(host_links(pages, url_col, html_col), "host-links")
    scores = spread(seeds, links, damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    by_host = scores.groupBy("host").agg(of("distrust").alias("distrust"), of("trust").alias("trust"), of("reach").alias("reach"))
    part = F.when(F.col("reach") > 0, F.col("trust") / F.col("reach")).otherwise(0.0)
    blocked = by_host.filter(F.col("distrust") - TRUST_WEIGHT * part >= threshold).select("host", F.lit("block").alias("by_host"))
    return placed.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
