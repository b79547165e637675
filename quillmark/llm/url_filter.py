"""URL filters: explicit rules, and link-graph propagation for the rest.

Trust is personalised PageRank over host links, restarted at hosts with pages that a rule allows; distrust runs
against the links from hosts with pages that a rule blocks. Both are restarted in proportion to page counts and
thresholded per host. Only built-in expressions and joins; hosts and links are aggregated before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import discard, materialize, small

DAMPING = 0.85
TOLERANCE, MOST_STEPS = 1e-6, 100  # steps go on while a score changes by more; 0.85^86 is less, so the bound is never what ends them
MOST_DISTRUST = 0.6  # a host with a larger share of distrust is blocked
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #. Else both empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0)) if isinstance(url, str) else F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is tested first
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shares(links: DataFrame, source: str, target: str) -> DataFrame:
    """(host, to, w): what part of a host's score goes to each neighbour, in proportion to its link counts. Made once."""
    out = materialize(links.groupBy(source).agg(F.sum("n").alias("out")))
    w = materialize(links.join(out, source).select(F.col(source).alias("host"), F.col(target).alias("to"), (F.col("n") / F.col("out")).alias("w")))
    discard(out)
    return w


def propagate(seeds: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """(host, score): PageRank restarted at seeds (host, seed), until no score changes by more than TOLERANCE.

    A step is an equi-join of two tables, whose skewed keys (hubs) can be split, and a sum that is combined before its
    shuffle."""
    w, score = shares(links, source, target), materialize(seeds.select("host", F.col("seed").alias("score")))
    for _ in range(MOST_STEPS):
        flow = w.join(score, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("flow"))
        now = seeds.join(flow, "host", "full_outer").select("host", (F.coalesce("seed", F.lit(0.0)) * (1 - DAMPING) + F.coalesce("flow", F.lit(0.0)) * DAMPING).alias("score"))
        now = materialize(now.join(score.withColumnRenamed("score", "before"), "host", "left"))
        change = now.agg(F.max(F.abs(F.col("score") - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0
        discard(score)
        score = now.select("host", "score")
        score._quillmark_path = now._quillmark_path
        if change <= TOLERANCE:
            break
    discard(w)
    return score


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust.

    A rule decides alone. Any other page has its host's verdict: block if distrust / (trust + distrust) exceeds
    MOST_DISTRUST, else allow; a host that neither reaches is allowed. Null urls and those without :// have an
    empty host and path. Null html has no links; links of a host to itself don't count. A share of distrust equal to
    MOST_DISTRUST allows; of rules of equal length the last in order of text decides. Repeated rows count as often as they
    occur. Texts of any length are read whole. Every row is returned once with all its columns (those with the
    result's names are replaced); an empty table stays empty.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("verdict", verdict)
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = p.where("host != ''").select("host", F.explode(targets).alias("to")).where("host != to").groupBy("host", "to").agg(F.count("*").alias("n"))
    links = materialize(links.withColumnRenamed("host", "from"))
    ruled = materialize(p.where("verdict is not null").groupBy("host").agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad")))
    n = max(1, ruled.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0)
    good, bad = (ruled.where(f"{c} > 0").select("host", (F.col(c) / F.lit(float(n))).alias("seed")) for c in ("good", "bad"))
    if links.limit(1).count():
        good, bad = propagate(good, links, "from", "to"), propagate(bad, links, "to", "from")
    else:
        good, bad = (s.select("host", (F.col("seed") * (1 - DAMPING)).alias("score")) for s in (good, bad))
    hosts = good.withColumnRenamed("score", "trust").join(bad.withColumnRenamed("score", "distrust"), "host", "full_outer")
    hosts = materialize(hosts.select(F.col("host").alias("_host"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    p = p.drop("trust", "distrust").join(small(hosts, hosts.count()), F.col("host") == F.col("_host"), "left").drop("_host")
    mine = F.when(F.coalesce(F.col("distrust") > MOST_DISTRUST * (F.col("trust") + F.col("distrust")), F.lit(False)), "block").otherwise("allow")
    return p.withColumn("verdict", F.coalesce("verdict", mine)).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
