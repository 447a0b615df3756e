"""URL rules, and for urls without a rule the propagation of trust and distrust over the links between hosts.

Hosts are nodes. Edges are the links in pages to other hosts and, with weight 1 each way, those between a host and its
parent domain (of two labels or more). Personalised PageRank spreads trust from hosts of pages that an allow rule fits, and
along reversed edges distrust from hosts of blocked ones, both by numbers of pages. A host whose distrust is `ratio`
times its trust or more, and above an even share (one over the number of hosts), is blocked. Null urls and urls without :// have empty hosts and
paths; those hosts take no part and are allowed. Repeated rows count as pages of their own. Extra columns pass through; a
column of the input that has the name of a computed one is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release, scratch, settle, table

#: (verdict, host/path): fits the host and its subdomains where the url's path starts with the rule's (fixed values).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
ROUNDS = 9
#: Share of all trust (and of all distrust) that may be unsettled when verdicts are read.
TOLERANCE = 1e-9
RATIO = 4.0
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """src, dst and w: links between hosts, and those between a host and its parent domains."""
    linked = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    links = linked.where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.select(F.col(host).alias("h")).distinct().where("h != ''").union(links.select("dst")).distinct()
    labels = F.split("h", "\\.")
    domains = hosts.withColumn("l", labels).where(F.size("l") > 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(F.array_join(F.slice("l", i, F.size("l")), ".").alias("a"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("b")))).alias("e")).select("e.*").distinct()
    one = F.lit(1.0)
    both = domains.select(F.col("a").alias("src"), F.col("b").alias("dst"), one.alias("w")).union(domains.select("b", "a", one))
    return links.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE, ratio: float | None = None) -> DataFrame:
    """host, trust and distrust after so many rounds, or (None) when what is still on its way is below the tolerance or,
    if a ratio is given, can't change bad() of any host; then also bad. Every host of edges and seeds has a row.

    seeds: host, trust, distrust (numbers of pages)."""

    def shares(kind: str, src: str, dst: str) -> DataFrame:
        e = edges.select(F.lit(kind).alias("kind"), F.col(src).alias("host"), F.col(dst).alias("to"), "w")
        return e.join(e.groupBy("kind", "host").agg(F.sum("w").alias("all")), ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("all")).alias("p"))

    spark = edges.sparkSession
    moves = shares("trust", "src", "dst").union(shares("distrust", "dst", "src"))
    long = reduce(DataFrame.union, [seeds.select(F.lit(k).alias("kind"), "host", F.col(k).cast("double").alias("x")) for k in ("trust", "distrust")]).where("x > 0")
    total = {r.kind: r.x for r in long.groupBy("kind").agg(F.sum("x").alias("x")).collect()}  # two rows
    start = materialize(long.withColumn("x", F.col("x") / F.when(F.col("kind") == "trust", float(total.get("trust", 1))).otherwise(float(total.get("distrust", 1)))))
    # x: what has settled; d: what is still on its way, 1 - damping of which settles in a round, where it is (p is null)
    moves = materialize(moves)
    hosts = materialize(edges.select("src").union(edges.select("dst")).union(seeds.select("host")).toDF("host").distinct())
    even = 1.0 / max(1, hosts.count())
    stay = hosts.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "host")
    moves = materialize(moves.union(stay.select("kind", "host", "host", F.lit(None).cast("double"))))
    state, i = start.select("kind", "host", F.lit(0.0).alias("x"), F.col("x").alias("d")), 0

    def by_host(x: Column) -> DataFrame:
        value = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, x)), F.lit(0.0)).alias(k)
        return hosts.join(state, "host", "left").groupBy("host").agg(value("trust"), value("distrust"))

    while rounds is None or i < rounds:
        x = F.when(F.col("p").isNull(), F.col("x") + (1 - damping) * F.col("d")).otherwise(0.0)
        d = F.when(F.col("p").isNull(), 0.0).otherwise(damping * F.col("d") * F.col("p"))
        state = state.join(moves, ["kind", "host"]).select("kind", F.col("to").alias("host"), x.alias("x"), d.alias("d")).groupBy("kind", "host").agg(F.sum("x").alias("x"), F.sum("d").alias("d"))
        i += 1
        if i % 6 == 0:
            last = scratch()[-1:] if i > 6 else []
            state = materialize(state)
            release(spark, last)
            if rounds is None:
                left = {r.kind: r.d for r in state.groupBy("kind").agg(F.sum("d").alias("d")).collect()}  # two rows
                t, d = left.get("trust", 0.0), left.get("distrust", 0.0)
                if max(t, d) < tolerance:
                    break
                # the values of a host end between what has settled there and that with all that is on its way
                if ratio is not None and not by_host(F.col("x")).where(bad(even, ratio, more_trust=t) != bad(even, ratio, more_distrust=d)).limit(1).count():
                    break
    out = by_host(F.col("x") + F.col("d"))
    return out if ratio is None else out.withColumn("bad", bad(even, ratio))


def bad(even: float, ratio: float, more_trust: float = 0.0, more_distrust: float = 0.0) -> Column:
    distrust = F.col("distrust") + more_distrust
    return (distrust >= ratio * (F.col("trust") + more_trust)) & (distrust > even)


def judge_urls(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple = RULES, ratio: float = RATIO) -> DataFrame:
    """pages with host, path, rule, verdict, and the trust and distrust of the host."""
    host, path = host_and_path(F.col(url))
    named = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"), F.col(html).alias("html")).withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    votes = lambda v: F.count_if(F.col("judged.verdict") == v)
    seeds = named.where("host != ''").groupBy("host").agg(votes("allow").alias("trust"), votes("block").alias("distrust"))
    scores = settle(pages.sparkSession, lambda: propagate(materialize(host_edges(named, "host", "html")), materialize(seeds), rounds=None, ratio=ratio))
    out = named.join(scores, "host", "left")
    verdict = F.coalesce(F.col("judged.verdict"), F.when(F.col("bad") & (F.col("host") != ""), "block").otherwise("allow"))
    added = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("judged.rule"), "verdict": verdict, "trust": F.col("trust"), "distrust": F.col("distrust")}
    return out.select(*[F.col("row")[c].alias(c) for c in pages.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
