"""URL filter: rules by host and path, and trust and distrust spread over the host graph."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.tables import BROADCAST_ROWS, settle, small

# (verdict, host, path): a rule fits its host and all subdomains, if the path of the url starts with its path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Rounds of the propagation in one job.
ROUNDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An href of a link to another host, quoted or not.
LINK = r"""(?i)\bhref\s{0,9}=\s{0,9}["']?\s{0,9}(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the
    path from there to ``?``, ``#`` or the end. Both are empty if the url is null or holds no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: the number of links from pages of one host to another host. Links within a host are none."""
    host = split_url(pages[url])[0]
    # The outer form, as for the plain one Spark would test the size of the array before, by making it once more.
    links = pages.select(host.alias("src"), F.explode_outer(F.array_distinct(F.regexp_extract_all(
        F.coalesce(pages[html].cast("string"), F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(spark: SparkSession, edges: DataFrame, seeds: DataFrame, damping: float = 0.85,
              tolerance: float = 1e-8, together: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: host, score, summing to 1.

    ``seeds`` (host, mass) sum to 1. A surfer follows a link with probability ``damping``, by link weight, and else starts
    anew at a seed; at a host without links they start anew, too. Those restarts only scale the scores, so the rounds move
    what is new alone: every round hands on ``damping`` of the mass that arrived in the round before, all arrivals are added
    up, and the sums are divided by their total at the end. What is under way shrinks by ``damping`` a round or faster,
    whatever the graph, and the rounds end when it is less than ``tolerance`` of the seeds' mass (some 115 rounds at most)
    and no host has been reached for the first time lately; only a host farther than that from all seeds makes more.

    ``together`` rounds are one job, whose result is written. The mass under way is one short row per linked host: counted
    to be few, it is replicated and the edges stay where they are; else both are exchanged by host.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    shares = settle(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "shares")
    few = shares.select("dst").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    moving = settle(seeds.select("host", ((1 - damping) * F.col("mass")).alias("score")), "scores")
    scores, zero = moving, F.lit(0.0)
    while True:
        known = scores.select("host", "score", zero.alias("moving"), F.lit(False).alias("new"))
        for n in range(1, together + 1):
            there = F.broadcast(moving) if few and n > 1 else small(moving) if n == 1 else moving
            moving = shares.join(there, shares.src == there.host).groupBy(F.col("dst").alias("host")).agg(
                F.sum(damping * F.col("score") * F.col("share")).alias("score"))
            known = known.unionByName(moving.select("host", "score", (F.col("score") if n == together else zero).alias("moving"),
                                                    F.lit(True).alias("new")))
        step = settle(known.groupBy("host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"),
                                                F.bool_and("new").alias("new")), "scores")
        total, left, reached = step.agg(F.sum("score"), F.sum("moving"), F.bool_or(F.col("new") & (F.col("score") > 0))).first()
        scores, moving = step.select("host", "score"), step.where("moving > 0").select("host", F.col("moving").alias("score"))
        if not total or left < tolerance * (1 - damping) and not reached:
            return scores.withColumn("score", F.col("score") / F.lit(total or 1.0))


def host_scores(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, url: str = "url",
                html: str = "html", page_id: str = "page_id") -> DataFrame:
    """host, trust, distrust, spam_share, verdict of each host that trust or distrust reaches.

    Trust starts at hosts with allowed pages, by their number, and follows links; distrust starts at hosts with blocked
    pages and follows links backwards, from the linked host to those that link to it. A host is blocked if distrust is
    at least ``threshold`` of the two together.
    """
    spark = pages.sparkSession
    host, path = split_url(pages[url])
    ruled = pages.select(host.alias("host"), matched_rule(host, path, rules)["verdict"].alias("verdict"))
    seeds = settle(ruled.where("verdict is not null").groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n")), "seeds")
    edges = settle(host_edges(pages, url, html), "edges")

    def spread(verdict, links):
        chosen = seeds.where(F.col("verdict") == verdict)
        total = chosen.agg(F.sum("n")).first()[0] or 1
        return propagate(spark, links, chosen.select("host", (F.col("n") / F.lit(total)).alias("mass")), damping)

    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = spread("allow", edges).withColumnRenamed("score", "trust")
    distrust = spread("block", backward).withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    return both.withColumn("spam_share", F.coalesce(share, F.lit(0.0))).withColumn(
        "verdict", F.when(F.col("spam_share") >= threshold, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, page_id: str = "page_id",
               url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides; pages without one get the verdict of their host from ``host_scores``, allow where
    neither trust nor distrust reaches. A null url, one without ``://`` and one with an empty host have empty parts and
    no rule, and are allowed. Null html holds no links. Repeated rows are judged each; an empty table gives no rows.
    Only page_id, url and html are read; html only for the edges, so the join with the hosts moves urls alone.
    """
    scores = host_scores(pages, rules, threshold, damping, url, html, page_id)
    host, path = split_url(pages[url])
    rows = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    # All rows of a host meet one row of the scores; adaptive execution may split the pages of a hot host.
    joined = rows.join(scores.withColumnRenamed("verdict", "_host"), "host", "left")
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", "_host", F.lit("allow")).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"),
                         F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
