"""Operator 2: URL filters with trust and distrust along host links (DataFrame functions only)."""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import _dealt, hubs, split_join, top_keys
from ._store import Scratch

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rule) -> tuple:
    """The longest rule first, of equal lengths a blocking one, then by name."""
    return -len(rule[0] + rule[1]), rule[2] != "block", rule[0]


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The first rule by _order() that fits, and its verdict; null without one.

    A rule fits its host and the host's subdomains where the path starts with the rule's path.
    """
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, kind in reversed(sorted(rules, key=_order)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def rules_by_join(placed: DataFrame, rules) -> DataFrame:
    """``placed`` (a written table with host and path) with rule and by_rule, for lists too long for an expression.

    Hosts are joined with rules on the endings of their names, so a page meets only the rules of its own host.
    """
    texts = placed.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps([[r[0], r[1], r[2]] for r in rules])), "array<array<string>>")).alias("r"))
    one = F.struct((-F.length(F.concat(F.col("r")[0], F.col("r")[1]))).alias("least"), (F.col("r")[2] != "block").alias("allows"), F.col("r")[0].alias("of"), F.col("r")[1].alias("start"), F.col("r")[2].alias("kind"))
    by_ending = texts.select(F.col("r")[0].alias("ending"), one.alias("rule")).groupBy("ending").agg(F.collect_list("rule").alias("some"))
    longest = max(len(r[0]) for r in rules)
    tail = F.expr(f"right(host, {longest + 1})")
    dots = F.filter(F.sequence(F.lit(1), F.length(tail)), lambda k: F.substring(tail, k, F.lit(1)) == ".")
    endings = F.array_append(F.transform(dots, lambda k: F.substring(tail, k + 1, F.length(tail))), F.expr(f"if(length(host) <= {longest}, host, null)"))
    hosts = placed.where("host != ''").select("host").distinct().select("host", F.explode(F.array_distinct(endings)).alias("ending"))
    known = split_join(hosts, by_ending, "ending").groupBy("host").agg(F.flatten(F.collect_list("some")).alias("some"))
    best = F.array_min(F.filter("some", lambda r: F.col("path").startswith(r["start"])))
    joined = split_join(placed, known, "host", "left").withColumn("best", best)
    return joined.select(*placed.columns, F.concat("best.of", "best.start").alias("rule"), F.col("best.kind").alias("by_rule"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) over different hosts: the number of ``<a href>`` links from pages of one to the other.

    Relative links stay on their host and, as links of pages without a host, are no part of the graph.
    """
    links = pages.where("host != ''").select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
    met = links.select(F.col("host").alias("src"), host_and_path(full)[0].alias("dst")).where("dst != '' and src != dst")
    return met.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def walk_steps(links: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, to, share)`` of both walks, a node being ``t`` (trust) or ``d`` (distrust) and the host.

    Trust goes from a host to those it links to, split as its links are.  Distrust goes back to those that link to a host,
    split as the parts that these links are of each linker's, so a linker's size doesn't matter.  No step enters a
    host that is ``judged``: what is known of it stands.
    """
    out = links.groupBy("src").agg(F.sum("links").alias("total"))
    shares = scratch.write(split_join(links, out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "shares")
    into = shares.groupBy("dst").agg(F.sum("share").alias("total"))
    back = split_join(shares, into, "dst").select(F.concat(F.lit("d"), "dst").alias("node"), F.col("src").alias("host"), F.lit("d").alias("walk"), (F.col("share") / F.col("total")).alias("share"))
    steps = shares.select(F.concat(F.lit("t"), "src").alias("node"), F.col("dst").alias("host"), F.lit("t").alias("walk"), "share").union(back)
    known = judged.select("host", F.lit(True).alias("known"))
    free = split_join(scratch.write(steps, "all-steps"), known, "host", "left").where("known is null")
    return scratch.write(free.select("node", F.concat("walk", "host").alias("to"), "share"), "steps")


def propagate(links: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """``(host, trust, distrust)`` in [0, 1]: personalised PageRank of trust seeds along links, of distrust seeds against them.

    ``seeds`` has every host once with trust and distrust in [0, 1].  Beside each walk from the seeds the same walk starts
    at every host alike; a host's value is the part of what comes to it over links that started at seeds, so neither
    a host's size nor the number of its fellow linkers wears it down, and each further link does.  A host with
    a seed keeps its seeds.  A walk ends at a host without a way on.  Rounds end when nothing that comes to a host grows by
    ``tolerance`` of itself; a step's part falls by ``damping`` a round, so the bound on rounds below is never short.
    Hosts that send a large share of all steps are dealt out on several tasks.
    """
    judged = seeds.where("trust > 0 or distrust > 0")
    steps = walk_steps(links, judged, scratch)
    total, top = steps.agg(F.count("*"), top_keys("node")).first()
    parts = hubs([top], total)
    start = seeds.select(F.explode(F.array(F.struct(F.concat(F.lit("t"), "host").alias("node"), F.col("trust").alias("seed")), F.struct(F.concat(F.lit("d"), "host").alias("node"), F.col("distrust").alias("seed")))).alias("s")).select("s.node", "s.seed")
    start = scratch.write(start, "start")
    base = 1 - damping
    now = scratch.write(start.select("node", "seed", *[F.lit(0.0).alias(c) for c in ("value", "every", "before")]), "rank-0")
    most = 2 + math.ceil((math.log(1 + start.count()) - math.log(tolerance)) / -math.log(damping)) if total else 0
    none = F.lit(0.0)
    for k in range(1, most + 1):
        send = F.col("share") * damping
        came = _dealt(steps, now, "node", parts).select(F.col("to").alias("node"), none.alias("seed"), ((F.col("value") + F.col("seed") * base) * send).alias("value"), ((F.col("every") + base) * send).alias("every"), none.alias("before"))
        after = came.union(now.select("node", "seed", none, none, "every")).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("seed", "value", "every", "before")])
        now = scratch.write(after, f"rank-{k}")
        scratch.drop(f"rank-{k - 1}")
        grown = now.agg(F.max(F.try_divide(F.col("every") - F.col("before"), F.col("every")))).first()[0]
        if (grown or 0.0) < tolerance:
            break
    part = F.coalesce(F.round(F.try_divide("value", "every"), 9), none)  # equal parts stay equal in any order of adding
    came = lambda walk: F.max(F.when(F.substring("node", 1, 1) == walk, part))
    ranks = now.groupBy(F.expr("substring(node, 2)").alias("host")).agg(came("t").alias("t"), came("d").alias("d"))
    kept = F.expr("trust > 0 or distrust > 0")
    return ranks.join(seeds, "host").select("host", F.when(kept, F.col("trust")).otherwise(F.col("t")).alias("trust"), F.when(kept, F.col("distrust")).otherwise(F.col("d")).alias("distrust"))


def judge_pages(pages: DataFrame, scratch: Scratch, rules=RULES, least_distrust: float = 0.5, in_expression: int = 1000) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A url that a rule fits has the rule's verdict; over ``in_expression`` rules are joined instead of written as an expression.
    A host's seeds are the shares of its pages that rules allow and block; trust and distrust are the walks' values of
    propagate().  A page without a rule is blocked where its host's distrust is at least ``least_distrust`` and above
    its trust, else allowed.  A null url or one without ``://`` has an empty host and path, null trust and distrust, no part
    in the graph, and is allowed; a null html has no links; repeated rows each get a row.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    links = scratch.write(host_links(placed), "links")
    if len(rules) > in_expression:
        ruled = rules_by_join(scratch.write(placed.drop("html"), "placed"), rules)
    else:
        rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
        ruled = placed.drop("html").withColumns({"rule": rule, "by_rule": verdict})
    ruled = scratch.write(ruled, "ruled")
    share = lambda kind: (F.sum(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0)) / F.count("*"))
    own = ruled.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    seeds = scratch.write(own.union(linked).groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust")), "seeds")
    ranks = scratch.write(propagate(links, seeds, scratch), "ranks")
    bad = (F.col("distrust") >= least_distrust) & (F.col("distrust") > F.col("trust"))
    by_host = F.when(bad, "block").otherwise("allow")
    return split_join(ruled, ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def op2_host_trust(spark, sf_dir: str) -> DataFrame:
    """All ``pages``, judged by RULES and host links."""
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "op2"))
