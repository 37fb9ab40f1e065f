"""URL filters: rules for hosts and paths, and for what no rule fits, trust and distrust along links.

A rule fits its host and all subdomains where the path begins with the rule's; the longest decides. Hosts whose
pages are allowed by rules, on balance, are trusted seeds, and those with blocked pages are blocked ones, each
by the balance's share of its pages. Trust follows links from host to host, distrust goes back along them
(who links to blocked hosts is suspect): personalised PageRank from the seeds, both ways in one table and one
join a round. Mass is measured in what a host earns that is wholly a seed. A host is blocked by the method if its
distrust is THRESHOLD at least and more than its trust.

Links are absolute addresses in anchors of the pages' html, once a page and target; a host and its parent domain
count as linked both ways if both have pages. Addresses that are null or have no "://" have neither host nor
path: no rule fits them and nothing speaks against them, so they are allowed. Null html has no links; repeated
rows are pages of their own, with rows of their own; other columns are ignored; no pages give no rows.
All of it is built-in functions of DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds end once no host's mass grows by more than this, as it must: what is on its way shrinks by DAMPING a round.
SETTLED = 1e-4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\s"'<>]*)"""


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def addresses(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of each page."""
    rest = after_scheme(F.col("url"))
    return pages.select("page_id", F.coalesce(host_of(rest), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, r_host string, r_path string")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with `rule` and its `verdict`, null where none fits. Each distinct host looks up
    the rules of the domains it is in, longest first; of those a row takes the first that its path begins with.
    Of two rules for one host and path, that which blocks counts."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select("host").where("host <> ''").distinct().withColumn("domain", F.explode(domains))
    fits = each.join(rules, F.col("domain") == F.col("r_host")).withColumn("_rule", F.concat("r_host", "r_path"))
    entry = F.struct((-F.length("_rule")).alias("o"), (F.col("verdict") != "block").alias("p"), "r_path", F.col("_rule").alias("rule"), "verdict")
    per = fits.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_list(entry)).alias("_rules"))
    first = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["r_path"]))
    out = rows.join(per, F.col("host") == F.col("_host"), "left").withColumn("_first", F.get(first, F.lit(0)))
    return out.select(*rows.columns, F.col("_first.rule").alias("rule"), F.col("_first.verdict").alias("verdict"))


def host_links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): pages of one host that link to another; hosts (host) with pages and their parent domains."""
    there = lambda link: host_of(F.when(F.startswith(link, F.lit("//")), F.substring(link, F.lit(3), F.length(link))).otherwise(after_scheme(link)))
    to = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), there))
    found = pages.select(host_of(after_scheme(F.col("url"))).alias("src"), F.explode(to).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    parent = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where("src <> dst AND dst <> ''")
    parent = parent.join(hosts.select(F.col("host").alias("_h")), F.col("dst") == F.col("_h"), "left_semi")
    both = found.unionByName(parent).unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("n"))


def ways(links: DataFrame) -> DataFrame:
    """(kind, at, to, share): trust goes along a link by its share of the links out of its host, distrust back by
    its share of those into it."""
    steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "n"))
    total = steps.groupBy(F.col("kind").alias("_kind"), F.col("at").alias("_at")).agg(F.sum("n").alias("total"))
    return steps.join(total, (F.col("kind") == F.col("_kind")) & (F.col("at") == F.col("_at"))).select("kind", "at", "to", (F.col("n") / F.col("total")).alias("share"))


def propagated(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, host, mass): seeds (kind, host, mass) spread along links (src, dst, n). A round sends on what the
    round before brought; mass is what was brought in all."""
    steps, sent = saved(ways(links), "ways"), saved(seeds.where("mass > 0"), "seeds")
    brought, on = sent, not steps.limit(1).isEmpty()
    while on:
        go = sent.select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), "mass")
        sent = steps.join(go, (F.col("kind") == F.col("_kind")) & (F.col("at") == F.col("_host"))).groupBy("kind", F.col("to").alias("host")).agg((DAMPING * F.sum(F.col("mass") * F.col("share"))).alias("mass"))
        sent = saved(sent, "sent")
        brought = brought.unionByName(sent)
        on = (sent.agg(F.max("mass")).first()[0] or 0.0) > SETTLED
    return brought.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def host_scores(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of every host that has any. judged: with_rules() of the pages."""
    hosts = saved(judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")), "hosts")
    balance = (F.col("allowed") - F.col("blocked")) / F.col("pages")
    seeds = hosts.select(F.when(balance > 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs(balance).alias("mass"))
    mass = propagated(seeds, host_links(pages, hosts.select("host")))
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)), 9).alias(kind)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def filtered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    judged = saved(with_rules(addresses(pages), rules), "judged")
    bad = host_scores(judged, pages).where((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("_host"))
    out = judged.join(bad, F.col("host") == F.col("_host"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), rule_table(spark))
