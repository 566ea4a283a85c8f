"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Native DataFrame operations only. A rule (host, path, verdict) fits a URL when its host is the URL's host or a
parent domain of it and the URL's path starts with the rule's path. The longest fitting rule wins
(host and path together); of equally long ones the longer host, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8  # hex digits of the digest that the join compares first
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> (page_id, url, host, path, rule, verdict), one row for each row of pages.

    ``verdict`` is the winning rule's, else ``default``. Null urls get empty host and path and the default.
    A rule path of any length counts: prefixes are cut at the lengths that occur among the rules (their number is
    bounded by the longest path), so a rule need not end at a slash. Repeated rows are judged alike.
    """
    digest = lambda e: F.sha2(e, 256)
    rule = rules.where("host is not null and path is not null and verdict is not null").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), F.concat("host", F.lit("\0"), "path").alias("e")
    ).withColumn("full", digest(F.col("e"))).withColumn("short", F.substring("full", 1, PREFIX)).drop("e")
    lengths = rule.agg(F.collect_set(F.length("r_path")).alias("lengths"))
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = read.select("host", "path").distinct()
    cuts = F.transform(F.filter("lengths", lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    spread = (
        keys.crossJoin(F.broadcast(lengths))  # one row, of at most as many numbers as the longest rule path
        .select("host", "path", F.explode(F.array_distinct(host_suffixes(F.col("host")))).alias("s"), F.array_distinct(cuts).alias("cuts"))
        .select("host", "path", "s", F.explode("cuts").alias("p"))
        .select("host", "path", digest(F.concat("s", F.lit("\0"), "p")).alias("full_u"))
        .withColumn("short", F.substring("full_u", 1, PREFIX))
    )
    fits = spread.join(rule, "short").where("full = full_u")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", "r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best"))
    return (
        read.join(best, ["host", "path"], "left")
        .select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


ORACLE = r"""
with u as (select page_id, url,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path from pages),
r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select page_id, any_value(host) host, any_value(path) path, arg_max(h || p, length(h || p)) as rule, coalesce(arg_max(v, length(h || p)), 'allow') verdict
from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
"""
