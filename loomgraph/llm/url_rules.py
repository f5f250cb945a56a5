"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path together with the literal tokens that every match must hold
(host labels `h:label`, path segments `p:segment`).  Each rule is indexed under the one of its tokens that the
fewest URLs hold.  A URL's tokens fetch its candidate rules by an equi-join, and only those run their regular
expression.  Rules without a literal token stand under `*`, which every URL holds.  Of the rules that match, the
longest wins; ties go to the smaller rule text.  No rule: allow.

Matching works on distinct URLs, so a URL repeated in a third of all rows is judged once, and the verdicts join
back on the URL (an outer join that adaptive execution may split).  Whether the rules are broadcast is Spark's
own choice by their measured size.

Edge cases: a null url or one without `://` has empty host and path and is allowed; repeated rows each get a
row; an empty table or no rules at all give the default; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RULE_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>"

#: The fixed rules of the op9 contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_rule(verdict: str, host: str, path: str) -> tuple[str, str, str, list[str]]:
    """A rule for a host and its subdomains and the paths that start with `path`."""
    whole = path.split("/")[1:-1]  # a last piece without a slash behind it may go on in the URL
    tokens = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in whole if x]
    return host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit("*"))))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, rule, verdict, pattern): each rule under its token that the fewest URLs hold."""
    listed = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("*")))
    wanted = rules.select("rule", "verdict", "pattern", F.explode(listed).alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("rule", "verdict", "pattern").orderBy(F.coalesce("n", F.lit(0)), "token"))
    return wanted.join(counts, "token", "left").withColumn("rank", rank).filter("rank = 1").select("token", "rule", "verdict", "pattern")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct url of `urls`."""
    parts = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = parts.select("url", "host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    index, _ = common.written(rule_index(rules, tokens), "url-rules")
    hits = tokens.join(index, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = hits.groupBy(F.col("url").alias("_matched")).agg(F.min(F.struct((-F.length("rule")).alias("k"), "rule", "verdict")).alias("best"))
    return parts.join(best, F.col("url").eqNullSafe(F.col("_matched")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """(key, url, host, path, rule, verdict) for every row of `pages`."""
    rows = pages.select(F.col(key), F.col("url"))
    judged = judge(rows, rules, default).withColumnRenamed("url", "_url")
    return rows.join(judged, F.col("url").eqNullSafe(F.col("_url")), "left").select(key, "url", "host", "path", "rule", "verdict")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([host_rule(*r) for r in rules], RULE_SCHEMA)


def op9_rarest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), h AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM q
), r AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rh, rp)
), m AS (
  SELECT h.page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule, coalesce((SELECT verdict FROM r WHERE rh || rp = rule), 'allow') AS verdict FROM m
"""
