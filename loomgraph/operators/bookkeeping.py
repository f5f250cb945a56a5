"""State that crawl cycles keep: cycles, counters, robots and poll state, feeds, learned delays, planned entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import measures, url


def latest_cycles(cycles: DataFrame, n: int) -> DataFrame:
    """The n newest of cycles(cycle, ...)."""
    return cycles.orderBy(F.desc("cycle")).limit(n)


def current_cycle(cycles: DataFrame) -> DataFrame:
    """The running cycle, the newest if several run or none does."""
    return cycles.orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.desc("cycle")).limit(1)


def latest_scored(scores: DataFrame) -> DataFrame:
    """(cycle): the newest cycle that has scores; null without any."""
    return scores.agg(F.max("cycle").alias("cycle"))


def latest_survey(surveys: DataFrame) -> DataFrame:
    """The newest survey of each user; surveys(user, id, at ...)."""
    w = Window.partitionBy("user").orderBy(F.desc("at"), F.desc("id"))
    return surveys.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def stage_counters(cycles: DataFrame, counted: DataFrame) -> DataFrame:
    """cycles(cycle, stats map<string,bigint>) with the counts of counted(cycle, label, n) added to theirs."""
    before = cycles.select("cycle", F.explode("stats").alias("label", "n"))
    sums = before.unionByName(counted.select("cycle", "label", F.col("n").cast("long").alias("n"))).groupBy("cycle", "label").agg(F.sum("n").alias("n"))
    stats = sums.groupBy("cycle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("_stats"))
    empty = F.create_map().cast("map<string,bigint>")
    return cycles.join(stats, "cycle", "left").withColumn("stats", F.coalesce("_stats", empty)).drop("_stats")


def insert_existing(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key still exists; those deleted meanwhile are left out."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def merged_feeds(feeds: Column, found: Column) -> Column:
    """Two lists of feeds as one, distinct and sorted; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(feeds, none), F.coalesce(found, none)))


def replaced_feed(feeds: Column, old: Column, new: Column) -> Column:
    """A list of feeds with one moved to another URL, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(feeds, lambda x: F.when(x == old, new).otherwise(x))))


def saved_robots(domains: DataFrame, fetched: DataFrame) -> DataFrame:
    """domains(host, robots_text, robots_status, crawl_delay_s, sitemaps) after fetched(host, text, status, crawl_delay_s,
    sitemaps, refreshed): status, text, delay and the sitemaps of the own site change only with a refreshed copy."""
    new = fetched.select("host", *(F.col(c).alias(f"_{c}") for c in ("text", "status", "crawl_delay_s", "sitemaps", "refreshed")))
    fresh = F.coalesce("_refreshed", F.lit(False))
    own = F.filter("_sitemaps", lambda s: url.bare(url.host(s)) == url.bare(F.col("host")))
    pick = lambda name, value: F.when(fresh, value).otherwise(F.col(name)).alias(name)
    rest = [c for c in domains.columns if c not in ("robots_text", "robots_status", "crawl_delay_s", "sitemaps")]
    return domains.join(new, "host", "left").select(*rest, pick("robots_text", F.col("_text")), pick("robots_status", F.col("_status")), pick("crawl_delay_s", F.col("_crawl_delay_s")), pick("sitemaps", F.array_sort(F.array_distinct(own))))


def saved_delays(domains: DataFrame, learned: DataFrame) -> DataFrame:
    """domains(domain, delay_s ...) with the delays of learned(domain, delay_s) in place of theirs."""
    new = learned.select("domain", F.col("delay_s").alias("_delay"))
    return domains.join(new, "domain", "left").withColumn("delay_s", F.coalesce("_delay", "delay_s")).drop("_delay").select(*domains.columns)


def postponed(entries: DataFrame, disallowed: DataFrame, now: Column, ttl_h: float = 24.0) -> DataFrame:
    """entries(url_id, cycle_id, next_fetch_at ...) with those of disallowed(url_id) free again and due when the robots
    copy has expired; they spend no budget."""
    mark = disallowed.select("url_id", F.lit(True).alias("_off")).distinct()
    off, rows = F.coalesce("_off", F.lit(False)), entries.join(mark, "url_id", "left")
    rows = rows.withColumns({"next_fetch_at": F.when(off, measures.shifted(now, F.lit(ttl_h))).otherwise(F.col("next_fetch_at")), "cycle_id": F.when(~off, F.col("cycle_id"))})
    return rows.select(*entries.columns)


def planned_entries(entries: DataFrame, cycle: int, excluded: DataFrame) -> DataFrame:
    """Entries planned for a cycle, without the domains of excluded(domain)."""
    return entries.filter(F.col("cycle_id") == cycle).join(excluded.select("domain").distinct(), "domain", "left_anti")


def taxonomy(topics: DataFrame) -> DataFrame:
    """topics(topic, tier, name ...) in the order of the catalog: tier, name, id."""
    return topics.orderBy("tier", "name", "topic")


def suggested_sources(sources: DataFrame, topics: DataFrame) -> DataFrame:
    """sources(source, topic_names) with `topics`: (topic, name) of those that exist, by name."""
    refs = sources.select("source", F.explode("topic_names").alias("name")).join(topics.select("topic", "name"), "name")
    of = refs.groupBy("source").agg(F.array_sort(F.collect_set(F.struct("name", "topic"))).alias("topics"))
    none = F.array().cast(of.schema["topics"].dataType)
    return sources.join(of, "source", "left").withColumn("topics", F.coalesce("topics", none))


def corpus_by_type(documents: DataFrame) -> DataFrame:
    """(type, n)"""
    return documents.groupBy("type").agg(F.count("*").alias("n"))


def frontier_counts(entries: DataFrame, now: Column) -> DataFrame:
    """(reason, n, due): entries by reason, and how many of them are due."""
    due = F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now)
    return entries.groupBy("reason").agg(F.count("*").alias("n"), F.count(F.when(due, 1)).alias("due"))


def spend_by_model(ledger: DataFrame) -> DataFrame:
    """(model, estimated, requests, tokens, cost) of ledger(model, estimated, tokens, cost)."""
    return ledger.groupBy("model", "estimated").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
