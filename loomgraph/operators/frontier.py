"""Crawl frontier as snapshots: every transition takes a table and gives the next one with an action column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config
from loomgraph.functions import measures, url


def merged_positions(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(url_id, depth, hops): least depth and least hops of each URL, independently; then the reach limits."""
    merged = candidates.groupBy("url_id").agg(F.min("depth").alias("depth"), F.min("hops").alias("hops"))
    return merged.filter((F.col("depth") <= cfg.max_depth) & (F.col("hops") <= cfg.max_hops))


def followed(depth: Column, hops: Column, same_site: Column) -> tuple[Column, Column]:
    """Position of a page that a link leads to."""
    return F.when(same_site, depth + 1).otherwise(0), F.when(same_site, hops).otherwise(hops + 1)


def redirected(depth: Column, hops: Column, same_site: Column) -> tuple[Column, Column]:
    """Position of a redirect's target: a move within the site keeps it, one to another site is a hop."""
    return F.when(same_site, depth).otherwise(0), F.when(same_site, hops).otherwise(hops + 1)


def planned_targets(frontier: DataFrame, targets: DataFrame, cycle: int, now: Column) -> DataFrame:
    """Redirect targets join the running cycle if they are due and in no plan; frontier(url_id, cycle_id, next_fetch_at)."""
    hit = targets.select("url_id", F.lit(True).alias("_hit")).distinct()
    free = F.col("_hit") & F.col("cycle_id").isNull() & (F.col("next_fetch_at") <= now)
    return frontier.join(hit, "url_id", "left").withColumn("cycle_id", F.when(free, F.lit(cycle)).otherwise(F.col("cycle_id"))).drop("_hit")


def seeds(pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, refused): the homepage of every pinned site at the start of depth and hops, and the URL entered;
    text that is no crawlable web site is refused.  pins(entered): a domain or a URL."""
    raw = F.trim("entered")
    made = pins.select("entered", url.canonicalize(F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))).alias("url"))
    host = url.host(F.col("url"))
    good = F.coalesce(F.regexp_replace(host, r"^\[|\]$", "").contains("."), F.lit(False))
    home = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/"))
    found = made.filter(good).select(F.explode(F.array(home, F.col("url"))).alias("url")).distinct()
    zero = F.lit(0).cast("long")
    return found.select("url", zero.alias("depth"), zero.alias("hops")), made.filter(~good).select("entered")


def domain_prior(domain_scores: DataFrame, urls: DataFrame) -> DataFrame:
    """urls(url_id, domain, hops) with prior: the domain's score, 0 if only others have one; without any score at
    all 1 for seeds and 0 for the rest."""
    any_score = domain_scores.agg((F.count("*") > 0).alias("scored"))
    scores = domain_scores.select(F.col("domain").alias("_d"), "score")
    prior = F.when(F.col("scored"), F.coalesce("score", F.lit(0.0))).otherwise(F.when(F.col("hops") == 0, 1.0).otherwise(0.0))
    return urls.join(scores, F.col("domain") == F.col("_d"), "left").crossJoin(F.broadcast(any_score)).withColumn("prior", prior).drop("_d", "score", "scored")  # one row


def enqueue(frontier: DataFrame, candidates: DataFrame, fetched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Next frontier with action inserted, improved or kept.

    frontier(url_id, depth, hops, priority), candidates(url_id, depth, hops, prior), fetched(url_id): URLs fetched
    before, which never come back once dropped.
    """
    new = merged_positions(candidates, cfg).join(candidates.groupBy("url_id").agg(F.max("prior").alias("prior")), "url_id")
    new = new.select("url_id", F.col("depth").alias("nd"), F.col("hops").alias("nh"), (cfg.prior_weight * F.col("prior")).alias("np"))
    dropped = fetched.select("url_id").distinct().join(frontier.select("url_id"), "url_id", "left_anti")
    both = frontier.join(new.join(dropped, "url_id", "left_anti"), "url_id", "full")
    better = (F.col("nd") < F.col("depth")) | (F.col("nh") < F.col("hops"))
    action = F.when(F.col("depth").isNull(), "inserted").when(better, "improved").otherwise("kept")
    improved = F.coalesce(better, F.lit(True))
    return both.select(
        "url_id", F.least("depth", "nd").alias("depth"), F.least("hops", "nh").alias("hops"),
        F.when(improved, F.greatest("priority", "np")).otherwise(F.col("priority")).alias("priority"), action.alias("action"),
    )


def priorities(links: DataFrame, scores: DataFrame, urls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(url_id, priority): PageRank mass over all stored links of each page, plus the weighted prior.

    links(src, dst_url), scores(id, x), urls(url_id, prior).
    """
    degree = links.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n"))
    mass = links.join(scores, F.col("src") == F.col("id")).join(degree, F.col("src") == F.col("s")).groupBy(F.col("dst_url").alias("u")).agg(F.sum(F.col("x") / F.col("n")).alias("mass"))
    return urls.join(mass, F.col("url_id") == F.col("u"), "left").select("url_id", (F.coalesce("mass", F.lit(0.0)) + cfg.prior_weight * F.col("prior")).alias("priority"))


def plannable(entries: DataFrame, now: Column, cycle: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Entries that may be planned: due (next_fetch_at null or past), not planned for a cycle (other than `cycle`), and
    not on a domain of excluded(domain)."""
    due = F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now)
    free = F.col("cycle_id").isNull() if cycle is None else F.col("cycle_id").isNull() | (F.col("cycle_id") == cycle)
    rows = entries.filter(due & free)
    return rows if excluded is None else rows.join(excluded.select("domain").distinct(), "domain", "left_anti")


def plan(entries: DataFrame, rooms: DataFrame, limit: int, reason: str = "new") -> DataFrame:
    """The `limit` best entries within each domain's room: entries(url_id, domain, priority, enqueued_at[,
    change_count, fetch_count, last_fetched_at]), rooms(domain, room)."""
    if reason == "new":
        order = [F.desc("priority"), F.col("enqueued_at").asc_nulls_first(), F.col("url_id")]
    else:
        rate = F.col("change_count") / F.greatest("fetch_count", F.lit(1))
        order = [rate.desc(), F.desc("priority"), F.col("last_fetched_at").asc_nulls_first(), F.col("url_id")]
    ranked = entries.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).filter(F.col("r") <= limit)  # before the shuffle too
    return ranked.join(rooms, "domain").filter(F.col("r") <= F.col("room")).orderBy(*order).limit(limit).drop("r", "room")


def plan_cycle(new: DataFrame, recrawl: DataFrame, rooms: DataFrame, room: int, cfg: Config = DEFAULT) -> DataFrame:
    """Recrawls take their share of the room first, new entries what is left; both count against a domain's room."""
    again = plan(recrawl, rooms, int(room * cfg.recrawl_share), "recrawl").select("url_id", "domain", F.lit("recrawl").alias("reason"))
    used = again.groupBy("domain").agg(F.count("*").alias("used"))
    left = rooms.join(used, "domain", "left").select("domain", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
    taken = again.count()  # at most the cycle's room
    fresh = plan(new, left, room - taken, "new").select("url_id", "domain", F.lit("new").alias("reason"))
    return again.unionByName(fresh)


def release(entries: DataFrame, cycle: int) -> DataFrame:
    """Entries planned for other cycles are free again."""
    return entries.withColumn("cycle_id", F.when(F.col("cycle_id") == cycle, F.col("cycle_id")))


def record(results: DataFrame, now: Column, cfg: Config = DEFAULT) -> DataFrame:
    """State transition of fetched entries.

    results(url_id, outcome, body_hash, old_hash, fetch_count, change_count, failures[, target, permanent]) gives the
    new counters, the action (reschedule, retry, drop) and when the entry is due again.  A redirect keeps its entry
    only if it is temporary and its target (an id or URL, null if not crawlable) was queued.
    """
    outcome, failed = F.col("outcome"), F.col("failures") + 1
    moved = (outcome == "redirect") & F.col("target").isNotNull() & ~F.col("permanent") if {"target", "permanent"} <= set(results.columns) else F.lit(False)
    answered = outcome.isin("ok", "not_modified") | F.coalesce(moved, F.lit(False))
    action = F.when(answered, "reschedule").when((outcome == "retry") & (failed < cfg.max_failures), "retry").otherwise("drop")
    changed = (outcome == "ok") & F.col("old_hash").isNotNull() & (F.col("body_hash") != F.col("old_hash"))
    hours = F.when(answered, cfg.recrawl_after_h).when(outcome == "retry", measures.retry_hours(failed, cfg))
    return results.select(
        "url_id", "outcome", (F.col("fetch_count") + 1).alias("fetch_count"), (F.col("change_count") + changed.cast("int")).alias("change_count"),
        F.when(outcome == "retry", failed).otherwise(0).alias("failures"), F.when(outcome == "ok", F.col("body_hash")).otherwise(F.col("old_hash")).alias("content_hash"),
        action.alias("action"), F.when(action != "drop", measures.shifted(now, hours)).alias("next_fetch_at"),
    )
