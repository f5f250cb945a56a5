"""Interaction metrics, spend, and data about one user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(at: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def calendar(first: Column, last: Column, rows: DataFrame) -> DataFrame:
    """(day): every day from first to last; rows is any one-row table."""
    return rows.select(F.explode(F.sequence(first, last)).alias("day"))


def daily(events: DataFrame, days: DataFrame, kinds: list[str], zone: str = "UTC") -> DataFrame:
    """(day, kind, n): counts of each kind on each day, zeros included."""
    counts = events.groupBy(local_day(F.col("at"), zone).alias("day"), "kind").agg(F.count("*").alias("n"))
    grid = days.select("day", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    return grid.join(counts, ["day", "kind"], "left").select("day", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def discoveries(events: DataFrame, pins: DataFrame, zone: str = "UTC") -> DataFrame:
    """(day, n): clicks and likes on documents of domains that the user has not pinned."""
    found = events.filter(F.col("kind").isin("click", "like")).join(pins, ["user", "domain"], "left_anti")
    return found.groupBy(local_day(F.col("at"), zone).alias("day")).agg(F.count("*").alias("n"))


def by_slice(events: DataFrame) -> DataFrame:
    """(slice, shown, clicked, click_through): distinct recommendations."""
    def distinct(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("recommendation_id")))

    counted = events.groupBy("slice").agg(distinct("impression").alias("shown"), distinct("click").alias("clicked"))
    return counted.withColumn("click_through", F.coalesce(F.try_divide("clicked", "shown"), F.lit(0.0)))


def hide_rate(events: DataFrame) -> DataFrame:
    """(impressions, hides, hide_rate) over all events, 0 without impressions."""
    n = {k: F.count(F.when(F.col("kind") == k, 1)) for k in ("impression", "hide")}
    row = events.agg(n["impression"].alias("impressions"), n["hide"].alias("hides"))
    return row.withColumn("hide_rate", F.coalesce(F.try_divide("hides", "impressions"), F.lit(0.0)))


def spend_by_model(ledger: DataFrame) -> DataFrame:
    """(model, month, requests, cost) of ledger(model, at, cost)."""
    return ledger.groupBy("model", F.date_trunc("month", F.col("at").cast("timestamp")).cast("date").alias("month")).agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"))


def within_cap(ledger: DataFrame, cap: float, group: str, slots: int = 1024) -> DataFrame:
    """Requests, in order of id, up to the first that would pass the cap of its group; costs are not negative.

    Running sums in two levels: a group's span of ids is cut into equal slots, so no task sorts a whole group; the
    sums of earlier slots (at most `slots` rows a group) come from a small window.
    """
    span = ledger.groupBy(group).agg(F.min("id").alias("_min"), F.max("id").alias("_max"))
    slot = F.floor((F.col("id") - F.col("_min")) / (F.col("_max") - F.col("_min") + 1) * slots).cast("int")
    rows = ledger.join(span, group).withColumn("_slot", slot).drop("_min", "_max")
    sums = rows.groupBy(group, "_slot").agg(F.sum("cost").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before")).filter(F.col("_before") <= cap)
    w = Window.partitionBy(group, "_slot").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("cost").over(w) + F.col("_before")
    return rows.join(before, [group, "_slot"]).withColumn("running", running).filter(F.col("running") <= cap).drop("_slot", "_before")


def month_spend(ledger: DataFrame, now: Column) -> DataFrame:
    """(spent): this UTC month's cost up to now, 0 without requests."""
    at = F.col("at").cast("timestamp")
    return ledger.filter((at >= F.date_trunc("month", now.cast("timestamp"))) & (at <= now.cast("timestamp"))).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"))


def open_meter(spent: Column, cap: float) -> Column:
    """What may still be spent."""
    return F.greatest(F.lit(0.0), F.lit(cap) - spent)


def charge(cost: Column, tokens: Column, usd_per_million: float) -> tuple[Column, Column]:
    """Reported cost, else tokens at their price, and whether it is an estimate."""
    return F.coalesce(cost, tokens * usd_per_million / 1e6), cost.isNull()


def cycles(cycles_: DataFrame, spend: DataFrame) -> DataFrame:
    """(cycle, status, seconds, cost) of cycles(cycle, status, started, finished), spend(cycle, cost)."""
    cost = spend.groupBy("cycle").agg(F.sum("cost").alias("cost"))
    seconds = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return cycles_.join(cost, "cycle", "left").select("cycle", "status", seconds.alias("seconds"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def without_user(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of those users."""
    return {name: df.join(users.select("user").distinct(), "user", "left_anti") for name, df in tables.items()}


EXPORT = "struct<version:int,user:bigint,interests:array<struct<topic:bigint,weight:double>>,pins:array<string>>"


def export_users(users: DataFrame, interests: DataFrame, pins: DataFrame) -> DataFrame:
    """(user, document): one JSON document of each user's preferences."""
    i = interests.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("topic", "weight"))).alias("interests"))
    p = pins.groupBy("user").agg(F.array_sort(F.collect_set("domain")).alias("pins"))
    both = users.join(i, "user", "left").join(p, "user", "left")
    empty = F.from_json(F.lit('{"interests":[],"pins":[]}'), EXPORT)
    return both.select("user", F.to_json(F.struct(F.lit(1).alias("version"), "user", F.coalesce("interests", empty["interests"]).alias("interests"), F.coalesce("pins", empty["pins"]).alias("pins"))).alias("document"))


def import_users(documents: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interests, pins, refused): documents of another version or with unknown topics are refused whole."""
    parsed = documents.select("user", F.from_json("document", EXPORT).alias("d"))
    unknown = parsed.select("user", F.explode("d.interests.topic").alias("topic")).join(topics.select("topic"), "topic", "left_anti").select("user")
    refused = unknown.union(parsed.filter("d IS NULL OR d.version IS NULL OR d.version <> 1").select("user")).distinct()
    good = parsed.join(refused, "user", "left_anti")
    return good.select("user", F.inline("d.interests")), good.select("user", F.explode("d.pins").alias("domain")), refused
