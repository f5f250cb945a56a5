"""State kept between cycles, on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.operators import bookkeeping as B
from loomgraph.operators import frontier


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cycles_and_counters(spark):
    cycles = spark.createDataFrame([(1, "done", {"a": 1}), (2, "running", None), (3, "failed", {})], "cycle long, status string, stats map<string,bigint>")
    assert [r.cycle for r in B.latest_cycles(cycles, 2).collect()] == [3, 2] and B.current_cycle(cycles).first().cycle == 2
    assert B.current_cycle(cycles.filter("cycle <> 2")).first().cycle == 3 and B.latest_scored(cycles).first().cycle == 3
    counted = spark.createDataFrame([(1, "a", 2), (1, "b", 5), (2, "a", 1), (1, "a", 1)], "cycle long, label string, n int")
    assert {r.cycle: r.stats for r in B.stage_counters(cycles, counted).collect()} == {1: {"a": 4, "b": 5}, 2: {"a": 1}, 3: {}}
    surveys = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 3, 1)], "user long, id long, at long")
    assert rows(B.latest_survey(surveys)) == [(1, 2, 5), (2, 3, 1)]


def test_robots_delays_and_feeds(spark):
    domains = spark.createDataFrame([("a.org", "old", "found", 1.0, ["http://a.org/s"]), ("b.org", "old", "found", None, None)], "host string, robots_text string, robots_status string, crawl_delay_s double, sitemaps array<string>")
    fetched = spark.createDataFrame([("a.org", "new", "missing", None, ["https://www.a.org/2", "https://x.org/1", "https://www.a.org/2"], True), ("b.org", "", "unreachable", 3.0, [], False)], "host string, text string, status string, crawl_delay_s double, sitemaps array<string>, refreshed boolean")
    assert rows(B.saved_robots(domains, fetched)) == [("a.org", "new", "missing", None, ["https://www.a.org/2"]), ("b.org", "old", "found", None, None)]
    delays = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "domain string, delay_s double")
    assert rows(B.saved_delays(delays, spark.createDataFrame([("a", 4.0)], "domain string, delay_s double"))) == [("a", 4.0), ("b", 2.0)]
    lists = spark.createDataFrame([(["c", "a"], ["b", "a"]), (None, ["z"])], "x array<string>, y array<string>")
    assert rows(lists.select(B.merged_feeds(F.col("x"), F.col("y")))) == [(["a", "b", "c"],), (["z"],)]
    assert lists.select(B.replaced_feed(F.col("x"), F.lit("c"), F.lit("a"))).first()[0] == ["a"]


def test_entries(spark):
    now = datetime(2024, 1, 2)
    entries = spark.createDataFrame([(1, "a", 5, None, "new"), (2, "b", 5, now, "new"), (3, "a", None, now + timedelta(hours=1), "recrawl"), (4, "c", None, None, "new"), (5, "b", 6, None, "new")], "url_id long, domain string, cycle_id long, next_fetch_at timestamp, reason string")
    out = spark.createDataFrame([("b",)], "domain string")
    assert [r[0] for r in rows(B.planned_entries(entries, 5, out).select("url_id"))] == [1]
    assert [r[0] for r in rows(frontier.plannable(entries, F.lit(now)).select("url_id"))] == [4]
    assert [r[0] for r in rows(frontier.plannable(entries, F.lit(now), 5, out).select("url_id"))] == [1, 4]
    later = {r.url_id: (r.cycle_id, r.next_fetch_at) for r in B.postponed(entries, spark.createDataFrame([(2,)], "url_id long"), F.lit(now)).collect()}
    assert later[2] == (None, now + timedelta(hours=24)) and later[1] == (5, None)
    assert rows(B.frontier_counts(entries, F.lit(now))) == [("new", 4, 4), ("recrawl", 1, 0)]
    assert [r[0] for r in rows(B.insert_existing(entries, spark.createDataFrame([(4,), (4,), (9,)], "url_id long"), "url_id").select("url_id"))] == [4]


def test_catalog_and_spend(spark):
    topics = spark.createDataFrame([(1, 2, "b"), (2, 1, "z"), (3, 2, "a")], "topic long, tier int, name string")
    assert [r.topic for r in B.taxonomy(topics).collect()] == [2, 3, 1]
    sources = spark.createDataFrame([("s", ["z", "none", "a"]), ("t", None)], "source string, topic_names array<string>")
    assert {r.source: [(x.name, x.topic) for x in r.topics] for r in B.suggested_sources(sources, topics).collect()} == {"s": [("a", 3), ("z", 2)], "t": []}
    ledger = spark.createDataFrame([("m", True, 10, 0.5), ("m", True, 5, 0.25), ("m", False, 1, 1.0)], "model string, estimated boolean, tokens long, cost double")
    assert rows(B.spend_by_model(ledger)) == [("m", False, 1, 1, 1.0), ("m", True, 2, 15, 0.75)]
    assert rows(B.corpus_by_type(spark.createDataFrame([("x",), ("x",), ("y",)], "type string"))) == [("x", 2), ("y", 1)]
