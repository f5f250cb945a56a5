"""Hand-computed cases of the ranking engine's operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions import measures, text, url, vector
from loomgraph.operators import candidates, crawl, dedup, embedding, extract, frontier, graph, metrics, preferences, profiles, ranking, topics
from loomgraph.sources import feeds, tables
from loomgraph.streaming import events as stream


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- graph

DIAMOND = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3)]


@pytest.mark.parametrize("small", [graph.SMALL_EDGES, 0])
def test_pagerank_diamond(spark, small):
    nodes = spark.range(4).select("id", F.lit("d").alias("domain"))
    edges = spark.createDataFrame(DIAMOND, "src long, dst long")
    seeds = spark.createDataFrame([(7, 0, 1.0)], "surfer long, id long, p double")
    scores, steps, done = graph.pagerank(nodes, edges, seeds, config.Config(damping=0.5), small=small)
    found = {r.id: r.x for r in scores.collect()}
    assert done and steps < 30
    for node, want in enumerate((32 / 55, 8 / 55, 12 / 55, 3 / 55)):
        assert abs(found[node] - want) < 1e-5
    assert abs(sum(found.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        graph.pagerank(nodes, edges, seeds.withColumn("p", F.lit(0.5)))


def test_pagerank_paths_agree_with_a_dense_solve(spark):
    r = np.random.RandomState(1)
    n, d = 40, 0.85
    pairs = sorted({(int(a), int(b)) for a, b in r.randint(0, n, (150, 2)) if a != b and a % 7})
    w = np.zeros((n, n))
    for a, b in pairs:
        w[b, a] = 1
    degree = w.sum(0)
    seeds = [(s, int(i), 0.5) for s in range(3) for i in r.choice(n, 2, replace=False)]
    nodes = spark.range(n).select("id", F.lit(1).alias("domain"))
    edges, frame = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(seeds, "surfer long, id long, p double")
    cfg = config.Config(tolerance=1e-10, max_iterations=200)
    scores = {(x.surfer, x.id): x.x for x in graph.pagerank(nodes, edges, frame, cfg)[0].collect()}
    for s in range(3):
        p = np.zeros(n)
        for k, i, x in seeds:
            if k == s:
                p[i] += x
        walk = np.where(degree > 0, w / np.maximum(degree, 1), p[:, None])
        want = np.linalg.solve(np.eye(n) - d * walk, (1 - d) * p)
        assert max(abs(scores.get((s, i), 0) - want[i]) for i in range(n)) < 1e-8
    fixed = [{(x.surfer, x.id): x.x for x in graph.pagerank(nodes, edges, frame, iterations=4, small=k)[0].collect() if x.x > 1e-15} for k in (0, 10**6)]
    assert fixed[0].keys() == fixed[1].keys() and all(abs(fixed[0][k] - fixed[1][k]) < 1e-12 for k in fixed[0])


def test_surfers_are_dealt_over_tasks_and_no_graph_comes_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    monkeypatch.setattr(graph, "SURFERS", 1, raising=False)
    monkeypatch.setattr(Classic, "toArrow", lambda self: pytest.fail("a table came to the driver"))
    nodes = spark.range(9).select("id", F.lit("d").alias("domain"))
    seeds = spark.createDataFrame([(s, s, 1.0) for s in range(5)], "surfer long, id long, p double")
    scores = graph.pagerank(nodes, spark.createDataFrame(DIAMOND, "src long, dst long"), seeds, iterations=3)[0]
    rows = scores.withColumn("task", F.spark_partition_id()).collect()
    assert {r.surfer for r in rows} == set(range(5)) and len({(r.surfer, r.task) for r in rows}) == 5 and len({r.task for r in rows}) == 5
    assert [(r.id, r.x) for r in rows if r.surfer == 4] == [(4, 1.0)]


def test_seeds_and_domain_means(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 3)], "id long, domain long")
    pins = spark.createDataFrame([(5, 1), (5, 2), (5, 9)], "surfer long, domain long")
    assert values(graph.seed_vectors(nodes, pins), "id", "p") == [(0, 0.25), (1, 0.25), (2, 0.5)]
    scores = spark.createDataFrame([(0, 0.5), (1, 0.1), (2, 0.4), (3, 0.0)], "id long, x double")
    assert values(graph.domain_scores(nodes, scores), "domain", "score") == [(1, 0.3), (2, 0.4)]
    assert values(graph.blended_seeds(nodes, graph.seed_vectors(nodes, pins.limit(0))), "id", "p") == [(k, 0.25) for k in range(4)]


def test_stored_and_resolved_links(spark):
    links = spark.createDataFrame([(0, 10), (0, 12), (0, 10), (0, 99), (1, 12), (1, 11)], "src long, dst_url long")
    urls = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (99, None)], "url_id long, document_id long")
    assert values(graph.document_edges(links, urls), "src", "dst") == [(0, 1), (0, 2), (1, 2)]
    chain = [(k, k + 1, None) for k in range(8)] + [(8, None, "d8"), (20, 21, "own"), (21, None, None), (30, 31, None), (31, 30, "d31")]
    urls = spark.createDataFrame(chain, "id long, target long, doc string")
    got = {r.id: r.doc for r in graph.resolve_redirects(urls).collect()}
    assert got == {0: None, 1: None, 2: None, **{k: "d8" for k in range(3, 8)}, 20: "own", 30: "d31", 31: "d31"}  # five rounds; no document, no change


def test_reach_paths(spark):
    adjacency = spark.createDataFrame([("p", "a"), ("q", "a"), ("a", "b"), ("a", "p"), ("b", "c")], "a string, b string")
    pins = spark.createDataFrame([(1, "p"), (1, "q")], "surfer long, domain string")
    assert values(graph.reach(adjacency, pins), "domain", "hops", "path") == [("a", 1, ["p"]), ("b", 2, ["p", "a"])]


# ---- frontier

def test_priorities_by_hand(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "src long, dst_url long")
    scores = spark.createDataFrame([(1, 0.4), (2, 0.2)], "id long, x double")
    urls = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "url_id long, prior double")
    found = dict(values(frontier.priorities(links, scores, urls, config.Config(prior_weight=2.0)), "url_id", "priority"))
    assert {k: round(v, 9) for k, v in found.items()} == {1: 0.6, 2: 0.6, 3: 0.6}


def test_prior_depends_on_any_score(spark):
    urls = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "url_id long, domain string, hops long")
    scores = spark.createDataFrame([("b", 0.5)], "domain string, score double")
    assert values(frontier.domain_prior(scores, urls), "url_id", "prior") == [(1, 0.0), (2, 0.5)]
    assert values(frontier.domain_prior(scores.limit(0), urls), "url_id", "prior") == [(1, 1.0), (2, 0.0)]


def test_positions_merge_before_the_limits(spark):
    rows = spark.createDataFrame([(1, 9, 0), (1, 2, 5), (2, 1, 2), (3, 0, 1)], "url_id long, depth long, hops long")
    assert values(frontier.merged_positions(rows), "url_id", "depth", "hops") == [(1, 2, 0), (3, 0, 1)]


def test_enqueue_and_drop(spark):
    old = spark.createDataFrame([(1, 3, 1, 0.2), (2, 1, 0, 0.9)], "url_id long, depth long, hops long, priority double")
    new = spark.createDataFrame([(1, 1, 1, 0.5), (2, 4, 1, 5.0), (3, 0, 0, 0.1), (4, 0, 0, 0.1)], "url_id long, depth long, hops long, prior double")
    fetched = spark.createDataFrame([(4,), (1,)], "url_id long")
    assert values(frontier.enqueue(old, new, fetched), "url_id", "depth", "priority", "action") == [(1, 1, 0.5, "improved"), (2, 1, 0.9, "kept"), (3, 0, 0.1, "inserted")]


def test_record_transitions(spark):
    rows = [(1, "ok", "b", "a", 1, 0, 2), (2, "retry", None, "a", 1, 0, 2), (3, "retry", None, "a", 1, 0, 3), (4, "gone", None, None, 0, 0, 0), (5, "ok", "b", None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "url_id long, outcome string, body_hash string, old_hash string, fetch_count long, change_count long, failures long")
    out = frontier.record(df, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert values(out, "url_id", "action", "change_count", "failures") == [(1, "reschedule", 1, 0), (2, "retry", 0, 3), (3, "drop", 0, 4), (4, "drop", 0, 0), (5, "reschedule", 0, 0)]
    due = {r.url_id: r.next_fetch_at for r in out.collect()}
    assert due[1] == dt.datetime(2024, 1, 1, 20) and due[2] == dt.datetime(2024, 1, 4, 8) and due[3] is None


def test_room_of_learned_delays(spark):
    rows = spark.createDataFrame([(1, None, 0.5), (2, None, 2.5), (3, None, None), (4, 5.0, 0.5)], "domain long, crawl double, learned double")
    found = rows.select("domain", measures.room(2.5, F.col("crawl"), F.col("learned"), F.lit(None), 99).alias("room"))
    assert values(found, "domain", "room") == [(1, 5), (2, 1), (3, 2), (4, 0)]


# ---- scores and pages

def test_scales(spark):
    for nums, want in (([2, 4, 6], [0, 0.5, 1]), ([3, 3], [1, 1]), ([0, 0], [0, 0])):
        df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(nums)], "u long, k long, v double")
        assert [r.m for r in df.select("k", measures.min_max(F.col("v"), "u").alias("m")).orderBy("k").collect()] == want
    assert [one(spark, measures.recency(F.lit(a))) for a in (0.0, 7.0, 14.0, -3.0)] == [1, 0.5, 0.25, 1]
    assert [one(spark, measures.hide_penalty(F.lit(s))) for s in (0.5, 0.75, 0.875, 1.0)] == [0, 0, 0.5, 1]
    assert [one(spark, measures.half_up(F.lit(x))) for x in (0.5, 1.5, 2.4)] == [1, 2, 2]
    assert [one(spark, measures.spread(F.lit(20), F.lit(n))) for n in (4, 1, 0)] == [[2, 7, 12, 17], [10], []]


def test_interest_blend(spark):
    rows = [(1, k, c, o, 0.0, 1, 0.0, 0.0, 0.0, 7.0, 0.0, None) for k, (c, o) in enumerate(((0.1, 1.0), (0.3, 0.0), (-0.2, 0.0)))]
    names = "user long, doc long, interest_cosine double, topic_overlap double, ppr double, n_documents long, liked_cosine double, hidden_cosine double, age_days double, half_life_days double, hidden_max double, query_cosine double"
    found = ranking.total(ranking.components(spark.createDataFrame(rows, names)))
    got = [r.c_interest for r in found.orderBy("doc").collect()]
    assert np.allclose(got, [0.5 / 3 + 0.5, 0.5, 0])
    assert all(abs(r.score - (r.k_interest + r.k_ppr + r.k_feedback + r.k_recency + r.k_hide + r.k_query)) < 1e-12 for r in found.collect())


def test_slot_counts_and_composition():
    cases = {(20, 0.2, 0.5): (16, 2, 2), (20, 0.1, 0.5): (18, 1, 1), (20, 0.35, 0.5): (13, 4, 3), (20, 0.2, 1): (16, 4, 0), (20, 0, 0.5): (20, 0, 0), (10, 0.2, 0.5): (8, 1, 1)}
    assert all(ranking.slot_counts(*k) == v for k, v in cases.items())
    plan = ranking.slot_plan(5, 0.4, 0.5)
    assert plan == ["main", "adjacent_semantic", "main", "adjacent_graph", "main"]
    queues = {"main": [("m1", "d"), ("m2", "d"), ("m3", "d"), ("m4", "e")], "adjacent_semantic": [("m1", "d"), ("o1", "f")]}
    page = ranking.fill(plan, queues, 2)
    assert page == [(0, "m1", "main"), (1, "o1", "adjacent_semantic"), (2, "m2", "main"), (3, "m4", "main"), (4, "m3", "main")]
    assert ranking.fill(plan, {}, 2) == []


def test_reasons(spark):
    row = spark.createDataFrame([(0.5, 0.9, 0.05, 0.2, -1.0, 0.0, "x.org", ["a"], 1, ["b"], ["t", "u", "v"], None, 1.5, True, None)],
        "k_interest double, k_ppr double, k_feedback double, k_recency double, k_hide double, k_query double, pinned_domain string, trusted_linkers array<string>, trusted_count int, other_linkers array<string>, interest_topics array<string>, liked_title string, age_days double, published boolean, exploration string")
    got = ranking.reasons(ranking.reason_texts(row)).first()["reasons"]
    assert [(r.kind, r.text) for r in got] == [("sources", "From x.org, a site you pinned"), ("interest", "Matches your interests: t, u"), ("recency", "Published yesterday")]


def test_hard_filters(spark):
    pairs = spark.createDataFrame([(1, k, "d" + str(k % 3), "post") for k in range(6)], "user long, doc long, domain string, type string")
    ev = [(1, 1, "hide", 0, 1, "d0"), (2, 1, "like", 1, 1, "d1"), (3, 1, "click", 2, 1, "d2"), (4, 1, "block_domain", 9, 1, "d1")]
    ev += [(10 + k, 1, "impression", 5, k, "d2") for k in range(4)] + [(20, 1, "impression", 3, None, "d0")]
    ev = spark.createDataFrame(ev, "event_id long, user long, kind string, doc long, recommendation_id long, domain string")
    assert values(candidates.hard_filtered(pairs, ev, True), "doc") == [(3,)]
    assert values(candidates.hard_filtered(pairs, ev, False), "doc") == [(2,), (3,), (5,)]


# ---- topics and profiles

def test_topics(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (9, None)], "topic long, parent long")
    mine = spark.createDataFrame([(7, 2, 1.0), (7, 9, 0.0)], "user long, topic long, weight double")
    assert values(topics.covering(tree, mine), "topic", "interest") == [(2, 2)]
    assert values(topics.adjacent(tree, mine), "topic", "shown", "interest") == [(1, 1, 2), (3, 3, 2), (4, 3, 2)]
    tags = spark.createDataFrame([(1, 2, 0.6), (1, 9, 0.2)], "doc long, topic long, score double")
    assert abs(topics.overlap(tags, tree, mine).first().overlap - 0.75) < 1e-12


def test_adapted_taxonomy(spark):
    tree = spark.createDataFrame(
        [(1, None, "a", 1), (2, 1, "b", 2), (3, 1, "c", 2), (4, 3, "d", 3), (5, 3, "e", 3), (6, 2, "f", 3), (9, None, "z", 1)], "topic long, parent long, name string, tier int"
    )

    def adapted(pruned, promoted, added):
        return topics.adapt(
            tree, spark.createDataFrame(pruned, "topic long"), spark.createDataFrame(promoted, "topic long, name string"), spark.createDataFrame(added, "topic long, name string, parent long")
        )

    got = values(adapted([(2,)], [(4, "D"), (5, None)], [(100, "own", 9), (101, "top", None)]), "topic", "name", "parent", "tier")
    want = [(1, "a", None, 1), (3, "c", 1, 2), (4, "D", 1, 2), (5, "e", 1, 2), (9, "z", None, 1), (100, "own", 9, 2), (101, "top", None, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.topic for r in adapted([], [], []).collect()} == {1, 2, 3, 9}
    for wrong in [([(77,)], [], []), ([(2,)], [(6, None)], []), ([], [(3, None)], []), ([], [], [(1, "x", None)]), ([], [], [(50, "x", 4)])]:
        with pytest.raises(topics.TaxonomyError):
            adapted(*wrong)


def test_globs_match_as_the_shell_does(spark):
    from fnmatch import fnmatchcase

    globs = ["*", "a?c", "a[bx]c", "a[!b]c", "https://e.com/*.html", "a.c", "a[bc", "(a+)*", "a\\c", "*/20[0-9][0-9]/*", "$^", "{a}|b"]
    texts = ["abc", "axc", "a.c", "a[bc", "(a+)b", "a\\c", "https://e.com/x.html", "https://e.com/xhtml", "/2024/x", "$^", "{a}|b", "", "ABC"]
    rows = spark.createDataFrame([(g, t, fnmatchcase(t, g)) for g in globs for t in texts], "g string, t string, want boolean")
    assert rows.filter(F.regexp_like("t", url.glob_to_regex(F.col("g"))) != F.col("want")).collect() == []


def test_overrides(spark):
    pages = spark.createDataFrame([(1, "https://e.com/blog/a"), (2, "https://e.com/x"), (3, "https://o.org/blog/a")], "page_id long, url string")
    rows = [
        (1, "/blog/*", "title", '"Old"'), (2, "*", "title", '"New"'), (3, "*", "title", '" "'), (4, "*", "type", '"essay"'), (5, "/x", "type", '"paper"'), (6, "/x", "noindex", "true"),
        (7, "/x", "canonical_url", '"https://www.e.com/y"'), (8, "/blog/*", "canonical_url", '"https://e.com/blog/a"'), (9, "/blog/*", "published_at", '"2024-05-01"'), (10, "/x", "published_at", "5"),
    ]
    table = spark.createDataFrame([(k, "e.com", "https://e.com" + p, f, v) for k, p, f, v in rows], "id long, host string, pattern string, field string, value string")
    got = {(r.page_id, r.field): (r.value, r.valid) for r in extract.overridden(pages, table).collect()}
    assert got == {
        (1, "title"): ("New", True), (2, "title"): ("New", True), (1, "type"): (None, False), (2, "type"): ("paper", True), (2, "noindex"): ("true", True),
        (2, "canonical_url"): ("https://www.e.com/y", True), (1, "canonical_url"): (None, True), (1, "published_at"): ("2024-05-01", True), (2, "published_at"): (None, False),
    }


def test_tags_near_the_best(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "doc long, embedding array<double>")
    tops = spark.createDataFrame([(k, [c, (1 - c * c) ** 0.5]) for k, c in ((1, 1.0), (2, 0.7), (3, 0.4))], "topic long, embedding array<double>")
    assert values(topics.tag_documents(docs, tops, config.Config(tag_floor=0.5, tag_gap=0.35)), "doc", "topic") == [(1, 1), (1, 2)]


def test_profiles(spark):
    fb = spark.createDataFrame([(1, 1, 5, "like", 1), (2, 1, 5, "hide", 1), (3, 1, 6, "click", 9)], "id long, user long, doc long, kind string, at long")
    assert values(profiles.latest_feedback(fb), "id") == [(2,)]
    vs = spark.createDataFrame([(1, "liked", [1.0, 0.0], 3.0), (1, "liked", [0.0, 1.0], 4.0), (2, "liked", [1.0], 1.0), (2, "liked", [-1.0], 1.0)], "user long, kind string, embedding array<double>, weight double")
    got = profiles.weighted_means(vs).collect()
    assert len(got) == 1 and np.allclose(got[0].embedding, [0.6, 0.8])
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_means_meet_in_tasks_of_few_groups(spark, monkeypatch):
    monkeypatch.setattr(profiles, "GROUPS", 2)
    vs = spark.createDataFrame([(u, "like", [1.0, float(k)], 1.0) for u in range(9) for k in (0, 2 * u)] + [(None, "like", [2.0], 1.0)], "user long, kind string, embedding array<double>, weight double")
    found = profiles.weighted_means(vs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(user" in plan and ", 5), REPARTITION_BY_NUM" in plan  # components are made behind it
    got = {r.user: r.embedding for r in found.collect()}
    assert len(got) == 10 and got[None] == [1.0] and all(np.allclose(got[u], np.array([1.0, u]) / np.hypot(1.0, u)) for u in range(9))


# ---- URLs, text, pages

@pytest.mark.parametrize("raw, want", [
    ("HTTP://WWW.Example.com:80/a/./b/../c%7e?b=2&utm_x=1&a=1#z", "http://www.example.com/a/c~?a=1&b=2"), ("https://ex.com", "https://ex.com/"), ("https://ex.com.:443/?", "https://ex.com/"), ("ftp://x/", None),
    ("http://u:p@x/", None), ("http://x:99999/", None), ("http://x/%zz?q=%2f", "http://x/%25zz?q=%2F"), ("http://bücher.de/ü", "http://xn--bcher-kva.de/%C3%BC"), ("http://[::1]:8080/", "http://[::1]:8080/"),
    ("http://x/a?b=2&b=1&REF=q", "http://x/a?b=2&b=1"), ("http://x/?utm%5Fsource=1&a=%7e", "http://x/?a=~"), ('http://x/a|b"<>^{}[]?q=[1]|"', "http://x/a%7Cb%22%3C%3E%5E%7B%7D%5B%5D?q=%5B1%5D%7C%22"),
    ("http://a..com/", None), (f"http://{'a' * 70}.com/", None), ("http://x/a b?c d=e+f", "http://x/a%20b?c%20d=e+f"), ("http://x/..", "http://x/"), (None, None), ("", None), ("http:///x", None),
])
def test_canonical_urls(raw, want):
    assert url.canonicalize_one(raw) == want
    assert want is None or url.canonicalize_one(want) == want


def test_url_columns(spark):
    assert one(spark, url.has_segment(F.lit("http://x/Login2/y?z"))) and not one(spark, url.has_segment(F.lit("http://x/blog?login")))
    assert one(spark, url.same_site(F.lit("http://www.x.org/"), F.lit("https://X.org:443/a"))) and not one(spark, url.same_site(F.lit("http://x.org/"), F.lit("https://x.org:1/a")))
    assert one(spark, url.host(F.lit("http://u:p@X.org:8080/a"))) == "x.org:8080" and one(spark, url.origin(F.lit("HTTP://X.org:80/a"))) == "http://x.org"
    kinds = {"https://arxiv.org/abs/1": "paper", "http://a.gov/x/reports/y": "paper", "https://news.ycombinator.com/item?id=1": "thread", "https://youtu.be/x": "video", "http://x.org/a": None}
    for u, k in kinds.items():
        assert one(spark, url.type_of_url(F.lit(u))) == k
    addresses = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("::ffff:127.0.0.1",), ("x",)], "a string")
    assert [r.p for r in addresses.select(url.is_public_address("a").alias("p")).collect()] == [True, False, False, False]
    assert one(spark, F.regexp_like(F.lit("/a.b/c"), url.glob_to_regex(F.lit("/a.b/*")))) and not one(spark, F.regexp_like(F.lit("/axb/c"), url.glob_to_regex(F.lit("/a.b/*"))))


def test_text_columns(spark):
    assert one(spark, text.normalize(F.lit(" a  b \r\n\r\n\r\n\r\nc "))) == "a b\n\nc"
    assert one(spark, text.excerpt(F.lit("one two, three"), 9)) == "one two…"
    assert one(spark, text.truncate_words(F.lit("one two three"), 9)) == "one two" and one(spark, text.truncate_words(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, text.word_count(F.lit(None).cast("string"))) == 0 and one(spark, text.word_count(F.lit(" a  b "))) == 2
    df = spark.createDataFrame([("Straße\n ﬁx",), ("STRASSE fix",), (None,)], "t string")
    a, b, c = (r.h for r in df.select(text.content_hash("t").alias("h")).collect())
    assert a == b and c is None
    assert one(spark, text.embedding_input(F.lit("T"), F.lit("some te…"), F.lit("some text"))) == "T\n\nsome text"


PAGE = """<html lang="en-GB"><head><title> A title | Site </title><meta property="og:title" content="Og &amp; title"><meta name="robots" content="noindex, otherbot: nofollow"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph": [{"@type": "http://schema.org/NewsArticle", "author": [{"name": "Ann"}], "datePublished": "2024-01-02"}]}</script></head>
<body><nav><a href="/n">Nav</a></nav><article><p>Hello <a href="x?utm_a=1" rel="nofollow">one</a> <a href="/y">two</a> <a href="/y">again</a><a href="#f">f</a></article><footer>foot</footer></body></html>"""


def test_page_parsing(spark):
    pages = spark.createDataFrame([(1, "http://h.org/p", PAGE), (2, "http://h.org/q", ""), (3, None, None)], "page_id long, url string, html string")
    parsed = extract.parse_pages(pages)
    p = parsed.filter("page_id = 1").first()
    assert (p.title, p.lang, p.canonical, p.author, p.published, p.schema_types, p.text) == ("Og & title", "en", "http://h.org/c", "Ann", "2024-01-02", ["NewsArticle"], "Hello one two againf")
    assert values(extract.out_links(parsed), "page_id", "link", "internal") == [(1, "http://h.org/n", True), (1, "http://h.org/y", True)]
    got = parsed.select("page_id", extract.classify(F.col("url"), F.lit("text/html"), F.col("scholarly"), F.col("schema_types"), F.col("og_type")).alias("c"))
    assert [(r.c.type, r.c.classifier) for r in got.orderBy("page_id").collect()][:2] == [("article", "schema_org"), ("page", "fallback")]
    assert one(spark, extract.robots_directives(F.lit("NOINDEX, otherbot: nofollow"), "loomgraph/1")) == ["noindex"]
    assert one(spark, extract.robots_directives(F.lit("otherbot: noindex, nofollow"), "loomgraph/1")) == []
    assert one(spark, extract.robots_directives(F.lit("Loomgraph: noindex , nofollow"), "loomgraph/1")) == ["noindex", "nofollow"]
    assert one(spark, extract.robots_directives(F.lit("max-snippet: 5, 1noarchive1"), "x")) == ["max-snippet: 5", "1noarchive1"]
    assert sorted(one(spark, extract.robots_directives(F.lit("none"), "x"))) == ["nofollow", "noindex"]
    assert one(spark, extract.declared_canonical(F.lit("http://h/a"), F.lit("http://h/a"), F.lit("http://h/b"))) is None
    assert one(spark, extract.declared_canonical(F.lit("http://h/a"), F.lit("http://other/a"), F.lit("http://h/b"))) == "http://h/b"
    assert one(spark, extract.declared_canonical(F.lit("http://h/a"), F.lit("http://h/"), F.lit(None).cast("string"))) is None
    assert one(spark, extract.without_site_name(F.lit("A title | The Site"), F.lit("The Site"), F.lit("x.org"))) == "A title"
    raw = spark.createDataFrame([(bytearray("<meta charset=latin-1>é".encode("latin-1")), None), (bytearray("é".encode()), "nonsense")], "b binary, c string")
    assert [r.t[-1] for r in raw.select(extract.decoded(F.col("b"), F.col("c")).alias("t")).collect()] == ["é", "é"]


# ---- crawl, feeds, dedup

def test_robots():
    rules, delay, maps = crawl.robots_rules("User-agent: *\nDisallow: /\n\nUser-agent: Loom\nUser-agent: b\nDisallow: /a*c$\nAllow: /a\nDisallow:\nCrawl-delay: 1.5\nSitemap: http://x/s", "loom/2")
    assert delay == 1.5 and maps == ["http://x/s"]
    assert not crawl.robots_allows(rules, "/abc") and crawl.robots_allows(rules, "/abcd") and crawl.robots_allows(rules, "/z")
    assert crawl.robots_allows([(True, "/a"), (False, "/a")], "/a/b")


def test_headers_and_pacing(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, crawl.retry_after(F.lit("120"), now)) == 120 and one(spark, crawl.retry_after(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), now)) == 60 and one(spark, crawl.retry_after(F.lit("soon"), now)) in (None, 0.0)
    assert one(spark, crawl.charset(F.lit('Text/HTML; Charset="UTF-8"'))) == "utf-8" and one(spark, crawl.media_type(F.lit("Text/HTML; x"))) == "text/html"
    obs = spark.createDataFrame([("a", k, "succeeded", 2.0, None) for k in range(2)] + [("b", 0, "succeeded", 0.01, None), ("b", 1, "failed", None, None)], "domain string, at long, signal string, latency_s double, floor_s double")
    assert values(crawl.learned_delays(obs), "domain", "delay_s") == [("a", 3.25), ("b", 1.0)]
    reqs = spark.createDataFrame([("a", k, "failed") for k in range(5)] + [("b", k, "failed" if k != 3 else "succeeded") for k in range(6)] + [("c", k, "refused") for k in range(3)], "domain string, at long, signal string")
    assert values(crawl.exhausted(reqs), "domain") == [("a",), ("c",)]


RSS = b"<rss><channel><item><link>/a</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate></item><item><guid>http://x/b</guid></item></channel></rss>"
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="/c"/><updated>2024-02-03T04:05:06Z</updated></entry></feed>'
BOMB = b'<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>'


def test_feeds(spark):
    import gzip

    urlset = b'<urlset><url><loc>/s</loc><lastmod>2024-01-05</lastmod></url></urlset>'
    bodies = [("http://h/rss", RSS), ("http://h/atom", ATOM), ("http://h/map", gzip.compress(urlset)), ("http://h/bomb", BOMB), ("http://h/junk", b"\x00junk"), ("http://h/none", None)]
    got = feeds.read_feeds(spark.createDataFrame(bodies, "source string, body binary"))
    assert values(got, "url", "is_index") == [("http://h/a", None), ("http://h/c", None), ("http://h/s", False), ("http://x/b", None)]
    at = {r.url: (r.published, r.updated) for r in got.collect()}
    assert at["http://h/a"][0] == dt.datetime(2024, 1, 1, 9) and at["http://h/s"][1] == dt.datetime(2024, 1, 5)
    assert feeds.gunzip(gzip.compress(b"x" * 1000), 999) is None and feeds.gunzip(b"\x1f\x8bno", 9) is None and feeds.gunzip(gzip.compress(b"xy"), 2) == b"xy"


def test_dedup_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert values(dedup.insert_absent(old, spark.createDataFrame([("c",), ("b",), ("aa",)], "name string"), "name", "id"), "id", "name") == [(1, "a"), (2, "b"), (3, "aa"), (4, "c")]
    assert values(dedup.upsert(old, spark.createDataFrame([(2, "z"), (3, "y")], "id long, name string"), "id"), "id", "name") == [(1, "a"), (2, "z"), (3, "y")]


# ---- metrics, transfer, tables, streams

def test_metrics_by_hand(spark):
    ev = spark.createDataFrame([(1, 1, "impression", 1, "main", "p"), (2, 1, "impression", 2, "main", "q"), (3, 1, "click", 1, "main", "p"), (4, 1, "click", 2, "main", "q"), (5, 1, "hide", 2, "main", "q")], "event_id long, user long, kind string, recommendation_id long, slice string, domain string").withColumn("at", F.lit("2024-01-01 23:30:00").cast("timestamp"))
    pins = spark.createDataFrame([(1, "p")], "user long, domain string")
    assert values(metrics.discoveries(ev, pins, "Europe/Berlin"), "day", "n") == [(dt.date(2024, 1, 2), 1)]
    assert metrics.hide_rate(ev).first().hide_rate == 0.5 and metrics.hide_rate(ev.limit(0)).first().hide_rate == 0.0
    assert values(metrics.by_slice(ev), "slice", "shown", "clicked", "click_through") == [("main", 2, 2, 1.0)]


def test_export_import_round_trip(spark):
    users = spark.createDataFrame([(1,), (2,)], "user long")
    mine = spark.createDataFrame([(1, 5, 2.0)], "user long, topic long, weight double")
    pins = spark.createDataFrame([(1, "x.org")], "user long, domain string")
    docs = metrics.export_users(users, mine, pins)
    known = spark.createDataFrame([(5,)], "topic long")
    i, p, refused = metrics.import_users(docs, known)
    assert values(i, "user", "topic", "weight") == [(1, 5, 2.0)] and values(p, "user", "domain") == [(1, "x.org")] and refused.count() == 0
    assert values(metrics.import_users(docs, known.limit(0))[2], "user") == [(1,)]


def test_tables(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("x\ny\n1\t\tArts\tArts\t\t\t\n2\t1\tBooks\tArts\tBooks\t\t\n")
    assert values(tables.read_taxonomy(spark, str(path)), "topic", "parent", "tier") == [(1, None, 1), (2, 1, 2)]
    out = str(tmp_path / "p")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string"), out, "k")
    tables.replace_partitions(spark.createDataFrame([(3, "b")], "v long, k string"), out, "k")
    assert values(spark.read.parquet(out), "v", "k") == [(1, "a"), (3, "b")]


def test_event_stream(spark, tmp_path):
    rows = [(k, 1, k % 2, "impression", 7, dt.datetime(2024, 1, 1, k // 60, k % 60)) for k in range(90)]
    spark.createDataFrame(rows, stream.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stream.first_impressions(stream.read_events(spark, str(tmp_path / "in")))
    q = stream.append(found, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.schema(stream.EVENT).parquet(str(tmp_path / "out")).count() == 2
    counted = stream.counts(stream.read_events(spark, str(tmp_path / "in")))
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counted").collect()) == [30, 60]


def test_bad_settings():
    with pytest.raises(ValueError):
        config.Config(min_delay_s=5.0)


# ---- embeddings to make, preferences, crawl bookkeeping

def test_embedding_stage(spark):
    class Flaky(embedding.HashProvider):
        def embed(self, texts):
            raise OSError("down")

    docs = spark.createDataFrame([(k, f"t{k}" if k else None) for k in range(130)], "doc long, input string")
    made = {r.doc: r.embedding for r in embedding.embed(docs, embedding.HashProvider(8), "input", 4).collect()}
    assert made[0] is None and len(made) == 130 and all(len(v) == 4 and abs(np.linalg.norm(v) - 1) < 1e-9 for k, v in made.items() if k)
    want = np.array(embedding.HashProvider(8).embed(["t7"])[0][:4])
    assert np.allclose(made[7], want / np.linalg.norm(want))
    with pytest.raises(Exception, match="zero or short"):
        embedding.embed(docs, embedding.HashProvider(2), "input", 4).collect()
    with pytest.raises(Exception, match="down"):
        embedding.embed(docs, Flaky(8), "input", 4, attempts=2, wait_s=0.0).collect()
    old = spark.createDataFrame([(1, "m", [1.0], "a", 1), (2, "m", [1.0], "b", 1), (2, "n", [0.5], "b", 1), (3, "m", [1.0], "c", 1)], "doc long, model string, embedding array<double>, input_hash string, document_updated_at long")
    seen = spark.createDataFrame([(1, 5, "unchanged"), (2, 6, "todo")], "doc long, updated_at long, state string")
    new = spark.createDataFrame([(2, [0.0, 1.0], "z", 6)], "doc long, embedding array<double>, input_hash string, updated_at long")
    assert values(embedding.stored(old, seen, new, "m"), "doc", "model", "input_hash", "document_updated_at") == [(1, "m", "a", 5), (2, "m", "z", 6), (2, "n", "b", 1), (3, "m", "c", 1)]


def test_topics_to_embed(spark):
    t = spark.createDataFrame([(1, None, "Arts", "About art", "m"), (2, 1, "Books", "On books", None), (3, 1, "Film", None, "old")], "topic long, parent long, name string, description string, embedding_model string")
    assert values(embedding.topics_todo(t, "m"), "topic", "input") == [(2, "Arts > Books: On books"), (3, None)]
    assert embedding.topics_todo(t, "m", redo_all=True).count() == 3
    assert values(embedding.description_prompts(t), "topic", "prompt")[0] == (1, "Topic: Arts\nIts subtopics: Books, Film")


def test_feedback_and_pins(spark):
    recs = spark.createDataFrame([(9, 1, 5, "search")], "recommendation_id long, user long, doc long, surface string")
    given = spark.createDataFrame([(1, 5, 9, "like", 0), (1, 6, None, "hide", 0), (2, 5, 9, "like", 0), (1, 5, 9, "block_domain", 0)], "user long, doc long, recommendation_id long, kind string, at long")
    assert values(preferences.feedback_events(given, recs), "user", "doc", "kind", "surface") == [(1, 5, "like", "search"), (1, 6, "hide", "feed"), (2, 5, "like", "feed")]
    told = spark.createDataFrame([(1, 1, "old"), (2, 1, "old"), (3, 2, None)], "id long, user long, reason string")
    new = spark.createDataFrame([(1, 1, None), (3, 1, "not mine")], "id long, user long, reason string")
    assert values(preferences.with_reasons(told, new), "id", "reason") == [(1, None), (2, "old"), (3, None)]
    pins = spark.createDataFrame([(1, "a.org", "survey"), (1, "b.org", "survey"), (2, "a.org", "survey")], "user long, domain string, source string")
    asked = spark.createDataFrame([(1, "b.org"), (1, "www.c.org")], "user long, domain string")
    known = spark.createDataFrame([(1, "c.org", "C")], "pos long, host string, name string")
    assert values(preferences.replaced_pins(pins, asked, known), "user", "domain", "source") == [(1, "b.org", "survey"), (1, "www.c.org", "suggested"), (2, "a.org", "survey")]


def test_summary_inputs(spark):
    asked = spark.createDataFrame([(1, 5), (1, 6)], "user long, doc long")
    docs = spark.createDataFrame([(5, " A  b", "d", "", "body"), (6, None, "d", None, None)], "doc long, title string, domain string, excerpt string, text string")
    tags = spark.createDataFrame([(5, 1, 0.2), (5, 2, 0.9)], "doc long, topic long, score double")
    mine = spark.createDataFrame([(1, 5, 2, 2), (1, 5, 1, 1)], "user long, doc long, topic long, rank int")
    paths = spark.createDataFrame([(1, "X"), (2, "Y")], "topic long, path string")
    assert values(preferences.summary_inputs(asked, docs, tags, mine, paths), "doc", "title", "excerpt", "text", "topics", "interests") == [(5, "A b", None, "body", ["Y", "X"], ["X", "Y"]), (6, None, None, None, [], [])]
    cache = spark.createDataFrame([(1, 5, "m"), (1, 6, "other")], "user long, doc long, model string")
    assert values(preferences.summaries_todo(asked, cache, "m"), "doc") == [(6,)]


def test_redirects_and_seeds(spark):
    rows = [(1, "redirect", 7, False, 0), (2, "redirect", 7, True, 2), (3, "redirect", None, False, 0), (4, "ok", None, None, 1)]
    df = spark.createDataFrame(rows, "url_id long, outcome string, target long, permanent boolean, failures long").withColumns({"body_hash": F.lit("b"), "old_hash": F.lit("b"), "fetch_count": F.lit(0), "change_count": F.lit(0)})
    assert values(frontier.record(df, F.lit("2024-01-01").cast("timestamp")), "url_id", "action") == [(1, "reschedule"), (2, "drop"), (3, "drop"), (4, "reschedule")]
    moved = spark.createDataFrame([(2, 0, True), (2, 0, False)], "depth long, hops long, same boolean")
    depth, hops = frontier.redirected(F.col("depth"), F.col("hops"), F.col("same"))
    assert values(moved.select("same", depth.alias("d"), hops.alias("h")), "same", "d", "h") == [(False, 0, 1), (True, 2, 0)]
    plan = spark.createDataFrame([(1, None, 1), (2, 5, 1), (3, None, 99)], "url_id long, cycle_id long, next_fetch_at long")
    assert values(frontier.planned_targets(plan, plan.select("url_id"), 8, F.lit(10)), "url_id", "cycle_id") == [(1, 8), (2, 5), (3, None)]
    found, refused = frontier.seeds(spark.createDataFrame([("Example.com",), ("https://x.org/a?utm_source=1",), ("nonsense",), ("ftp://x.org",), (None,)], "entered string"))
    assert values(found, "url", "depth", "hops") == [("https://example.com/", 0, 0), ("https://x.org/", 0, 0), ("https://x.org/a", 0, 0)]
    assert sorted(map(str, (r.entered for r in refused.collect()))) == ["None", "ftp://x.org", "nonsense"]


def test_delays_do_not_depend_on_the_cut_in_days(spark):
    import random

    pick = random.Random(3)
    seen = [("a", k * 30_000, pick.choice(["succeeded", "succeeded", "failed", "refused"]), pick.uniform(0, 9), 0.7) for k in range(60)]
    delay = 1.0
    for _, _, signal, latency, floor in seen:
        aim = min(max(latency * 2, floor, 0.5), 10.0)
        delay = (delay + aim) / 2 if signal == "succeeded" else min(max(delay, 1.0, floor, 0.5), 10.0)
    df = spark.createDataFrame(seen, "domain string, at long, signal string, latency_s double, floor_s double")
    assert abs(crawl.learned_delays(df).first().delay_s - delay) < 1e-9


def test_running_caps_do_not_depend_on_slots(spark):
    rows = [(k, "m" if k % 3 else "n", float(k % 7)) for k in range(200)] + [(5000, "m", 1.0)]
    df = spark.createDataFrame(rows, "id long, model string, cost double")
    want = sorted(i for g in "mn" for i in [k for k, m, _ in rows if m == g] if sum(c for k, m, c in rows if m == g and k <= i) <= 150)
    for slots in (1, 7, 1024):
        assert sorted(r.id for r in metrics.within_cap(df, 150.0, "model", slots).collect()) == want


def test_dedup_strategies(spark):
    docs = spark.createDataFrame([(1, "u", "h", 99), (2, "v", "h", 99), (3, "w", "g", 9)], "doc long, canonical_url string, content_hash string, words long")
    near = spark.createDataFrame([(2, 8, 0.95), (3, 8, 0.5)], "doc long, document long, confidence double")
    none = spark.createDataFrame([("w", 7)], "canonical_url string, target long")
    assert values(dedup.decide(docs, none), "doc", "target", "method", "confidence") == [(1, 1, "new", 1.0), (2, 1, "content_hash", 1.0), (3, 7, "canonical_url", 1.0)]
    own = {"near": near, "content_hash": dedup.by_content_hash(docs)}
    assert values(dedup.decide(docs, none, strategies=own), "doc", "target", "method") == [(1, 1, "new"), (2, 8, "near"), (3, 3, "new")]
