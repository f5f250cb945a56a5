"""Cases at the edges of URL, text, crawl, feed and page functions."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text, url
from loomgraph.operators import crawl, extract
from loomgraph.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("source, most, want", [
    ("one two three", 13, "one two three"), ("one two three", 7, "one two"), ("one two three", 8, "one two"), ("one two three", 5, "one"), ("onetwothree", 5, "onetw"), ("one\n\ntwo three", 6, "one"),
    ("one\u00a0two", 5, "one"), (" abcdef", 4, " abc"), (None, 5, None),
])
def test_truncate_words(spark, source, most, want):
    assert one(spark, text.truncate_words(F.lit(source).cast("string"), most)) == want


@pytest.mark.parametrize("title, summary, body, want", [
    ("Title", "A summary.", "Body text.", "Title\n\nA summary.\n\nBody text."), ("Title", "Body text that…", "Body  text\nthat goes on.", "Title\n\nBody  text\nthat goes on."),
    ("Title", "Body text.", "Body text.", "Title\n\nBody text."), (None, "A summary.", None, "A summary."), ("Title", None, "  ", "Title"), (None, None, None, ""), ("  ", "", "", ""),
    (" T ", "\u00a0S ", "b", "T\n\nS\n\nb"),
])
def test_embedding_input(spark, title, summary, body, want):
    assert one(spark, text.embedding_input(*(F.lit(x).cast("string") for x in (title, summary, body)), 100)) == want


def test_text_without_spaces_and_with_others(spark):
    assert one(spark, text.excerpt(F.lit("字" * 400), 300)) == "字" * 300 + "…"
    assert one(spark, text.excerpt(F.lit("one two three"), 7)) == "one…"
    for space in "\u00a0\u3000\x1f\x85\u2028":
        assert one(spark, text.word_count(F.lit(f"a{space}b"))) == 2 and one(spark, text.flat(F.lit(f"{space}a{space}{space}b"))) == "a b"
        assert one(spark, text.normalize(F.lit(f"a{space}{space}b\nc"))) == "a b\nc"
    assert one(spark, text.body_hash(F.lit(b"x"))) == one(spark, F.sha2(F.lit("x"), 256))


def test_paths_are_unescaped(spark):
    assert one(spark, url.has_segment(F.lit("http://x/%6Cogin/"))) and one(spark, url.has_segment(F.lit("http://x/%zz/LOGIN7")))
    assert not one(spark, url.has_segment(F.lit("http://x/log+in/%zz")))


def test_registrable_domains(spark):
    rules = spark.createDataFrame([(x,) for x in ("com", "uk", "co.uk", "*.ck", "!www.ck")], "rule string")
    hosts = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.com:8080": "x.com", "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "10.0.0.1": "10.0.0.1", "[::1]:80": "[::1]", "q.w.unknown": "w.unknown", "com": "com"}
    got = {r.host: r.registrable for r in url.registrable_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules).collect()}
    assert got == hosts


def test_backoff_takes_the_longer_pause(spark):
    got = [one(spark, crawl.backoff(F.lit(d), F.lit(n), F.lit(a).cast("double"))) for d, n, a in ((1.0, 3, 2.0), (1.0, 1, 50.0), (4.0, 20, None), (1.0, 1, 5000.0))]
    assert got == [8.0, 50.0, 600.0, 600.0]


def test_news_sitemaps_by_path_word(spark):
    rows = [("s", 0, "http://news.org/newsletter.xml"), ("s", 1, "http://x/site-news.xml"), ("s", 2, "http://x/authors.xml")]
    files = spark.createDataFrame(rows, "source string, pos int, url string")
    assert [r.pos for r in crawl.sitemap_files(files, ["authors"], url.path_words(F.col("url")), 9).orderBy("rank").collect()] == [1, 0]


def test_robots_patterns_take_linear_time():
    rules = crawl.robots_rules("User-agent: *\nDisallow: /" + "*a" * 30 + "b$\nAllow: /%7euser/*.html$\nDisallow: /~user\nDisallow: /caf\u00e9\nDisallow: /x*$", "loomgraph")[0]
    began = time.process_time()
    assert crawl.robots_allows(rules, "/" + "a" * 3000 + "c") and not crawl.robots_allows(rules, "/" + "a" * 3000 + "b")
    assert time.process_time() - began < 2
    assert crawl.robots_allows(rules, "/~user/a.html") and not crawl.robots_allows(rules, "/%7Euser/a.htm") and not crawl.robots_allows(rules, "/caf%c3%a9/x") and not crawl.robots_allows(rules, "/xyz")
    assert crawl.robots_allows([(False, "/a*b")], "/ba") and not crawl.robots_allows([(False, "/a*b")], "/a1b2") and not crawl.robots_allows([(False, "/a$")], "/a")
    assert crawl.robots_rules("#" * crawl.ROBOTS_BYTES + "\nUser-agent: *\nDisallow: /", "x")[0] == []


def test_robots_redirects(spark):
    got = [one(spark, crawl.robots_status(F.lit(s), F.lit(n))) for s, n in ((200, 5), (200, 6), (503, 0), (404, None))]
    assert got == ["found", "missing", "unreachable", "missing"]


def test_malformed_feeds():
    bad = b"<rss><item><link>http://[bad/x</link></item><item><link>/y</link><pubDate>0001-01-01T00:00:00+23:00</pubDate></item></rss>"
    assert feeds.parse_feed(bad, "http://h/") == [("http://h/y", None, None)]
    assert feeds.parse_sitemap(b"<urlset><url><loc>http://[x</loc></url><url><loc>/a</loc></url></urlset>", "http://h/") == (False, [("http://h/a", None, None)])
    assert feeds.parse_feed(b"<?xml version='1.0' encoding='nonsense'?><rss/>", "http://h/") == []


@pytest.mark.parametrize("markup", [
    '<a href="http://[bad/x">x</a>', '<base href="http://[bad/">', '<link rel="canonical" href="http://[bad/">', '<meta property="og:url" content="http://[bad/">', "<p>x<![foo bar]>", "<![CDATA[ x ]]>", "<![ ",
    '<script type="application/ld+json">' + '[{"@graph":' * 50_000 + "</script>", '<script type="application/ld+json">{"author": 5, "@type": {"a": 1}}</script>', "<div>" * 60_000, "</p>" * 60_000, "<svg><title>no</title>", "<b>" * 60_000 + "x</i>" * 10,
])
def test_no_page_stops_the_job(markup):
    began = time.process_time()
    found = extract.page_meta(markup + '<a href="/good">fine</a>', "http://h/")
    assert time.process_time() - began < 10 and (found["links"] == [] or found["links"][-1]["url"].endswith("/good"))


def test_page_fields():
    page = """<html lang="EN-us"><head><title>T</title><meta name="loomgraph" content="nofollow"><meta name="robots" content="noindex"><meta property="og:url" content="/o"><meta property="og:locale" content="fr_FR">
<meta name="citation_date" content="2020/01/02"><meta name="author" content="B"><meta name="citation_author" content="A"></head><body>x</body></html>"""
    found = extract.page_meta(page, "http://h/a/")
    assert (found["lang"], found["robots"], found["og_url"], found["published"], found["author"]) == ("en", "noindex,nofollow", "http://h/o", "2020/01/02", "A")
    assert extract.page_meta("<meta property='og:locale' content='fr_FR'>x", "http://h/")["lang"] is None


def test_bodies_by_content_type(spark):
    rows = [("http://h.org/a", "text/html; charset=latin-1", "<html lang=de><title>Größe | H</title><p>Text".encode("latin-1")), ("http://h.org/b", "text/plain", b" plain \n\n\n text "), ("http://h.org/c", "image/png", b"\x89"), ("http://h.org/d", "application/pdf", b"%PDF"), ("http://h.org/e", None, None)]
    bodies = spark.createDataFrame(rows, "url string, content_type string, body binary")
    got = {r.url[-1]: (r.extractor, r.title, r.text) for r in extract.analyze(bodies).collect()}
    assert {k: v for k, v in got.items() if k != "a"} == {"b": ("text", None, "plain\n\ntext"), "c": ("metadata", None, None), "d": ("metadata", None, None), "e": ("metadata", None, None)}
    assert got["a"][0] == "page" and got["a"][1].startswith("Größe")
    mine = {"pdf": lambda df: df.select("url", F.lit("read").alias("text"))}
    assert {r.url[-1]: r.text for r in extract.analyze(bodies, mine).filter("extractor = 'pdf'").collect()} == {"d": "read"}


def test_titles_keep_unended_references_where_asked(spark):
    page = "<title>a &amp;&amp b&am &#38 c&lt</title><p>x &amp y"
    assert extract.page_meta(page, "http://h/")["title"] == "a && b&am & c<"
    found = extract.page_meta(page, "http://h/", ended=True)
    assert (found["title"], found["text"]) == ("a &&amp b&am &#38 c&lt", "x & y")


def test_a_task_holds_few_parsed_pages(spark, monkeypatch):
    monkeypatch.setattr(extract, "PAGES", 2)
    pages = spark.createDataFrame([(k, "http://h/", f"<title>{k}</title><a href=/{k}>x</a>") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.title, r.links[0].url) for r in extract.parse_pages(pages).collect()) == [(str(k), f"http://h/{k}") for k in range(5)]


def test_runs_of_pages_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(extract, "PAGES", 3)
    monkeypatch.setattr(extract, "PAGE_BYTES", 10)
    assert list(extract._runs([4, 4, 4, None, 50, 1, 1, 1, 1])) == [(0, 2), (2, 2), (4, 1), (5, 3), (8, 1)]
    assert list(extract._runs([])) == []
    pages = spark.createDataFrame([(k, "http://h/", None if k == 2 else f"<title>{k}</title>") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id, r.title) for r in extract.parse_pages(pages).collect()) == [(k, None if k == 2 else str(k)) for k in range(5)]


@pytest.mark.parametrize("columns, most", [(["links"], 1 << 20), (None, 4 << 20)])
def test_a_task_has_the_string_of_one_page_and_the_columns_asked_for(spark, monkeypatch, columns, most):
    pages, runs = spark.createDataFrame([], "page_id long, url string, html string"), []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema, g=type(pages).mapInArrow: runs.append(f) or g(self, f, schema))
    extract.parse_pages(pages, **({"columns": columns} if columns else {}))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(256)), "url": ["http://h/"] * 256, "html": ["<p>" + "word " * 8_000 + "<a href=/x>x</a>"] * 256})
    tracemalloc.start()
    found = [(out.num_rows, len(out.column("links")[0])) for out in runs[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in found) == 256 and {k for _, k in found} == {1}
    assert peak < most  # of 10 MB


def test_only_the_columns_asked_for_are_parsed(spark):
    pages = spark.createDataFrame([(1, "http://site.org/", "<title>T | Site</title><a href=/a>x</a>"), (2, None, None)], "page_id long, url string, html string")
    for asked in (["title"], ["links", "title"], ["links"], ["text", "site_name"], []):
        found, whole = extract.parse_pages(pages, columns=asked), extract.parse_pages(pages)
        assert sorted(found.columns) == sorted(["page_id", "url", *asked])
        assert found.orderBy("page_id").collect() == whole.select(found.columns).orderBy("page_id").collect()
    assert "text" not in extract.parse_pages(pages, columns=["links"])._jdf.queryExecution().analyzed().toString()


def test_links_are_made_canonical_once(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<a href=/a#x>x</a><a href=mailto:a@b>m</a><a href=/>self</a>")], "page_id long, url string, html string")
    found = extract.out_links(extract.parse_pages(pages))
    assert [(r.link, r.anchor, r.internal, r.pos) for r in found.collect()] == [("http://h/a", "x", True, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_long_white_space_takes_no_quadratic_time(spark):
    import time

    wide = "a" + " " * 200_000 + "b"
    rows = spark.createDataFrame([(wide, wide + " ", " " * 200_000, "\n x" + wide)], "title string, summary string, blank string, body string")
    began = time.monotonic()
    got = rows.select(text.stripped("title").alias("a"), text.stripped("blank").alias("b"), text.embedding_input(F.col("title"), F.col("summary"), F.col("body"), 100).alias("c"), text.excerpt(F.col("body"), 2).alias("d"), text.excerpt(F.col("body"), 4).alias("e")).first()
    assert time.monotonic() - began < 20
    assert (got.a, got.b, got.c, got.d, got.e) == (wide, "", f"{wide}\n\n{wide}\n\nxa", "xa…", "xa b")


@pytest.mark.parametrize("tail", [1, 3, 80])
def test_a_cut_in_the_tail_is_the_cut_of_the_whole(spark, monkeypatch, tail):
    monkeypatch.setattr(text, "TAIL", tail)
    for source, most, want in (("one two three", 8, "one two"), ("one two three", 7, "one two"), ("one two three", 6, "one"), ("a b\nc", 4, "a"), ("  a\nb", 4, ""), ("one    two", 6, "one"), ("onetwothree", 5, "onetw"), ("a b      c", 6, "a b")):
        assert one(spark, text.truncate_words(F.lit(source), most)) == want
