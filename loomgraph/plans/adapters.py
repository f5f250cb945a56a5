"""The driver tables as the relations that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, preferences, serving
from loomgraph.storage import written

TYPES = ["article", "post", "thread", "paper", "pdf", "video", "page"]
KINDS = {"view": "impression", "click": "click", "purchase": "like", "error": "hide", "signup": "why_open"}
NOW = "2024-03-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(doc, domain, type, at, text)"""
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (F.col("doc_id") % 7 + 1).cast("int"))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("doc_id") * 3_600_000_000)
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("domain"), kind.alias("type"), at.alias("at"), "text")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user, kind, doc, recommendation_id, at, value)"""
    kind = F.lit(None).cast("string")
    for raw, k in KINDS.items():
        kind = F.when(F.col("event_type") == raw, k).otherwise(kind)
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("user"), kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("doc"),
        F.floor(F.col("event_id") / 2).cast("long").alias("recommendation_id"), F.col("ts").cast("timestamp").alias("at"), "value",
    )


def with_domain(ev: DataFrame, docs: DataFrame) -> DataFrame:
    return ev.join(docs.select("doc", "domain", "type"), "doc")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"))


def raw_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst_url): parts on neighbouring lines of an order; every tenth source has none."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst_url"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("src % 10 <> 0").select("src", "dst_url").distinct()


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("url_id"), F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("domain"), (F.col("p_partkey") % 3).alias("hops"))


def pins(spark: SparkSession, d: str) -> DataFrame:
    """(surfer, domain): user u pins the brand whose number is u modulo 25."""
    brands = nodes(spark, d).select("domain").distinct()
    number = F.regexp_extract("domain", "([0-9]+)$", 1).cast("long") % 25
    return brands.select(number.alias("surfer"), "domain")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """(topic, parent): nations under regions, numbered from 100."""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("topic"), F.lit(None).cast("long").alias("parent"))
    return r.union(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 100).cast("long")))


def topic_names(spark: SparkSession, d: str) -> DataFrame:
    """(topic, parent, name)"""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("topic"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    return r.union(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 100).cast("long"), "n_name"))


def interests(spark: SparkSession, d: str) -> DataFrame:
    """(user, topic, weight): three topics per user."""
    ids = [(u, t, w) for u in range(5) for t, w in ((u, 2.0), (100 + (u + 1) % 5, 1.0), ((u * 7 + 3) % 25, 0.5))]
    rows = ", ".join(f"(CAST({u} AS BIGINT), CAST({t} AS BIGINT), CAST({w} AS DOUBLE))" for u, t, w in ids)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(user, topic, weight)")


def tags(spark: SparkSession, d: str) -> DataFrame:
    """(doc, topic, score): two topics per document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    one = docs.select("doc", (F.col("doc") % 25).alias("topic"), ((F.col("doc") % 11 + 1) / 12.0).alias("score"))
    return one.union(docs.select("doc", ((F.col("doc") * 7 + 12) % 25).alias("topic"), ((F.col("doc") % 5 + 1) / 6.0).alias("score"))).groupBy("doc", "topic").agg(F.max("score").alias("score"))


def serving_context(spark: SparkSession, d: str):
    """The serving context of the users who have interests: documents with links derived from their ids, PageRank from
    each user's pinned sources, and profile vectors of interests, likes and hides."""
    docs = corpus(spark, d)
    nodes_ = docs.select(F.col("doc").alias("id"), "domain")
    to = [(F.col("id") * a + b) % m for a, b, m in ((7, 3, 997), (3, 1, 499))]
    links = nodes_.select(F.col("id").alias("src"), F.explode(F.array(*to)).alias("dst")).join(nodes_.select(F.col("id").alias("dst")), "dst", "left_semi").filter("src <> dst").distinct()
    mine = interests(spark, d)
    own = [f"(CAST({u} AS BIGINT), 'src{(2 * u + k) % 8}')" for u in range(5) for k in range(2)]
    pinned = spark.sql(f"SELECT * FROM VALUES {', '.join(own)} AS t(user, domain)")
    seeds = graph.seed_vectors(nodes_, pinned.select(F.col("user").alias("surfer"), "domain"))
    ppr = written(graph.top_scores(graph.pagerank(nodes_, links, seeds, iterations=10)[0]).select(F.col("surfer").alias("user"), F.col("id").alias("doc"), F.col("x").alias("ppr")), "ppr")
    settings = spark.createDataFrame([], "user long, preset string, weights map<string,double>, exploration double, split map<string,string>, types array<string>, summaries boolean")
    vectors = embeddings(spark, d)
    return serving.context(
        now(), vectors.withColumnRenamed("doc", "topic"), users=preferences.resolved(mine.select("user").distinct(), settings, TYPES), documents=docs.select("doc", "domain", "type", F.when(F.col("doc") % 4 != 0, F.col("at")).alias("published"), F.col("at").alias("created"), F.concat(F.lit("Document "), F.col("doc").cast("string")).alias("title")),
        embeddings=vectors, topics=topic_names(spark, d), interests=mine, tags=tags(spark, d), pins=pinned, ppr=ppr, links=links, events=with_domain(events(spark, d), docs),
    )


_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())
_TYPE = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES))
_INTEREST = ", ".join(f"({u}, {t}, {w})" for u in range(5) for t, w in ((u, "2.0::DOUBLE"), (100 + (u + 1) % 5, "1.0::DOUBLE"), ((u * 7 + 3) % 25, "0.5::DOUBLE")))
#: The same relations as DuckDB common table expressions.
SQL = {
    "corpus": f"corpus AS (SELECT doc_id AS doc, source AS domain, CASE doc_id % 7 {_TYPE} END AS type, TIMESTAMP '2024-01-01' + to_hours(doc_id::INTEGER) AS tm, text FROM documents)",
    "ev": f"ev AS (SELECT event_id, user_id AS u, CASE event_type {_CASE} END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc, event_id // 2 AS rec, ts AS tm FROM events)",
    "evd": "evd AS (SELECT ev.*, c.domain, c.type FROM ev JOIN corpus c USING (doc))",
    "emb": "emb AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS e FROM embeddings)",
    "nodes": "nodes AS (SELECT p_partkey AS id, p_brand AS domain FROM part)",
    "links": "links AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst_url FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey % 10 <> 0)",
    "edges": "edges AS (SELECT src, dst_url AS dst FROM links WHERE src <> dst_url)",
    "pins": "pins AS (SELECT DISTINCT regexp_extract(domain, '([0-9]+)$', 1)::BIGINT % 25 AS surfer, domain FROM nodes)",
    "seeds": "seeds AS (SELECT surfer, id, 1.0::DOUBLE / (nd * docs) AS p FROM (SELECT surfer, domain, count(*) OVER (PARTITION BY surfer) AS nd FROM pins) JOIN (SELECT domain, count(*) AS docs FROM nodes GROUP BY 1) USING (domain) JOIN nodes USING (domain))",
    "topics": "topics AS (SELECT r_regionkey + 100 AS topic, NULL::BIGINT AS parent FROM region UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nation)",
    "interests": f"interests AS (SELECT * FROM (VALUES {_INTEREST}) t(u, topic, weight))",
    "lineage": "lineage AS (SELECT topic, topic AS ancestor, 0 AS distance FROM topics UNION ALL SELECT topic, parent, 1 FROM topics WHERE parent IS NOT NULL)",
    "covering": "covering AS (SELECT u, topic, interest, weight FROM (SELECT i.u, l.topic, i.topic AS interest, i.weight, row_number() OVER (PARTITION BY i.u, l.topic ORDER BY distance, i.topic) AS r FROM lineage l JOIN interests i ON l.ancestor = i.topic) WHERE r = 1)",
    "tags": "tags AS (SELECT doc, topic, max(score) AS score FROM (SELECT doc_id AS doc, doc_id % 25 AS topic, (doc_id % 11 + 1) / 12.0::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, (doc_id * 7 + 12) % 25, (doc_id % 5 + 1) / 6.0::DOUBLE FROM documents) GROUP BY 1, 2)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names.split()) + ("\n" if body.startswith("SELECT") else ",\n") + body
