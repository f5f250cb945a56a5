"""Exact duplicates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config
from loomgraph.storage import written


def oldest_by_hash(documents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(content_hash, oldest): the least id of each hash of documents long enough to compare."""
    return documents.filter(F.col("words") >= cfg.hash_min_words).groupBy("content_hash").agg(F.min("doc").alias("oldest"))


def by_canonical_url(documents: DataFrame, canonical: DataFrame) -> DataFrame:
    """(doc, document, confidence): the document that the canonical URL already maps to."""
    return documents.join(canonical, "canonical_url").select("doc", F.col("target").alias("document"), F.lit(1.0).alias("confidence"))


def by_content_hash(documents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc, document, confidence): the oldest document of the same text, where that is another one."""
    long_ = documents.filter(F.col("words") >= cfg.hash_min_words)
    return long_.join(oldest_by_hash(documents, cfg), "content_hash").filter("oldest < doc").select("doc", F.col("oldest").alias("document"), F.lit(1.0).alias("confidence"))


def decide(documents: DataFrame, canonical: DataFrame, cfg: Config = DEFAULT, strategies: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc, target, method, confidence): the first strategy that is sure enough, else `new` (the document itself).

    documents(doc, canonical_url, content_hash, words), canonical(canonical_url, target): already mapped URLs.
    strategies: name -> (doc, document, confidence), at most one row a doc, tried in order; without any, the canonical
    URL comes before the content hash.
    """
    if strategies is None:
        documents = written(documents.select("doc", "canonical_url", "content_hash", "words"), "dedup-keys")  # texts are hashed once
        strategies = {"canonical_url": by_canonical_url(documents, canonical), "content_hash": by_content_hash(documents, cfg)}
    rows, found = documents, F.lit(None).cast("struct<target:bigint,method:string,confidence:double>")
    for k, (name, match) in enumerate(strategies.items()):
        sure = match.filter(F.col("document").isNotNull() & (F.col("confidence") >= cfg.dedup_confidence))
        rows = rows.join(sure.select("doc", F.struct(F.col("document").cast("long").alias("target"), F.lit(name).alias("method"), F.col("confidence").cast("double").alias("confidence")).alias(f"_m{k}")), "doc", "left")
        found = F.coalesce(found, F.col(f"_m{k}"))
    none = F.struct(F.col("doc").cast("long").alias("target"), F.lit("new").alias("method"), F.lit(1.0).alias("confidence"))
    return rows.select("doc", F.coalesce(found, none).alias("m")).select("doc", "m.target", "m.method", "m.confidence")


def decision_log(decisions: DataFrame) -> DataFrame:
    """(doc, target, method, confidence) of the decisions that joined a document to another."""
    return decisions.filter("method <> 'new'").select("doc", "target", "method", "confidence")


def content_sources(pages: DataFrame, documents: DataFrame, urls: DataFrame) -> DataFrame:
    """pages(url_id, canonical_id, document) with `is_source`: whether the page's content updates its document.  It does
    if it is the document's canonical URL, or declares it while that URL was never fetched.
    documents(document, canonical_url_id), urls(url_id, content_hash)."""
    of = documents.select("document", F.col("canonical_url_id").alias("_c")).join(urls.select(F.col("url_id").alias("_c"), F.col("content_hash").alias("_hash")), "_c")
    rule = (F.col("_c") == F.col("url_id")) | ((F.col("_c") == F.col("canonical_id")) & F.col("_hash").isNull())
    return pages.join(of, "document", "left").withColumn("is_source", F.coalesce(rule, F.lit(False))).drop("_c", "_hash")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after(url_id, document) whose document differs from before's; new URLs count as changed."""
    b = before.select(F.col("url_id").alias("_u"), F.col("document").alias("_d"))
    return after.join(b, F.col("url_id") == F.col("_u"), "left").filter(~F.col("document").eqNullSafe(F.col("_d"))).select(*after.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; both of one schema."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str, id_: str) -> DataFrame:
    """old and the unseen keys of new, which get the next ids in order of the key.

    The new keys are written in ranges of the key; ids are the rows of earlier ranges plus the place in the own one.
    """
    fresh = new.select(key).distinct().join(old.select(key), key, "left_anti")
    ranged = written(fresh.repartitionByRange(key).withColumn("_slot", F.spark_partition_id()), "new-keys")
    earlier = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_slot").agg(F.count("*").alias("n")).select("_slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    last = old.agg(F.coalesce(F.max(id_), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(key))
    numbered = ranged.withColumn("r", place).join(F.broadcast(before), "_slot").crossJoin(F.broadcast(last))  # a row per shuffle partition, one row
    return old.select(id_, key).unionByName(numbered.select((F.col("last") + F.col("before") + F.col("r")).alias(id_), key))
