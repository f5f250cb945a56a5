"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; every stage but the last returns the columns
of documents.  run() writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, decontaminate, langid, simhash, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null, no letters) go, and those whose two best codewords tie:
    ambiguous with a score of a half or less.  lang becomes the predicted language."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit(docs))
    kept = found.filter((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") <= 0.5)))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words are cut; documents left without words go."""
    found = substring_dedup.cut(docs.select(*COLUMNS)).filter("n_removed < n_words OR n_words = 0")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, lesser hits are cut out of the text."""
    found = decontaminate.cut(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=False)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: Language ID and SimHash are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            common.remove(spark, before)  # what it led to is written
        before = path
    return docs
