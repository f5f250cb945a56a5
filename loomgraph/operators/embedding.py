"""Which documents and topics need an embedding, and the providers that make them."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text

BATCH = 64


class Provider(Protocol):
    """Vectors of texts, in order; travels to the executors, so it must pickle."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Unit vectors seeded by the SHA-256 of each text, for tests."""

    def __init__(self, dimensions: int = 8, model: str = "hash") -> None:
        self.dimensions, self.model = dimensions, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        seeds = (int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts)
        made = (np.random.default_rng(s).standard_normal(self.dimensions) for s in seeds)
        return [(v / np.linalg.norm(v)).tolist() for v in made]


def candidates(documents: DataFrame, embedded: DataFrame, model: str, most: int = 2000) -> DataFrame:
    """(doc, updated_at, input, input_hash, state) of documents whose embedding of the model is missing or was made of
    another update.  state: todo; unchanged (the same input was embedded); empty (nothing to embed).

    documents(doc, updated_at, title, excerpt, text), embedded(doc, model, input_hash, document_updated_at).
    """
    known = embedded.filter(F.col("model") == model).select("doc", F.col("input_hash").alias("_hash"), "document_updated_at")
    open_ = documents.join(known, "doc", "left").filter(F.col("document_updated_at").isNull() | (F.col("document_updated_at") != F.col("updated_at")))
    made = open_.withColumn("input", text.embedding_input(F.col("title"), F.col("excerpt"), F.col("text"), most)).withColumn("input_hash", F.sha2("input", 256))
    state = F.when(F.col("input") == "", "empty").when(F.col("input_hash").eqNullSafe(F.col("_hash")), "unchanged").otherwise("todo")
    return made.select("doc", "updated_at", "input", "input_hash", state.alias("state"))


def embed(rows: DataFrame, provider: Provider, column: str, dimensions: int, attempts: int = 3, wait_s: float = 1.0) -> DataFrame:
    """rows with `embedding`: requests of 64 texts, tried again with doubled waits, cut to `dimensions` and normalised;
    a zero or short vector is an error.  Null texts have no vector."""
    kept = [f for f in rows.schema.fields if f.name != "embedding"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", embedding array<double>"

    def request(texts: list[str]) -> list[list[float]]:
        for k in range(attempts):
            try:
                return provider.embed(texts)
            except OSError:
                if k + 1 == attempts:
                    raise
                time.sleep(wait_s * 2**k)
        return []

    def fitted(vector: list[float]) -> list[float]:
        v = np.asarray(vector[:dimensions], dtype=float)
        if len(v) < dimensions or not (length := np.linalg.norm(v)) > 0:
            raise ValueError("the provider gave a zero or short vector")
        return (v / length).tolist()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH].copy()
                has = part[column].notna().to_numpy()
                made = iter(request(part[column][has].tolist()) if has.any() else [])
                part["embedding"] = [fitted(next(made)) if h else None for h in has]
                yield part

    return rows.select(*(f.name for f in kept)).mapInPandas(batches, schema)


def stored(embedded: DataFrame, checked: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The next table of embeddings(doc, model, embedding, input_hash, document_updated_at): new vectors replace those
    of their document and model, unchanged documents only move to the update that was checked."""
    other = embedded.filter(F.col("model") != model)
    seen = checked.filter("state = 'unchanged'").select("doc", "updated_at")
    own = embedded.filter(F.col("model") == model).join(vectors.select("doc"), "doc", "left_anti").join(seen, "doc", "left")
    own = own.withColumn("document_updated_at", F.coalesce("updated_at", "document_updated_at")).drop("updated_at")
    new = vectors.select("doc", F.lit(model).alias("model"), "embedding", "input_hash", F.col("updated_at").alias("document_updated_at"))
    return other.unionByName(own).unionByName(new)


def topic_path(name: Column, parent_name: Column) -> Column:
    return F.concat_ws(" > ", parent_name, name)


def topics_todo(topics: DataFrame, model: str, redo_all: bool = False) -> DataFrame:
    """(topic, input): topics without an embedding of the model, as `path: description`; input is null without a
    description.  topics(topic, parent, name, description, embedding_model)."""
    parents = topics.select(F.col("topic").alias("_p"), F.col("name").alias("_name"))
    todo = topics if redo_all else topics.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))
    path = topic_path(F.col("name"), F.col("_name"))
    return todo.join(parents, F.col("parent") == F.col("_p"), "left").select("topic", F.concat(path, F.lit(": "), "description").alias("input"))


def stale_descriptions(topics: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Topics without a description, or with one written for another name; descriptions(topic, name)."""
    written = descriptions.select("topic", F.col("name").alias("_name"))
    return topics.join(written, "topic", "left").filter(~F.col("name").eqNullSafe(F.col("_name"))).drop("_name")


def description_prompts(topics: DataFrame) -> DataFrame:
    """(topic, prompt): a topic's path, its subtopics and its siblings by name; topics(topic, parent, name)."""
    under = topics.groupBy(F.col("parent").alias("_p")).agg(F.collect_list(F.struct("name", "topic")).alias("listed"))
    parents = topics.select(F.col("topic").alias("_pid"), F.col("name").alias("_name"))
    rows = (
        topics.join(parents, F.col("parent") == F.col("_pid"), "left")
        .join(under.select(F.col("_p").alias("_c"), F.col("listed").alias("_below")), F.col("topic") == F.col("_c"), "left")
        .join(under.select(F.col("_p").alias("_s"), F.col("listed").alias("_beside")), F.col("parent").eqNullSafe(F.col("_s")), "left")
    )

    def names(listed: str, keep: Callable[[Column], Column]) -> Column:
        found = F.array_sort(F.transform(F.filter(F.coalesce(listed, F.array().cast("array<struct<name:string,topic:bigint>>")), keep), lambda x: x["name"]))
        return F.nullif(F.array_join(found, ", "), F.lit(""))

    prompt = F.concat_ws(
        "\n", F.concat(F.lit("Topic: "), topic_path(F.col("name"), F.col("_name"))),
        F.concat(F.lit("Its subtopics: "), names("_below", lambda x: F.lit(True))), F.concat(F.lit("Sibling topics, for contrast: "), names("_beside", lambda x: x["topic"] != F.col("topic"))),
    )
    return rows.select("topic", prompt.alias("prompt"))
