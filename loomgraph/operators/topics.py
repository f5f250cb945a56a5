"""Topic tree, tags and interests.  Trees have a few hundred rows; the cycle-safe closure is a fixed number of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config

MOST_TIERS = 4


def lineage(topics: DataFrame, tiers: int = MOST_TIERS) -> DataFrame:
    """(topic, ancestor, distance), the topic itself at 0; topics(topic, parent)."""
    layer = topics.select("topic", F.col("topic").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    up = topics.filter("parent IS NOT NULL").select(F.col("topic").alias("_t"), "parent")
    out = layer
    for k in range(1, tiers):
        layer = layer.join(up, F.col("ancestor") == F.col("_t")).filter("parent <> topic").select("topic", F.col("parent").alias("ancestor"), F.lit(k).cast("long").alias("distance"))
        out = out.union(layer)
    return out.groupBy("topic", "ancestor").agg(F.min("distance").alias("distance"))


def covering(topics: DataFrame, interests: DataFrame) -> DataFrame:
    """(user, topic, interest, weight): the nearest positive interest at or above each topic."""
    near = lineage(topics).join(interests.filter("weight > 0").select("user", F.col("topic").alias("interest"), "weight"), F.col("ancestor") == F.col("interest"))
    return near.groupBy("user", "topic").agg(F.min_by(F.struct("interest", "weight"), F.struct("distance", "interest")).alias("c")).select("user", "topic", "c.interest", "c.weight")


def overlap(tags: DataFrame, topics: DataFrame, interests: DataFrame) -> DataFrame:
    """(user, doc, overlap): share of a document's tag score inside the user's interests, each weighed relative to the
    strongest; documents with no tag score have no row."""
    top = interests.filter("weight > 0").groupBy("user").agg(F.max("weight").alias("top"))
    covers = covering(topics, interests).select("user", "topic", "weight")
    mass = tags.groupBy("doc").agg(F.sum("score").alias("mass")).filter("mass > 0")
    inside = tags.join(covers, "topic").groupBy("user", "doc").agg(F.sum(F.col("score") * F.col("weight")).alias("inside"))
    return inside.join(mass, "doc").join(top, "user").select("user", "doc", (F.col("inside") / (F.col("mass") * F.col("top"))).alias("overlap"))


def adjacent(topics: DataFrame, interests: DataFrame) -> DataFrame:
    """(user, topic, shown, interest): uncovered topics next to an interest: its parent, its siblings and all below
    them.  The strongest interest wins (ties: least topic), its parent before siblings, siblings in order."""
    closure = lineage(topics)
    own = interests.filter("weight > 0").select("user", F.col("topic").alias("interest"), "weight").join(topics.select(F.col("topic").alias("interest"), "parent"), "interest").filter("parent IS NOT NULL")
    of_parent = own.select("user", "interest", "weight", F.col("parent").alias("shown"), F.lit(0).alias("group"), F.col("parent").alias("topic"), F.lit(0).cast("long").alias("distance"))
    siblings = own.join(topics.select(F.col("topic").alias("shown"), F.col("parent").alias("_p")), F.col("parent") == F.col("_p")).filter("shown <> interest")
    below = siblings.join(closure, F.col("shown") == F.col("ancestor")).select("user", "interest", "weight", "shown", F.lit(1).alias("group"), "topic", "distance")
    free = of_parent.union(below).join(covering(topics, interests).select(F.col("user").alias("_u"), F.col("topic").alias("_t")), (F.col("user") == F.col("_u")) & (F.col("topic") == F.col("_t")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("user", "topic").orderBy(F.desc("weight"), "interest", "group", "shown"))
    return free.withColumn("r", rank).filter("r = 1").select("user", "topic", "shown", "interest")


#: Topics whose unit vectors travel to the tasks at a time.
TOPIC_BLOCK = 4096


def tag_documents(documents: DataFrame, topics: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc, topic, score): each document's nearest topics by cosine, those over the floor and near the best.

    documents(doc, embedding), topics(topic, embedding).  Both are scaled to unit length once and multiplied as
    matrices, a block of topics at a time; a block's best few of a document need no shuffle, and blocks beyond the
    first meet in one.  Cosines that agree to 12 digits are ties, which go to the lesser topic.
    """
    n, kind = cfg.tags_per_document, documents.schema["doc"].dataType.simpleString()
    listed = topics.select("topic", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("topic").toArrow()  # the taxonomy, in blocks
    out = None
    for at in range(0, max(listed.num_rows, 1), TOPIC_BLOCK):
        part = listed.slice(at, TOPIC_BLOCK)
        shared = documents.sparkSession.sparkContext.broadcast((part.column("topic").to_numpy(), _units(part.column("embedding"))))

        def best(batches, shared=shared):
            ids, vectors = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    rows = batch.slice(a, 4096)
                    own = _units(rows.column("embedding"))
                    score = np.full((len(own), len(ids)), -1.0)
                    for d in {x.shape for x in own if x is not None} & {x.shape for x in vectors if x is not None}:
                        i, j = ([k for k, x in enumerate(xs) if x is not None and x.shape == d] for xs in (own, vectors))
                        score[np.ix_(i, j)] = np.stack([own[k] for k in i]) @ np.stack([vectors[k] for k in j]).T
                    top = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :n]
                    yield pa.RecordBatch.from_arrays([rows.column("doc").take(pa.array(np.repeat(np.arange(len(own)), top.shape[1]))), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel()), pa.array(np.repeat(score.max(1, initial=-1.0), top.shape[1]))], names=["doc", "topic", "score", "best"])

        found = documents.select("doc", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(best, f"doc {kind}, topic long, score double, best double")
        out = found if out is None else out.union(found)
    if listed.num_rows > TOPIC_BLOCK:
        by = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 12)), "topic")
        out = out.withColumns({"r": F.row_number().over(by), "best": F.max("score").over(Window.partitionBy("doc"))}).filter(F.col("r") <= n)
    return out.filter((F.col("score") >= cfg.tag_floor) & (F.col("score") >= F.col("best") - cfg.tag_gap)).select("doc", "topic", "score")


def _units(vectors) -> list[np.ndarray | None]:
    """Vectors of unit length; None for null, zero and broken ones."""
    out = []
    for x in vectors.to_pylist():
        x = np.array(x, np.float64) if x and None not in x else None
        length = np.linalg.norm(x) if x is not None else 0.0
        out.append(x / length if length > 0 and np.isfinite(length) else None)
    return out


class TaxonomyError(ValueError):
    """An adaptation names topics that the taxonomy does not have."""


def adapt(topics: DataFrame, pruned: DataFrame, promoted: DataFrame, added: DataFrame, most_tier: int = 2) -> DataFrame:
    """(topic, name, parent, tier): pruned subtrees leave, deeper topics leave but for the promoted ones, which hang
    under their first-tier ancestor, and own ones join.

    topics(topic, parent, name, tier), pruned(topic), promoted(topic, name: null keeps it), added(topic, name, parent).
    An entry that does not match the taxonomy raises TaxonomyError; only the offending ids reach the driver.
    """
    _refuse(topics.groupBy("topic").agg(F.count("*").alias("n")).filter("n > 1"), "twice in the taxonomy")
    _refuse(pruned.select("topic").union(promoted.select("topic")).join(topics, "topic", "left_anti"), "not in the taxonomy")
    closure = lineage(topics.select("topic", "parent"), 8)
    gone = closure.join(pruned.select(F.col("topic").alias("ancestor")), "ancestor", "left_semi").select("topic").distinct()
    _refuse(promoted.join(gone, "topic", "left_semi"), "promoted but pruned")
    _refuse(promoted.join(topics.filter(F.col("tier") <= most_tier), "topic", "left_semi"), "promoted without being deep")
    root = closure.groupBy("topic").agg(F.max_by("ancestor", "distance").alias("root"))
    lifted = promoted.select("topic", F.col("name").alias("new_name"), F.lit(True).alias("lifted"))
    kept = topics.join(gone, "topic", "left_anti").join(lifted, "topic", "left").join(root, "topic").filter(F.col("lifted") | (F.col("tier") <= most_tier))
    lift = F.coalesce("lifted", F.lit(False))
    shaped = kept.select(
        "topic", F.coalesce("new_name", "name").alias("name"), F.when(lift, F.col("root")).otherwise(F.col("parent")).alias("parent"),
        F.when(lift, 2).otherwise(F.col("tier")).cast("int").alias("tier"),
    )
    _refuse(added.join(shaped, "topic", "left_semi"), "added twice")
    _refuse(added.groupBy("topic").agg(F.count("*").alias("n")).filter("n > 1"), "added twice")
    known = shaped.select("topic").union(added.select("topic")).withColumnRenamed("topic", "parent")
    _refuse(added.filter("parent IS NOT NULL").join(known, "parent", "left_anti"), "added under a parent that is not kept")
    own = added.select("topic", "name", "parent", F.when(F.col("parent").isNull(), 1).otherwise(2).alias("tier"))
    return shaped.unionByName(own)


def _refuse(offending: DataFrame, why: str) -> None:
    first = offending.select("topic").limit(5).collect()
    if first:
        raise TaxonomyError(f"{', '.join(str(r['topic']) for r in first)}: {why}")


def seed_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(topic, action, clear_embedding): inserted, updated, deleted or same; old and new(topic, name, parent)."""
    n = new.select(F.col("topic").alias("t2"), F.col("name").alias("n2"), F.col("parent").alias("p2"))
    both = old.join(n, F.col("topic") == F.col("t2"), "full")
    same = F.col("name").eqNullSafe(F.col("n2")) & F.col("parent").eqNullSafe(F.col("p2"))
    action = F.when(F.col("topic").isNull(), "inserted").when(F.col("t2").isNull(), "deleted").when(same, "same").otherwise("updated")
    return both.select(F.coalesce("topic", "t2").alias("topic"), action.alias("action")).withColumn("clear_embedding", F.col("action") == "updated")
