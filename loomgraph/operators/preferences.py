"""A user's settings, pins, interests and feedback as tables; cards and summary inputs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.config import DEFAULT, Config
from loomgraph.functions import text, url

WEIGHTS = ("interest", "ppr", "feedback", "recency", "hide")
LEVELS = {"interested": 1.0, "very_interested": 2.0}


def resolved(users: DataFrame, settings: DataFrame, types: list[str], preset: str = "balanced", cfg: Config = DEFAULT) -> DataFrame:
    """(user, preset, w_<component>, exploration, semantic_share, types, summaries): stored settings, or the defaults.

    A preset's weights are those of today, the stored ones count only without a preset.  The share of semantic
    exploration is normalised, shares that are no numbers count 0, and both 0 mean a half.
    settings(user, preset, weights map<string,double>, exploration, split map<string,string>, types, summaries).
    """
    rows = users.select("user").join(settings.withColumn("_has", F.lit(True)), "user", "left")
    has = F.col("_has").isNotNull()
    chosen = F.when(has, F.col("preset")).otherwise(preset)

    def weight(k: int, name: str) -> Column:
        value = F.when(chosen.isNull(), F.col("weights")[name])
        for p, w in config.PRESETS.items():
            value = F.when(chosen == p, w[k]).otherwise(value)
        return value.alias(f"w_{name}")

    def share(name: str) -> Column:
        return F.coalesce(F.col("split")[name].try_cast("double"), F.lit(0.0))

    semantic, graph = share("adjacent_semantic"), share("adjacent_graph")
    split = F.when(~has, cfg.semantic_share).when(semantic + graph > 0, F.try_divide(semantic, semantic + graph)).otherwise(0.5)
    return rows.select(
        "user", chosen.alias("preset"), *(weight(k, n) for k, n in enumerate(WEIGHTS)), F.when(has, F.col("exploration")).otherwise(cfg.exploration).alias("exploration"),
        split.alias("semantic_share"), F.when(has, F.col("types")).otherwise(F.array(*(F.lit(t) for t in types))).alias("types"), F.coalesce("summaries", F.lit(False)).alias("summaries"),
    )


def replaced_interests(interests: DataFrame, survey: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interests, refused): the users of survey(user, pos, topic, level) get its interests in place of theirs, the last
    level of a topic named twice; a survey with an unknown topic changes nothing and is refused(user, topic)."""
    refused = survey.join(topics.select("topic"), "topic", "left_anti").select("user", "topic").distinct()
    good = survey.join(refused.select("user").distinct(), "user", "left_anti")
    weight = F.lit(None).cast("double")
    for level, w in LEVELS.items():
        weight = F.when(F.col("level") == level, w).otherwise(weight)
    new = good.groupBy("user", "topic").agg(F.max_by("level", "pos").alias("level")).select("user", "topic", weight.alias("weight"))
    return interests.join(good.select("user").distinct(), "user", "left_anti").select("user", "topic", "weight").unionByName(new), refused


def replaced_pins(pins: DataFrame, survey: DataFrame, suggested: DataFrame) -> DataFrame:
    """(user, domain, source): the users of survey(user, domain) keep the pins it names, lose the others and get the new
    ones, marked `suggested` where a suggested source is of the same site."""
    asked = survey.select("user", "domain").distinct()
    kept = pins.join(asked, ["user", "domain"], "left_semi").select("user", "domain", "source")
    others = pins.join(asked.select("user").distinct(), "user", "left_anti").select("user", "domain", "source")
    known = suggested.select(url.bare(F.col("host")).alias("_b"), F.lit("suggested").alias("_s")).distinct()
    new = asked.join(pins, ["user", "domain"], "left_anti").withColumn("_b", url.bare(F.col("domain"))).join(known, "_b", "left")
    return kept.unionByName(others).unionByName(new.select("user", "domain", F.coalesce("_s", F.lit("survey")).alias("source")))


def pins_view(pins: DataFrame, suggested: DataFrame) -> DataFrame:
    """pins(user, domain, ...) with the name of the first suggested source of the same site; suggested(pos, host, name)."""
    named = suggested.groupBy(url.bare(F.col("host")).alias("_b")).agg(F.min_by("name", "pos").alias("name"))
    return pins.withColumn("_b", url.bare(F.col("domain"))).join(named, "_b", "left").drop("_b")


def invalid_references(rows: DataFrame, documents: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(id, problem) of rows(id, user, doc, recommendation_id): `document` is unknown, or the `recommendation` is not the
    user's or served another document."""
    unknown = rows.join(documents.select("doc"), "doc", "left_anti").select("id", F.lit("document").alias("problem"))
    served = recommendations.select("recommendation_id", "user", "doc")
    wrong = rows.filter("recommendation_id IS NOT NULL").join(served, ["recommendation_id", "user", "doc"], "left_anti")
    return unknown.unionByName(wrong.select("id", F.lit("recommendation").alias("problem")))


def feedback_events(feedback: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(user, doc, recommendation_id, kind, surface, at): likes and hides as events, on the surface of the user's
    recommendation, the feed without one."""
    of = recommendations.select("recommendation_id", "user", "surface")
    rows = feedback.filter(F.col("kind").isin("like", "hide")).join(of, ["recommendation_id", "user"], "left")
    return rows.select("user", "doc", "recommendation_id", "kind", F.coalesce("surface", F.lit("feed")).alias("surface"), "at")


def with_reasons(feedback: DataFrame, given: DataFrame) -> DataFrame:
    """feedback(id, user, reason, ...) with the reasons of given(id, user, reason), null ones clear; only a user's own
    rows change."""
    new = given.select("id", "user", F.col("reason").alias("_r"), F.lit(True).alias("_given"))
    return feedback.join(new, ["id", "user"], "left").withColumn("reason", F.when(F.col("_given"), F.col("_r")).otherwise(F.col("reason"))).drop("_r", "_given")


def cards(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc, url, domain, type, title, author, at, excerpt); urls(canonical_url_id, url)."""
    return documents.join(urls, "canonical_url_id").select("doc", "url", "domain", "type", "title", "author", "at", "excerpt")


def ordered_interests(asked: DataFrame, tags: DataFrame, lineage: DataFrame, interests: DataFrame, names: DataFrame, limit: int = 12) -> DataFrame:
    """(user, doc, topic, rank) of asked(user, doc): interests at, above or below one of the document's topics first, then
    the rest, the stronger ones first, then by name."""
    tagged = asked.join(tags.select("doc", F.col("topic").alias("_t")), "doc")
    above = tagged.join(lineage, F.col("_t") == F.col("topic")).select("user", "doc", F.col("ancestor").alias("topic"))
    below = tagged.join(lineage, F.col("_t") == F.col("ancestor")).select("user", "doc", "topic")
    near = above.unionByName(below).distinct().withColumn("_near", F.lit(True))
    rows = asked.join(interests.filter("weight > 0"), "user").join(names.select("topic", "name"), "topic").join(near, ["user", "doc", "topic"], "left")
    order = Window.partitionBy("user", "doc").orderBy(F.col("_near").isNull(), F.desc("weight"), "name")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("user", "doc", "topic", "rank")


def summaries_todo(asked: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Rows of asked(user, doc) that have no cached summary of the model; cache(user, doc, model)."""
    return asked.join(cache.filter(F.col("model") == model).select("user", "doc"), ["user", "doc"], "left_anti")


def summary_inputs(asked: DataFrame, documents: DataFrame, tags: DataFrame, interests: DataFrame, paths: DataFrame, most: int = 4000) -> DataFrame:
    """(user, doc, title, domain, excerpt, text, topics, interests): clipped texts, topic paths by score, then topic, and
    interest paths by rank; interests(user, doc, topic, rank), paths(topic, path)."""
    def listed(rows: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
        found = rows.join(paths, "topic").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "topic", "path"))).alias("l"))
        return found.select(*keys, F.transform("l", lambda x: x["path"]).alias(name))

    empty = F.array().cast("array<string>")
    rows = asked.join(documents, "doc").join(listed(tags, ["doc"], -F.col("score"), "topics"), "doc", "left").join(listed(interests, ["user", "doc"], F.col("rank"), "interests"), ["user", "doc"], "left")
    clipped = (text.clip(F.col(c), most).alias(c) for c in ("title", "excerpt", "text"))
    title, excerpt, body = clipped
    return rows.select("user", "doc", title, "domain", excerpt, body, F.coalesce("topics", empty).alias("topics"), F.coalesce("interests", empty).alias("interests"))
