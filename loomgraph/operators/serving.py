"""Serving pages: the user context, the seven candidate sources, signals, evidence, cursors and stored explanations.

All steps take many users at once; users who ask for a page are the rows of Context.users.  Sources keep at most
Config.per_source documents a user, so everything behind them is bounded per user.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config
from loomgraph.functions import measures
from loomgraph.operators import candidates, graph, profiles, ranking, topics
from loomgraph.operators.dedup import insert_absent
from loomgraph.storage import written

KINDS = ("interest", "liked", "hidden")
EVERGREEN = ("paper", "pdf")
#: Users whose vectors travel to the tasks at a time.
BLOCK_USERS = 1024


@dataclass(frozen=True)
class Context:
    """What ranking knows: users(user, w_<component>, exploration, semantic_share, types), documents(doc, domain, type,
    published, created, title), embeddings(doc, embedding), topics(topic, parent, name), interests(user, topic, weight),
    tags(doc, topic, score), pins(user, domain), ppr(user, doc, ppr), links(src, dst), events(event_id, user, kind, doc,
    domain, recommendation_id, at), vectors(user, kind, embedding), feedback(user, doc, kind) and the latest cycle."""

    users: DataFrame
    documents: DataFrame
    embeddings: DataFrame
    topics: DataFrame
    interests: DataFrame
    tags: DataFrame
    pins: DataFrame
    ppr: DataFrame
    links: DataFrame
    events: DataFrame
    vectors: DataFrame
    feedback: DataFrame
    cycle: int | None = None


def context(now: Column, topic_vectors: DataFrame, cycles: DataFrame | None = None, cfg: Config = DEFAULT, **tables: DataFrame) -> Context:
    """The context of tables named as in Context: the latest likes and hides of each user, and unit profile vectors of
    interests (by weight), likes and hides (by age); of events, those of its users.  topic_vectors(topic, embedding),
    cycles(cycle)."""
    tables["events"] = written(tables["events"].join(tables["users"].select("user"), "user", "left_semi"), "events")  # filters and feedback read them again and again
    feedback = profiles.latest_feedback(tables["events"].withColumnRenamed("event_id", "id")).select("user", "doc", "kind", "at")
    judged = feedback.join(tables["embeddings"], "doc").select(
        "user", F.when(F.col("kind") == "like", "liked").otherwise("hidden").alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"), profiles.like_weight(now, F.col("at"), cfg).alias("weight")
    )
    wanted = tables["interests"].filter("weight > 0").join(topic_vectors, "topic").select("user", F.lit("interest").alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("weight").cast("double").alias("weight"))
    vectors = written(profiles.weighted_means(judged.unionByName(wanted), len(KINDS) * tables["users"].count()), "profile-vectors")
    latest = cycles.agg(F.max("cycle")).first()[0] if cycles is not None else None
    return Context(vectors=vectors, feedback=written(feedback.select("user", "doc", "kind"), "feedback"), cycle=latest, **tables)


def allowed(rows: DataFrame, c: Context, served: DataFrame | None, seen: bool, cfg: Config = DEFAULT) -> DataFrame:
    """rows(user, doc, domain, type ...) past the hard filters, the user's types and what the session has served."""
    types = c.users.select("user", F.col("types").alias("_types"))
    out = rows.join(types, "user").filter(F.array_contains("_types", F.col("type"))).drop("_types")
    out = candidates.hard_filtered(out, c.events, seen, cfg=cfg)
    return out if served is None else ranking.unserved(out, served)


def ruled_out(c: Context, served: DataFrame | None, seen: bool, cfg: Config = DEFAULT) -> DataFrame:
    """(doc, out): for each document the users who may not get it; the complement of allowed()."""
    kinds = ["hide", "like", "click"] if seen else ["hide"]
    mine = c.events.join(c.users.select("user"), "user", "left_semi")
    gone = mine.filter(F.col("kind").isin(*kinds)).select("user", "doc")
    if seen:
        gone = gone.union(candidates.overshown(mine, cfg.shown_limit).select("user", "doc"))
    if served is not None:
        gone = gone.union(served.select("user", "doc"))
    blocked = mine.filter("kind = 'block_domain'").select("user", "domain").distinct().join(c.documents.select("doc", "domain"), "domain").select("user", "doc")
    types = c.documents.select("type").distinct().join(c.users.select("user", "types"), ~F.array_contains("types", F.col("type"))).groupBy("type").agg(F.collect_set("user").alias("by_type"))  # a handful of types
    lists = gone.union(blocked).groupBy("doc").agg(F.collect_set("user").alias("by_doc"))
    none = F.array().cast("array<bigint>")
    both = c.documents.select("doc", "type").join(F.broadcast(types), "type", "left").join(lists, "doc", "left")
    return both.select("doc", F.array_union(F.coalesce("by_type", none), F.coalesce("by_doc", none)).alias("out"))


def nearest(c: Context, kind: str, out: DataFrame, n: int) -> DataFrame:
    """(user, doc, cosine, pos): the n nearest allowed documents to each user's vector of a kind.

    Blocks of users' vectors meet documents as matrices; a task keeps the n best of each batch, so that what is
    shuffled is users x tasks x n at most and not users x documents.
    """
    rows = c.embeddings.select("doc", F.col("embedding").cast("array<double>").alias("embedding")).join(out, "doc")
    own = c.vectors.filter(F.col("kind") == kind).join(c.users.select("user"), "user").select("user", "embedding").orderBy("user")
    count, found = own.count(), None
    for at in range(0, max(count, 1), BLOCK_USERS):
        table = own.offset(at).limit(BLOCK_USERS).toArrow()  # a block of vectors
        ids = np.array(table.column("user").to_pylist(), np.int64)
        shared = c.embeddings.sparkSession.sparkContext.broadcast((ids, [np.array(x) for x in table.column("embedding").to_pylist()]))

        def best(batches, shared=shared):
            users, vectors = shared.value
            place = {u: k for k, u in enumerate(users.tolist())}
            for batch in batches:
                docs, kept = batch.column("doc").to_numpy(zero_copy_only=False), [[], [], []]
                listed = [np.array(x) if x and None not in x else None for x in batch.column("embedding").to_pylist()]
                gone = [[place[u] for u in us if u in place] for us in batch.column("out").to_pylist()]
                for size in {len(x) for x in vectors}:
                    at = [k for k, x in enumerate(listed) if x is not None and len(x) == size and np.linalg.norm(x) > 0]
                    who = [k for k, x in enumerate(vectors) if len(x) == size]
                    if not at:
                        continue
                    rows = np.stack([listed[k] / np.linalg.norm(listed[k]) for k in at])
                    score = np.stack([vectors[k] for k in who]) @ rows.T
                    column = {k: i for i, k in enumerate(who)}
                    for j, k in enumerate(at):
                        for u in gone[k]:
                            if u in column:
                                score[column[u], j] = -np.inf
                    for i, u in enumerate(who):
                        top = np.lexsort((docs[at], -score[i]))[:n]
                        top = top[score[i][top] > -np.inf]
                        kept[0] += [int(users[u])] * len(top)
                        kept[1] += docs[at][top].tolist()
                        kept[2] += score[i][top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.float64())], names=["user", "doc", "cosine"])

        part = rows.mapInArrow(best, "user long, doc long, cosine double")
        found = part if found is None else found.union(part)
    return candidates.top(found, [F.desc("cosine"), F.col("doc")], n)


def sources(c: Context, served: DataFrame | None = None, cfg: Config = DEFAULT, max_hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The feed's candidates (user, doc, slice), the topics next to an interest that brought documents (user, doc,
    shown, interest), and the paths of graph candidates (user, doc, path)."""
    n, recent = cfg.per_source, F.coalesce("published", "created").alias("recent")
    docs = c.documents.select("doc", "domain", "type", recent)
    ok = lambda rows: allowed(rows, c, served, True, cfg)
    by_ppr = candidates.top(ok(c.ppr.filter("ppr > 0").join(docs, "doc")), [F.desc("ppr"), F.col("doc")], n)
    pinned = candidates.top(ok(candidates.pinned_twins(c.pins, docs.select("domain").distinct()).join(docs, "domain")), [F.desc("recent"), F.col("doc")], n)
    out = written(ruled_out(c, served, True, cfg), "ruled-out")
    near = written(nearest(c, "interest", out, max(n, cfg.band_skip + cfg.band_take)), "nearest-interest")
    liked = nearest(c, "liked", out, n)
    band = near.filter((F.col("pos") > cfg.band_skip) & (F.col("pos") <= cfg.band_skip + cfg.band_take))
    covered = topics.covering(c.topics, c.interests).select("user", "topic")
    touched = written(c.tags.join(covered, "topic").select("user", "doc").distinct(), "touched")
    beside = topics.adjacent(c.topics, c.interests)
    rows = ok(c.tags.join(beside, "topic").join(touched, ["user", "doc"], "left_anti").join(docs, "doc"))
    best = candidates.top(rows, [F.desc("score"), F.desc("recent"), F.col("doc"), F.col("topic")], 3 * n)
    first = best.groupBy("user", "doc").agg(F.min("pos").alias("first"), F.min_by(F.struct("shown", "interest"), "pos").alias("why"))
    adjacent = written(candidates.top(first, [F.col("first")], n).select("user", "doc", "why.shown", "why.interest"), "topic-adjacent")
    nodes = docs.select(F.col("doc").alias("id"), "domain")
    reached = graph.reach(graph.domain_adjacency(c.links, nodes), c.pins.select(F.col("user").alias("surfer"), "domain"), max_hops)
    rows = docs.join(c.tags.select("doc").distinct(), "doc", "left_semi").join(reached.select(F.col("surfer").alias("user"), "domain", "path"), "domain")
    rows = ok(rows.join(touched, ["user", "doc"], "left_anti")).join(c.ppr, ["user", "doc"], "left").withColumn("ppr", F.coalesce("ppr", F.lit(0.0)))
    routes = written(candidates.top(rows, [F.desc("ppr"), F.desc("recent"), F.col("doc")], n).select("user", "doc", "path"), "graph-adjacent")
    sliced = [(by_ppr, ranking.MAIN), (near.filter(F.col("pos") <= n), ranking.MAIN), (liked, ranking.MAIN), (pinned, ranking.MAIN), (band, ranking.SEMANTIC), (adjacent, ranking.SEMANTIC), (routes, ranking.GRAPH)]
    every = None
    for rows, kind in sliced:
        part = rows.select("user", "doc", F.lit(kind).alias("slice"))
        every = part if every is None else every.union(part)
    return every.distinct(), adjacent, routes


def signals(pairs: DataFrame, c: Context, now: Column, query: list[float] | None = None, cfg: Config = DEFAULT, slow: float = DEFAULT.slow_half_life_days) -> DataFrame:
    """pairs(user, doc) with the inputs of ranking.components, and domain, type, published and title."""
    from loomgraph.functions import vector

    of = c.vectors.groupBy("user").pivot("kind", list(KINDS)).agg(F.first("embedding"))
    rows = pairs.select("user", "doc").distinct().join(c.documents, "doc").join(c.embeddings, "doc", "left").join(of, "user", "left")
    rows = rows.join(c.ppr, ["user", "doc"], "left").join(topics.overlap(c.tags, c.topics, c.interests), ["user", "doc"], "left")
    hidden = c.feedback.filter("kind = 'hide'").join(c.embeddings, "doc").select("user", "embedding")
    rows = rows.join(profiles.max_similarity(rows.select("user", "doc", "embedding"), hidden), ["user", "doc"], "left")
    cosine = lambda name: F.coalesce(vector.cosine(F.col("embedding"), F.col(name)), F.lit(0.0)).alias(f"{name}_cosine")
    asked = F.lit(None).cast("double") if query is None else F.coalesce(vector.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), F.lit(0.0))
    zero = F.lit(0.0)
    return rows.select(
        "user", "doc", "domain", "type", F.col("published").isNotNull().alias("published"), "title", *(cosine(k) for k in KINDS), F.coalesce("overlap", zero).alias("topic_overlap"), F.coalesce("ppr", zero).alias("ppr"),
        F.lit(c.documents.count()).alias("n_documents"), measures.age_days(now, F.coalesce("published", "created")).alias("age_days"),
        F.when(F.col("type").isin(*EVERGREEN), slow).otherwise(cfg.half_life_days).alias("half_life_days"), F.coalesce("similarity", zero).alias("hidden_max"), asked.alias("query_cosine"),
    )


def scored(rows: DataFrame, c: Context, search: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """Components, weights w_<component>, contributions k_<component> and the score, by each user's own weights."""
    weights = [F.col(f"w_{n}").cast("double").alias(f"w_{n}") for n in ranking.COMPONENTS if n != "query"]
    out = ranking.components(rows, cfg).join(c.users.select("user", *weights), "user").withColumn("w_query", F.lit(cfg.query_weight if search else 0.0))
    out = out.withColumns({f"k_{n}": (-F.col("w_hide") if n == "hide" else F.col(f"w_{n}")) * F.col(f"c_{n}") for n in ranking.COMPONENTS})
    return out.withColumn("score", sum((F.col(f"k_{n}") for n in ranking.COMPONENTS), F.lit(0.0)))


def composed(rows: DataFrame, c: Context, cfg: Config = DEFAULT) -> DataFrame:
    """(user, slot, doc, slice): a page of each user by its own share of exploration; rows(user, doc, domain, slice, score)."""
    import pandas as pd

    size, per_domain = cfg.page_size, cfg.per_domain

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True])
        queues = {k: list(zip(g["doc"], g["domain"], strict=True)) for k, g in pdf.groupby("slice")}
        plan = ranking.slot_plan(size, float(pdf["exploration"].iloc[0]), float(pdf["semantic_share"].iloc[0]))
        return pd.DataFrame([(key[0], *pick) for pick in ranking.fill(plan, queues, per_domain)], columns=["user", "slot", "doc", "slice"])

    of = c.users.select("user", F.col("exploration").cast("double").alias("exploration"), F.col("semantic_share").cast("double").alias("semantic_share"))
    return rows.select("user", "doc", "domain", "slice", "score").join(of, "user").groupBy("user").applyInPandas(one, "user long, slot int, doc long, slice string")


def evidence(picks: DataFrame, c: Context, adjacent: DataFrame, routes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """picks(user, doc, domain ...) with pinned_domain, trusted and other linkers with their counts, the interests whose
    topics the document has (strongest first), the most similar liked document, and why it explores."""
    of = c.documents.select(F.col("doc").alias("src"), F.col("domain").alias("host"))
    linked = picks.select("user", F.col("doc").alias("dst"), F.col("domain").alias("own")).join(c.links.distinct(), "dst").join(of, "src").filter("host <> own")
    mass = linked.join(c.ppr.select("user", F.col("doc").alias("src"), "ppr"), ["user", "src"], "left").groupBy("user", F.col("dst").alias("doc"), "host").agg(F.sum(F.coalesce("ppr", F.lit(0.0))).alias("mass"))
    mass = mass.join(c.pins.select("user", F.col("domain").alias("host"), F.lit(True).alias("trusted")).distinct(), ["user", "host"], "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("user", "doc", "trusted").orderBy(F.desc(F.round("mass", 12)), "host"))
    total = F.count("*").over(Window.partitionBy("user", "doc", "trusted"))
    few = mass.withColumns({"r": rank, "n": total}).filter(F.col("r") <= cfg.examples)  # examples and counts, no list of a popular document's linkers
    names = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("trusted") == flag, F.struct("r", "host")))), lambda x: x["host"])
    counts = lambda flag: F.coalesce(F.max(F.when(F.col("trusted") == flag, F.col("n"))), F.lit(0)).cast("int")
    linkers = few.groupBy("user", "doc").agg(names(True).alias("trusted_linkers"), counts(True).alias("trusted_count"), names(False).alias("other_linkers"), counts(False).alias("other_count"))

    tagged = picks.select("user", "doc").join(c.tags, "doc")
    strength = tagged.join(topics.covering(c.topics, c.interests), ["user", "topic"]).groupBy("user", "doc", "interest").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    named = strength.join(c.topics.select(F.col("topic").alias("interest"), "name"), "interest")
    matched = named.groupBy("user", "doc").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("s", 12)).alias("k"), "interest", "name"))), lambda x: x["name"]).alias("interest_topics"))

    likes = c.feedback.filter("kind = 'like'").join(c.embeddings, "doc").select("user", "doc", "embedding")
    similar = profiles.most_similar(picks.select("user", "doc").join(c.embeddings, "doc"), likes).join(c.documents.select(F.col("doc").alias("liked"), F.col("title").alias("liked_title")), "liked", "left").select("user", "doc", F.col("liked").alias("liked_doc"), "liked_title")

    name = lambda key, out: c.topics.select(F.col("topic").alias(key), F.col("name").alias(out))
    beside = adjacent.join(name("shown", "adjacent_topic"), "shown", "left").join(name("interest", "interest_topic"), "interest", "left").select("user", "doc", "adjacent_topic", "interest_topic")
    outside = tagged.groupBy("user", "doc").agg(F.min_by("topic", F.struct(-F.col("score"), "topic")).alias("t")).join(name("t", "outside_topic"), "t", "left").select("user", "doc", "outside_topic")
    pinned = c.pins.select("user", "domain", F.col("domain").alias("pinned_domain")).distinct()
    out = picks.join(pinned, ["user", "domain"], "left")
    for more in (linkers, matched, similar, beside, outside, routes):
        out = out.join(more, ["user", "doc"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({k: F.coalesce(k, none) for k in ("trusted_linkers", "other_linkers", "interest_topics", "path")} | {k: F.coalesce(k, F.lit(0)) for k in ("trusted_count", "other_count")})
    return out.withColumn("exploration", exploration_text(F.col("slice"), F.col("adjacent_topic"), F.col("interest_topic"), F.col("outside_topic"), F.col("path")))


def exploration_text(kind: Column, adjacent_topic: Column, interest_topic: Column, outside_topic: Column, path: Column) -> Column:
    """Why a document was picked to explore; null for the main slice.  The wordings are fixed values."""
    topic, first = F.coalesce(outside_topic, F.lit("a new topic")), F.get(path, F.lit(0))
    graph_text = (
        F.when(F.size(path) < 1, F.concat(F.lit("Exploring: "), topic, F.lit(", near sites you trust")))
        .when(F.size(path) == 1, F.concat(F.lit("Exploring: "), topic, F.lit(", from a site "), first, F.lit(" links to")))
        .otherwise(F.concat(F.lit("Exploring: "), topic, F.lit(", "), F.size(path).cast("string"), F.lit(" links away from "), first))
    )
    beside = F.concat(F.lit("Exploring: "), adjacent_topic, F.lit(", next to your interest "), interest_topic)
    return F.when(kind == ranking.GRAPH, graph_text).when(kind == ranking.SEMANTIC, F.coalesce(beside, F.lit("Exploring: near your interests, past the closest matches")))


INPUTS: dict[str, dict[str, str]] = {
    "interest": {"cosine": "interest_cosine", "topic_overlap": "topic_overlap"}, "ppr": {"ppr": "ppr"}, "feedback": {"liked_cosine": "liked_cosine", "hidden_cosine": "hidden_cosine"},
    "recency": {"age_days": "age_days", "half_life_days": "half_life_days"}, "hide": {"max_hidden_similarity": "hidden_max"}, "query": {"cosine": "query_cosine"},
}
EVIDENCE = ("pinned_domain", "trusted_linkers", "trusted_count", "other_linkers", "other_count", "interest_topics", "liked_doc", "liked_title", "age_days", "published", "exploration")
EVIDENCE_TYPE = "pinned_domain string, trusted_linkers array<string>, trusted_count int, other_linkers array<string>, other_count int, interest_topics array<string>, liked_doc long, liked_title string, age_days double, published boolean, exploration string"
STORED = f"version int, components array<struct<name:string,inputs:map<string,double>,value:double,weight:double,contribution:double>>, evidence struct<{', '.join(x.replace(' ', ':', 1) for x in EVIDENCE_TYPE.split(', '))}>"


def breakdown(search: bool, cfg: Config = DEFAULT) -> Column:
    """JSON of each component's inputs, value, weight and contribution, and of the evidence, as stored with a page."""

    def part(name: str) -> Column:
        inputs = [x for k, col in INPUTS[name].items() for x in (F.lit(k), F.col(col).cast("double"))]
        inputs += [F.lit("threshold"), F.lit(cfg.hide_threshold)] if name == "hide" else []
        return F.struct(F.lit(name).alias("name"), F.create_map(*inputs).alias("inputs"), F.col(f"c_{name}").alias("value"), F.col(f"w_{name}").alias("weight"), F.col(f"k_{name}").alias("contribution"))

    parts = F.array(*(part(n) for n in ranking.COMPONENTS if search or n != "query"))
    age = F.greatest(F.lit(0.0), "age_days").alias("age_days")
    return F.to_json(F.struct(F.lit(2).alias("version"), parts.alias("components"), F.struct(*(age if n == "age_days" else F.col(n) for n in EVIDENCE)).alias("evidence")))


def why(recommendations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(recommendation_id, user, doc, reasons, components): the stored breakdowns read again; recommendations without a
    readable one have no row."""
    b = F.from_json("breakdown", STORED)
    rows = recommendations.withColumn("b", b).filter("b.components IS NOT NULL")
    given = F.map_from_entries(F.transform("b.components", lambda x: F.struct(x["name"], x["contribution"])))
    value = {n: F.coalesce(F.try_element_at(given, F.lit(n)), F.lit(0.0)) for n in ranking.COMPONENTS}
    flat = rows.select("recommendation_id", "user", "doc", F.col("b.components").alias("components"), "b.evidence.*", *(v.alias(f"k_{n}") for n, v in value.items()))
    return ranking.reasons(ranking.reason_texts(flat, cfg), cfg).select("recommendation_id", "user", "doc", "reasons", "components")


class CursorError(ValueError):
    """A cursor that is no recommendation of the same user, surface and query."""


def session(recommendations: DataFrame, cursors: DataFrame, surface: str, query: str | None = None) -> DataFrame:
    """(user, start, doc): what the sessions of cursors(user, start) have served, `start` being the id of their first
    recommendation(recommendation_id, user, doc, surface, query)."""
    same = recommendations.filter((F.col("surface") == surface) & F.col("query").eqNullSafe(F.lit(query)))
    known = cursors.join(same.select("user", F.col("recommendation_id").alias("start")), ["user", "start"], "left_anti")
    if known.head(1):
        raise CursorError("unknown cursor")
    return same.join(cursors, "user").filter(F.col("recommendation_id") >= F.col("start")).select("user", "start", "doc")


def serve(picks: DataFrame, recommendations: DataFrame, served: DataFrame | None, surface: str, query: str | None = None, cycle: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Pages as they are stored and shown: recommendation_id, user, position, slice, score, doc, title, reasons,
    breakdown, cursor and more.

    Ids go on from the stored ones, by user and slot.  position counts from the session's start; cursor, the id of its
    first recommendation, is null if the page is not full.  picks(user, slot, doc, slice, score, breakdown, reasons).
    """
    rows = written(picks, "page")
    keys = rows.select(F.struct("user", "slot").alias("key"))
    known = recommendations.select(F.col("recommendation_id").alias("id"), F.lit(None).cast(keys.schema["key"].dataType).alias("key"))
    ids = insert_absent(known, keys, "key", "id").filter("key IS NOT NULL").select("id", "key.user", "key.slot")
    before = rows.select("user").distinct()
    if served is not None:
        before = before.join(served.groupBy("user").agg(F.count("*").alias("before"), F.min("start").alias("start")), "user", "left")
    else:
        before = before.select("user", F.lit(0).alias("before"), F.lit(None).cast("long").alias("start"))
    mine = Window.partitionBy("user")  # a page
    numbered = rows.join(ids, ["user", "slot"]).join(before, "user").withColumn("n", F.count("*").over(mine)).withColumn("first", F.min("id").over(mine))
    place = F.row_number().over(mine.orderBy("slot")) - 1
    cursor = F.when(F.col("n") >= cfg.page_size, F.coalesce("start", "first"))
    more = [x for x in ("title",) if x in rows.columns]
    return numbered.select(
        F.col("id").alias("recommendation_id"), "user", (F.coalesce("before", F.lit(0)) + place).cast("long").alias("position"), "slice", "score", "doc", *more, "reasons", "breakdown", cursor.alias("cursor"),
        F.lit(surface).alias("surface"), F.lit(query).cast("string").alias("query"), F.lit(cycle).cast("long").alias("cycle"),
    )


def _explained(picks: DataFrame, rows: DataFrame, c: Context, adjacent: DataFrame, routes: DataFrame, search: bool, cfg: Config) -> DataFrame:
    found = evidence(picks.join(rows, ["user", "doc"]), c, adjacent, routes, cfg).withColumn("breakdown", breakdown(search, cfg))
    return ranking.reasons(ranking.reason_texts(found, cfg), cfg)


def feed(c: Context, now: Column, recommendations: DataFrame, cursors: DataFrame | None = None, cfg: Config = DEFAULT, max_hops: int = 2) -> DataFrame:
    """A feed page of every user of the context; cursors(user, start) continue sessions."""
    served = None if cursors is None else written(session(recommendations, cursors, "feed"), "served")
    found, adjacent, routes = sources(c, served, cfg, max_hops)
    found = written(found, "candidates")
    rows = written(scored(signals(found, c, now, cfg=cfg), c, cfg=cfg), "scored")
    picks = written(composed(found.join(rows.select("user", "doc", "domain", "score"), ["user", "doc"]), c, cfg), "picks")
    return serve(_explained(picks, rows, c, adjacent, routes, False, cfg), recommendations, served, "feed", cycle=c.cycle, cfg=cfg)


def search(c: Context, now: Column, text: str, vector: list[float], recommendations: DataFrame, cursors: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """A search page of every user of the context for one query."""
    from loomgraph.functions import vector as vectors

    served = None if cursors is None else written(session(recommendations, cursors, "search", text), "served")
    out = written(ruled_out(c, served, False, cfg), "ruled-out")
    asked = F.array(*(F.lit(float(x)) for x in vector))
    pairs = c.embeddings.join(out, "doc").select("doc", "out", vectors.cosine(F.col("embedding"), asked).alias("cosine")).filter("cosine IS NOT NULL")
    users = c.users.agg(F.collect_set("user").alias("users"))  # who ask
    near = candidates.top(pairs.crossJoin(F.broadcast(users)).select("doc", "cosine", F.explode(F.array_except("users", "out")).alias("user")), [F.desc("cosine"), F.col("doc")], cfg.per_source)
    found = written(near.select("user", "doc"), "candidates")
    rows = written(scored(signals(found, c, now, vector, cfg), c, True, cfg), "scored")
    picks = candidates.top(rows, [F.desc("score"), F.col("doc")], cfg.page_size).select("user", (F.col("pos") - 1).cast("int").alias("slot"), "doc", F.lit(ranking.MAIN).alias("slice"))
    nothing = (found.limit(0).select("user", "doc", *(F.lit(None).cast("long").alias(k) for k in ("shown", "interest"))), found.limit(0).select("user", "doc", F.lit(None).cast("array<string>").alias("path")))
    return serve(_explained(written(picks, "picks"), rows, c, *nothing, True, cfg), recommendations, served, "search", text, c.cycle, cfg)
