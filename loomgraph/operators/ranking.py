"""Scores, page composition and reasons."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.config import DEFAULT, Config
from loomgraph.functions import measures

COMPONENTS = ("interest", "ppr", "feedback", "recency", "hide", "query")
MAIN, SEMANTIC, GRAPH = "main", "adjacent_semantic", "adjacent_graph"
FALLBACK = {MAIN: (MAIN, SEMANTIC, GRAPH), SEMANTIC: (SEMANTIC, GRAPH, MAIN), GRAPH: (GRAPH, SEMANTIC, MAIN)}


def components(signals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """signals(user, doc, interest_cosine, topic_overlap, ppr, n_documents, liked_cosine, hidden_cosine, age_days,
    half_life_days, hidden_max, query_cosine) with one column c_<component> each.  Interest, ppr, feedback and query
    are min-max scaled within the user's candidates; recency and hide are not."""
    f = F.col
    raw = (
        signals.withColumn("_cos", F.greatest(f("interest_cosine"), F.lit(0.0))).withColumn("_ppr", measures.ppr_scale(f("ppr"), f("n_documents")))
        .withColumn("_fb", measures.feedback(f("liked_cosine"), f("hidden_cosine"))).withColumn("_q", F.greatest(F.coalesce("query_cosine", F.lit(0.0)), F.lit(0.0)))
    )
    b = cfg.topic_blend
    return raw.select(
        *signals.columns,
        ((1 - b) * measures.min_max(f("_cos"), "user") + b * measures.min_max(f("topic_overlap"), "user")).alias("c_interest"),
        measures.min_max(f("_ppr"), "user").alias("c_ppr"), measures.min_max(f("_fb"), "user").alias("c_feedback"),
        measures.recency(f("age_days"), f("half_life_days")).alias("c_recency"), measures.hide_penalty(f("hidden_max"), cfg.hide_threshold).alias("c_hide"),
        measures.min_max(f("_q"), "user").alias("c_query"),
    )


def total(rows: DataFrame, preset: str = "balanced", search: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """rows with k_<component> contributions and their score; hide counts against it, the query only in search."""
    weights = dict(zip(COMPONENTS, (*config.PRESETS[preset], cfg.query_weight if search else 0.0), strict=True))
    parts = {f"k_{c}": (-w if c == "hide" else w) * F.col(f"c_{c}") for c, w in weights.items()}
    return rows.withColumns(parts).withColumn("score", sum((F.col(k) for k in parts), F.lit(0.0)))


def slot_counts(size: int, exploration: float, semantic_share: float) -> tuple[int, int, int]:
    explore = math.floor(size * exploration + 0.5)
    semantic = math.floor(explore * semantic_share + 0.5)
    return size - explore, semantic, explore - semantic


def slot_plan(size: int = DEFAULT.page_size, exploration: float = DEFAULT.exploration, semantic_share: float = DEFAULT.semantic_share) -> list[str]:
    """The slice of each slot: exploration is spread evenly, its two kinds alternate, the larger one first."""
    _, semantic, graph = slot_counts(size, exploration, semantic_share)
    n = semantic + graph
    larger, smaller = ((SEMANTIC, semantic), (GRAPH, graph)) if semantic >= graph else ((GRAPH, graph), (SEMANTIC, semantic))
    kinds = [x for k in range(larger[1]) for x in [larger[0], smaller[0]][: 2 if k < smaller[1] else 1]]
    at = {(2 * i + 1) * size // (2 * n): kind for i, kind in enumerate(kinds)}
    return [at.get(k, MAIN) for k in range(size)]


def slot_plan_frame(spark: SparkSession, size: int, exploration: float, semantic_share: float) -> DataFrame:
    plan = F.array(*(F.lit(s) for s in slot_plan(size, exploration, semantic_share)))
    return spark.range(1).select(F.posexplode(plan).alias("slot", "slice"))


def fill(plan: list[str], queues: dict[str, list[tuple[int, object]]], per_domain: int) -> list[tuple[int, object, str]]:
    """(slot, document, slice): first all slots under the domain cap, falling back to other slices, then the empty
    ones without it.  Queues hold (document, domain), best first."""
    used, load, filled = set(), {}, {}
    for cap in (per_domain, None):
        for slot, wanted in enumerate(plan):
            if slot in filled:
                continue
            fits = ((doc, domain, kind) for kind in FALLBACK[wanted] for doc, domain in queues.get(kind, []) if doc not in used and (cap is None or load.get(domain, 0) < cap))
            if (pick := next(fits, None)) is not None:
                doc, domain, kind = pick
                used.add(doc)
                load[domain] = load.get(domain, 0) + 1
                filled[slot] = (slot, doc, kind)
    return [filled[s] for s in sorted(filled)]


def compose(candidates: DataFrame, plan: list[str], per_domain: int = DEFAULT.per_domain) -> DataFrame:
    """(user, slot, doc, slice): one page per user from candidates(user, doc, domain, slice, score).

    Greedy and sequential, so one group per user; candidates per user are bounded by the sources' limits.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True])
        queues = {k: list(zip(g["doc"], g["domain"], strict=True)) for k, g in pdf.groupby("slice")}
        rows = [(key[0], *pick) for pick in fill(plan, queues, per_domain)]
        return pd.DataFrame(rows, columns=["user", "slot", "doc", "slice"])

    return candidates.select("user", "doc", "domain", "slice", "score").groupBy("user").applyInPandas(one, "user long, slot int, doc long, slice string")


def unserved(candidates: DataFrame, served: DataFrame) -> DataFrame:
    """Candidates that the session has not served; served(user, doc)."""
    return candidates.join(served.select("user", "doc").distinct(), ["user", "doc"], "left_anti")


def reason_texts(evidence: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """evidence(pinned_domain, trusted_linkers, trusted_count, other_linkers, interest_topics, liked_title, age_days,
    published, exploration) with one text per kind of reason."""
    f, examples = F.col, (lambda c: F.array_join(F.slice(c, 1, cfg.examples), ", "))
    sources = (
        F.when(f("pinned_domain").isNotNull(), F.concat(F.lit("From "), "pinned_domain", F.lit(", a site you pinned")))
        .when((f("trusted_count") == 1) & (F.size("trusted_linkers") > 0), F.concat(F.lit("Linked from "), F.get("trusted_linkers", F.lit(0)), F.lit(", a site you trust")))
        .when(f("trusted_count") > 1, F.concat(F.lit("Linked from "), f("trusted_count").cast("string"), F.lit(" sites you trust (e.g. "), examples("trusted_linkers"), F.lit(")")))
        .when(F.size("other_linkers") > 0, F.concat(F.lit("Linked from sites your sources link to (e.g. "), examples("other_linkers"), F.lit(")")))
        .otherwise("Close to your sources in the link graph")
    )
    shown = F.least(F.size("interest_topics"), F.lit(cfg.examples))
    interest = F.when(shown < 1, "Close to your interests").otherwise(F.concat(F.when(shown == 1, "Matches your interest: ").otherwise("Matches your interests: "), examples("interest_topics")))
    liked = F.when(F.coalesce("liked_title", F.lit("")) == "", "Similar to things you liked").otherwise(F.concat(F.lit("Similar to “"), "liked_title", F.lit("”, which you liked")))
    days, verb = F.floor("age_days"), F.when(f("published"), "Published").otherwise("Found")
    recency = F.concat(verb, F.when(days < 1, " today").when(days == 1, " yesterday").otherwise(F.concat(F.lit(" "), days.cast("string"), F.lit(" days ago"))))
    return evidence.withColumns({"t_sources": sources, "t_interest": interest, "t_liked": liked, "t_recency": recency})


def reasons(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """rows with `reasons`: an exploration text first, then component texts by contribution (ties in component order)
    as long as they reach the minimum, three in all; hide gives none."""
    texts = {"interest": "t_interest", "ppr": "t_sources", "feedback": "t_liked", "recency": "t_recency"}
    listed = F.array(*(F.struct((-F.col(f"k_{c}")).alias("k"), F.lit(n).alias("n"), F.lit("sources" if c == "ppr" else "liked" if c == "feedback" else c).alias("kind"), F.col(t).alias("text")) for n, (c, t) in enumerate(texts.items())))
    good = F.filter(F.array_sort(listed), lambda s: -s["k"] >= cfg.min_contribution)
    plain = F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text")))
    first = F.when(F.col("exploration").isNotNull(), F.array(F.struct(F.lit("exploration").alias("kind"), F.col("exploration").alias("text")))).otherwise(F.slice(plain, 1, 0))
    return rows.withColumn("reasons", F.slice(F.concat(first, plain), 1, cfg.max_reasons))


def breakdown(rows: DataFrame) -> Column:
    """JSON of the components' values and contributions, as stored with a recommendation."""
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"c_{c}").alias("value"), F.col(f"k_{c}").alias("contribution")) for c in COMPONENTS))
    return F.to_json(F.struct(F.lit(1).alias("version"), parts.alias("components")))
