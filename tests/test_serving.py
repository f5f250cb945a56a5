"""A page from raw tables to stored explanations, against a plain computation."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import ranking, serving

NOW = datetime(2024, 5, 1)
CFG = config.Config(per_source=6, page_size=8, band_skip=6, band_take=5, shown_limit=1)
TOPICS = [(1, None, "root"), (2, 1, "left"), (3, 1, "right"), (4, 2, "leaf"), (5, 3, "far")]
PARENT = {t: p for t, p, _ in TOPICS}
NAME = {t: n for t, _, n in TOPICS}


def world(seed):
    r, n = random.Random(seed), 60
    vec = lambda: [r.gauss(0, 1) for _ in range(4)]
    w = {"docs": [], "emb": {}, "tags": [], "links": set(), "events": [], "ppr": {}, "topic_vectors": {t: vec() for t, _, _ in TOPICS}}
    for d in range(n):
        published = NOW - timedelta(days=r.randint(0, 40), hours=d) if d % 3 else None
        w["docs"].append((d, f"s{d % 9}", r.choice(["post", "paper", "page"]), published, NOW - timedelta(days=r.randint(0, 9), hours=d), f"T{d}" if d % 5 else None))
        if d % 11:
            w["emb"][d] = vec()
        w["tags"] += [(d, t, round(r.uniform(0.2, 1), 3)) for t in r.sample([1, 2, 3, 4, 5], r.randint(0, 2))]
    for _ in range(150):
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            w["links"].add((a, b))
    w["users"] = {1: ("balanced", 0.5, 0.5, ["post", "paper"]), 2: ("fresh", 0.25, 1.0, ["post", "paper", "page"]), 3: ("trust_my_sources", 0.0, 0.5, ["post"])}
    w["interests"] = [(1, 4, 2.0), (1, 2, 1.0), (2, 5, 1.0)]
    w["pins"] = [(1, "s0"), (1, "s4"), (2, "s3"), (3, "s8")]
    for u in w["users"]:
        w["ppr"] |= {(u, d): r.random() / 50 for d in r.sample(range(n), 25)}
    kinds = ["like", "hide", "click", "impression", "impression", "like"]
    for e in range(70):
        d = r.randrange(n)
        w["events"].append((e, r.choice([1, 2, 3, 9]), r.choice(kinds), d, f"s{d % 9}", r.choice([None, 1, 2, 3]), NOW - timedelta(days=r.randint(0, 30), minutes=e)))
    w["events"].append((99, 1, "block_domain", 5, "s5", None, NOW))
    return w


def frames(spark, w):
    preset = {u: config.PRESETS[p] for u, (p, *_) in w["users"].items()}
    users = [(u, *map(float, preset[u]), e, s, t) for u, (_, e, s, t) in w["users"].items()]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    return serving.context(
        F.lit(NOW), of(list(w["topic_vectors"].items()), "topic long, embedding array<double>"), of([(3,), (7,)], "cycle long"), CFG,
        users=of(users, "user long, w_interest double, w_ppr double, w_feedback double, w_recency double, w_hide double, exploration double, semantic_share double, types array<string>"),
        documents=of(w["docs"], "doc long, domain string, type string, published timestamp, created timestamp, title string"), embeddings=of(list(w["emb"].items()), "doc long, embedding array<double>"),
        topics=of(TOPICS, "topic long, parent long, name string"), interests=of(w["interests"], "user long, topic long, weight double"), tags=of(w["tags"], "doc long, topic long, score double"),
        pins=of(w["pins"], "user long, domain string"), ppr=of([(*k, x) for k, x in w["ppr"].items()], "user long, doc long, ppr double"), links=of(sorted(w["links"]), "src long, dst long"),
        events=of(w["events"], "event_id long, user long, kind string, doc long, domain string, recommendation_id long, at timestamp"),
    )


RECS = "recommendation_id long, user long, doc long, surface string, query string"


class Brute:
    """The same page by loops over one user's documents."""

    def __init__(self, w, user):
        self.w, self.u = w, user
        self.docs = {d[0]: d for d in w["docs"]}
        self.domain = {d: x[1] for d, x in self.docs.items()}
        self.recent = {d: x[3] or x[4] for d, x in self.docs.items()}
        self.pins = {s for u, s in w["pins"] if u == user}
        self.weights = dict(zip(("interest", "ppr", "feedback", "recency", "hide"), config.PRESETS[w["users"][user][0]], strict=True))
        last = {}
        for e, u, k, d, _, _, at in w["events"]:
            if u == user and k in ("like", "hide") and (d not in last or (at, e) > last[d][:2]):
                last[d] = (at, e, k)
        self.liked, self.hidden = ({d: at for d, (at, _, k) in last.items() if k == kind} for kind in ("like", "hide"))
        own = {t: x for u, t, x in w["interests"] if u == user}
        self.cover = {}
        for t in PARENT:
            up = t
            while up is not None and up not in own:
                up = PARENT[up]
            if up is not None:
                self.cover[t] = up
        self.own = own
        self.vectors = {"interest": self.mean([(w["topic_vectors"][t], x) for t, x in own.items()])}
        for kind, given in (("liked", self.liked), ("hidden", self.hidden)):
            self.vectors[kind] = self.mean([(w["emb"][d], 0.5 ** ((NOW - at).total_seconds() / 86400 / 90)) for d, at in given.items() if d in w["emb"]])

    @staticmethod
    def mean(rows):
        if not rows:
            return None
        v = sum(np.array(x) * k for x, k in rows)
        return v / np.linalg.norm(v)

    def cos(self, a, b):
        return None if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    def ok(self, d, served, seen):
        mine = [e for e in self.w["events"] if e[1] == self.u]
        bad = {e[3] for e in mine if e[2] in (("hide", "like", "click") if seen else ("hide",))} | set(served)
        shown = {}
        for e in mine:
            if e[2] == "impression":
                shown.setdefault(e[3], set()).add(-e[0] if e[5] is None else e[5])
        if seen:
            bad |= {x for x, s in shown.items() if len(s) > CFG.shown_limit}
        blocked = {e[4] for e in mine if e[2] == "block_domain"}
        return d not in bad and self.domain[d] not in blocked and self.docs[d][2] in self.w["users"][self.u][3]

    def nearest(self, vector, free, skip, take):
        rows = sorted((-c, d) for d in free if (c := self.cos(self.w["emb"].get(d), vector)) is not None)
        return [d for _, d in rows[skip : skip + take]]

    def beside(self):
        """Topic -> (shown, interest) next to the interests."""
        out = {}
        for t in sorted(self.own, key=lambda t: (-self.own[t], t)):
            if PARENT[t] is None:
                continue
            near = [(PARENT[t], PARENT[t])]
            for s in sorted(x for x in PARENT if PARENT[x] == PARENT[t] and x != t):
                near += [(s, x) for x in PARENT if self.below(x, s)]
            for shown, x in near:
                if x not in self.cover:
                    out.setdefault(x, (shown, t))
        return out

    @staticmethod
    def below(x, top):
        while x is not None and x != top:
            x = PARENT[x]
        return x == top

    def sources(self, served=()):
        w, n = self.w, CFG.per_source
        free = [d for d in self.docs if self.ok(d, served, True)]
        ppr = {d: x for (u, d), x in w["ppr"].items() if u == self.u}
        main = sorted((d for d in free if d in ppr), key=lambda d: (-ppr[d], d))[:n]
        main += self.nearest(self.vectors["interest"], free, 0, n) + self.nearest(self.vectors["liked"], free, 0, n)
        newest = lambda d: (-self.recent[d].timestamp(), d)
        main += sorted((d for d in free if self.domain[d] in self.pins), key=newest)[:n]
        band = self.nearest(self.vectors["interest"], free, CFG.band_skip, CFG.band_take)
        touched, beside = {d for d, t, _ in w["tags"] if t in self.cover}, self.beside()
        rows = sorted((-s, *newest(d), t, d) for d, t, s in w["tags"] if t in beside and d in free and d not in touched)[: 3 * n]
        adjacent = {}
        for *_, t, d in rows:
            if d not in adjacent and len(adjacent) < n:
                adjacent[d] = beside[t]
        reach, layer = {}, {s: [] for s in self.pins}
        for _ in range(2):
            following = {}
            for a in sorted(layer):
                for x, y in w["links"]:
                    if self.domain[x] == a and self.domain[y] != a and self.domain[y] not in self.pins and self.domain[y] not in reach and self.domain[y] not in following:
                        following[self.domain[y]] = [*layer[a], a]
            reach |= following
            layer = following
        tagged = {d for d, _, _ in w["tags"]}
        graph = sorted((d for d in free if d in tagged and d not in touched and self.domain[d] in reach), key=lambda d: (-ppr.get(d, 0), *newest(d)))[:n]
        return main, band, adjacent, {d: reach[self.domain[d]] for d in graph}

    def score(self, docs, query=None):
        w, docs = self.w, sorted(set(docs))
        emb = [w["emb"].get(d) for d in docs]
        raw = {k: [self.cos(e, v) or 0.0 for e in emb] for k, v in self.vectors.items()}
        tags = {d: [(t, s) for x, t, s in w["tags"] if x == d] for d in docs}
        top = max(self.own.values(), default=1)
        overlap = [sum(s * self.own[self.cover[t]] for t, s in tags[d] if t in self.cover) / (sum(s for _, s in tags[d]) * top) if tags[d] else 0.0 for d in docs]
        hide = [max((self.cos(e, w["emb"][h]) for h in self.hidden if h in w["emb"] and e is not None), default=0.0) for e in emb]

        def scaled(xs):
            lo, hi = min(xs), max(xs)
            return [(x - lo) / (hi - lo) if hi > lo else float(x > 0) for x in xs]

        a, b = scaled([max(x, 0) for x in raw["interest"]]), scaled(overlap)
        c = {"interest": [(x + y) / 2 for x, y in zip(a, b, strict=True)], "ppr": scaled([math.log1p(w["ppr"].get((self.u, d), 0) * len(self.docs)) for d in docs])}
        age = [max((NOW - self.recent[d]).total_seconds() / 86400, 0) for d in docs]
        c["recency"] = [0.5 ** (x / (90 if self.docs[d][2] in serving.EVERGREEN else 7)) for x, d in zip(age, docs, strict=True)]
        return docs, raw, overlap, hide, c


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_equals_brute_force(spark, seed):
    w = world(seed)
    c = frames(spark, w)
    none = spark.createDataFrame([(500, 9, 0, "feed", None)], RECS)
    page = serving.feed(c, F.lit(NOW), none, cfg=CFG)
    rows = sorted(page.collect(), key=lambda r: (r.user, r.position))
    assert [r.recommendation_id for r in rows] == list(range(501, 501 + len(rows)))
    found, adjacent, routes = (x.collect() for x in serving.sources(c, None, CFG))
    scores = {(r.user, r.doc): r.score for r in serving.scored(serving.signals(spark.createDataFrame(found).select("user", "doc"), c, F.lit(NOW), cfg=CFG), c, cfg=CFG).collect()}
    for u in w["users"]:
        b = Brute(w, u)
        main, band, near, graph = b.sources()
        want = {(d, ranking.MAIN) for d in main} | {(d, ranking.SEMANTIC) for d in [*band, *near]} | {(d, ranking.GRAPH) for d in graph}
        assert {(r.doc, r["slice"]) for r in found if r.user == u} == want
        assert {r.doc: (r.shown, r.interest) for r in adjacent if r.user == u} == near
        assert {r.doc: r.path for r in routes if r.user == u} == graph
        _, e, s, _ = w["users"][u]
        order = lambda docs: [(d, b.domain[d]) for d in sorted(set(docs), key=lambda d: (-scores[u, d], d))]  # noqa: B023, E731
        plan = ranking.slot_plan(CFG.page_size, e, s)
        picks = ranking.fill(plan, {ranking.MAIN: order(main), ranking.SEMANTIC: order([*band, *near]), ranking.GRAPH: order(graph)}, CFG.per_domain)
        mine = [r for r in rows if r.user == u]
        assert [(r.doc, r["slice"]) for r in mine] == [(d, k) for _, d, k in picks] and [r.position for r in mine] == list(range(len(mine)))
        docs, raw, overlap, hide, comp = b.score({r.doc for r in found if r.user == u})
        for r in mine:
            i, stored = docs.index(r.doc), json.loads(r.breakdown)
            parts = {x["name"]: x for x in stored["components"]}
            assert list(parts) == ["interest", "ppr", "feedback", "recency", "hide"] and abs(sum(x["contribution"] for x in parts.values()) - r.score) < 1e-9
            assert parts["interest"]["inputs"] == pytest.approx({"cosine": raw["interest"][i], "topic_overlap": overlap[i]}) and parts["feedback"]["inputs"] == pytest.approx({"liked_cosine": raw["liked"][i], "hidden_cosine": raw["hidden"][i]})
            assert parts["hide"]["inputs"] == pytest.approx({"max_hidden_similarity": hide[i], "threshold": 0.75}) and {k: x["weight"] for k, x in parts.items()} == b.weights
            assert parts["interest"]["value"] == pytest.approx(comp["interest"][i]) and parts["recency"]["value"] == pytest.approx(comp["recency"][i])
            e = stored["evidence"]
            hosts = {}
            for x, y in w["links"]:
                if y == r.doc and b.domain[x] != b.domain[y]:
                    hosts[b.domain[x]] = hosts.get(b.domain[x], 0) + w["ppr"].get((u, x), 0)
            ranked = sorted(hosts, key=lambda h: (-round(hosts[h], 12), h))
            trusted, other = [h for h in ranked if h in b.pins], [h for h in ranked if h not in b.pins]
            assert (e["trusted_linkers"], e["trusted_count"], e["other_linkers"], e["other_count"]) == (trusted[:2], len(trusted), other[:2], len(other))
            assert e.get("pinned_domain") == (b.domain[r.doc] if b.domain[r.doc] in b.pins else None)
            strength = {}
            for d, t, x in w["tags"]:
                if d == r.doc and t in b.cover:
                    strength[b.cover[t]] = strength.get(b.cover[t], 0) + x * b.own[b.cover[t]]
            assert e["interest_topics"] == [NAME[t] for t in sorted(strength, key=lambda t: (-round(strength[t], 12), t))]
            likes = sorted((-x, d) for d in b.liked if (x := b.cos(w["emb"].get(r.doc), w["emb"].get(d))) is not None)
            assert e.get("liked_doc") == (likes[0][1] if likes else None)
            text = e.get("exploration")
            if r["slice"] == ranking.MAIN:
                assert text is None
            elif r["slice"] == ranking.SEMANTIC:
                assert text == (f"Exploring: {NAME[near[r.doc][0]]}, next to your interest {NAME[near[r.doc][1]]}" if r.doc in near else "Exploring: near your interests, past the closest matches")
            else:
                best = min(((-x, t) for d, t, x in w["tags"] if d == r.doc), default=None)
                path = graph[r.doc]
                assert text == f"Exploring: {NAME[best[1]]}, " + (f"from a site {path[0]} links to" if len(path) == 1 else f"{len(path)} links away from {path[0]}")
            assert (r.reasons[0].text == text) if text else all(x.kind != "exploration" for x in r.reasons)
            assert len(r.reasons) <= 3 and r.cycle == 7
        assert {r.cursor for r in mine} == {mine[0].recommendation_id if len(mine) == CFG.page_size else None}
    stored = page.select("recommendation_id", "user", "doc", "breakdown")
    assert {(r.recommendation_id, str(r.reasons)) for r in serving.why(stored, CFG).collect()} == {(r.recommendation_id, str(r.reasons)) for r in rows}
    assert serving.why(stored.withColumn("breakdown", F.lit("{")), CFG).count() == 0


def test_the_next_page_goes_on(spark):
    w = world(3)
    c = frames(spark, w)
    none = spark.createDataFrame([], RECS)
    first = serving.feed(c, F.lit(NOW), none, cfg=CFG)
    rows = first.collect()
    stored = spark.createDataFrame([(r.recommendation_id, r.user, r.doc, r.surface, r.query) for r in rows], RECS)
    cursors = spark.createDataFrame(sorted({(r.user, r.cursor) for r in rows if r.cursor is not None}), "user long, start long")
    again = serving.feed(c, F.lit(NOW), stored, cursors, CFG).collect()
    seen = {(r.user, r.doc) for r in rows}
    assert not seen & {(r.user, r.doc) for r in again if r.user in {x.user for x in rows if x.cursor is not None}}
    for u, start in ((r.user, r.start) for r in cursors.collect()):
        mine = sorted((r for r in again if r.user == u), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(8, 8 + len(mine))) and {r.cursor for r in mine} <= {start, None}
    assert min(r.recommendation_id for r in again) == max(r.recommendation_id for r in rows) + 1
    with pytest.raises(serving.CursorError):
        serving.feed(c, F.lit(NOW), stored, spark.createDataFrame([(1, 10**6)], "user long, start long"), CFG)


def test_search_page(spark):
    w = world(4)
    c, query = frames(spark, w), [1.0, 0.5, 0.0, -1.0]
    rows = serving.search(c, F.lit(NOW), "words", query, spark.createDataFrame([], RECS), cfg=CFG).collect()
    for u in w["users"]:
        b = Brute(w, u)
        near = b.nearest(np.array(query), [d for d in b.docs if b.ok(d, (), False)], 0, CFG.per_source)
        mine = sorted((r for r in rows if r.user == u), key=lambda r: r.position)
        assert {r.doc for r in mine} == set(near) and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        parts = {x["name"]: x for x in json.loads(mine[0].breakdown)["components"]}
        assert parts["query"]["weight"] == 5.0 and parts["query"]["inputs"]["cosine"] == pytest.approx(b.cos(w["emb"][mine[0].doc], np.array(query)))


def test_a_context_keeps_its_users_events_alone(spark):
    w = world(1)
    kept = {r.event_id for r in frames(spark, w).events.collect()}
    assert kept == {e[0] for e in w["events"] if e[1] in w["users"]} and len(kept) < len(w["events"])
