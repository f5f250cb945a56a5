"""Language ID, HTML extraction, neighbours, chat, URL rules, BPE and the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import ann, bpe, chat, common, html_crf, langid, url_rules

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


# ---- language ID

@pytest.fixture(scope="module")
def medium(spark):
    return common.table(spark, "/root/testdata/sf0.01", "documents")


def test_languages_held_out(spark, medium):
    found = langid.op4_output_codes(spark, "/root/testdata/sf0.01").join(medium.select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98 and found.filter("score < 0 OR score > 1").count() == 0 and found.count() == medium.count()


def test_language_edges(spark, medium):
    model = langid.fit(medium)
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "ß"), (5, "the and of that with " * 30_000), (5, "the and of that with " * 30_000), (None, "the and of that")]
    got = langid.identify(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string"), model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert {got[4].lang_pred, got[5].lang_pred} == {"en"} and got[4].score == got[5].score and got[0].lang == "z"
    assert langid.identify(medium.limit(0).select("doc_id", "text"), model).count() == 0
    clash = spark.createDataFrame([(1, "the and of that", "mine", "x")], "doc_id long, text string, score string, ambiguous string")
    assert langid.identify(clash, model).columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"] and langid.identify(clash, model).first().lang_pred == "en"
    none = spark.createDataFrame([(0, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(none) is None and langid.identify(none, None).first().lang_pred == "und"
    one = langid.fit(spark.createDataFrame([(k, "some text", "xx") for k in range(9)], "doc_id long, text string, lang string"))
    assert langid.identify(none, one).first().lang_pred == "xx"


def test_repeated_and_null_ids_do_not_multiply_in_training(spark, medium):
    text = "the and of that with which is a plain text"
    many = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", f"'{text}' AS text", "'en' AS lang")
    model = langid.fit(medium.select("doc_id", "text", "lang").union(many))
    plain = langid.fit(medium.select("doc_id", "text", "lang").union(many.limit(1)))
    assert model.languages == plain.languages and np.isfinite(model.weights).all()
    chosen = langid.fit(medium.select("doc_id", "text", "lang").repartition(13))
    assert np.allclose(chosen.weights, langid.fit(medium).weights, atol=1e-4)


def test_margins_do_not_depend_on_neighbours(medium):
    model = langid.fit(medium)
    texts = [langid.prepared(t) for t in ("ab", "the cat", "une maison à la mer", "x" * 10, "")]
    together, alone = model.margins(texts)[0], np.concatenate([model.margins([t])[0] for t in texts])
    assert np.allclose(together, alone)
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min((a != b).sum() for a, b in itertools.combinations(code, 2)) == 4
    assert langid.codewords(20).shape[0] == 20


def test_decoding_equals_brute_force():
    """Margins and decoding against loops over n-grams, bits and codewords."""
    import math

    r = np.random.RandomState(2)
    code = langid.codewords(5)
    weights = np.concatenate([r.standard_normal((langid.BINS, code.shape[1])), np.zeros((1, code.shape[1]))]).astype(np.float32)
    model = langid.Model(list("abcde"), code, weights, r.random(code.shape[1]))
    texts = ["some words and others", "abc", "ab", "ein längerer text " * 9]
    got = model.decode(*model.margins([langid.prepared(t) for t in texts]))
    for text, lang, score in zip(texts, got[0], got[1], strict=True):
        raw = langid.prepared(text)
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        bins = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % (1 << 32)) >> 16 for g in grams]
        margin = [sum(float(weights[b, k]) for b in bins) / max(len(bins), 1) for k in range(code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * math.sqrt(max(len(bins), 1)) * int(c))) for t, m, c in zip(model.trust, margin, word, strict=True)) for word in code]
        best = min(range(5), key=loss.__getitem__)
        assert lang == "abcde"[best] and abs(score - 1 / sum(math.exp(min(loss) - x) for x in loss)) < 1e-6


def test_training_sums_equal_brute_force(spark):
    texts = [("x", "alpha beta gamma"), ("x", "alpha alpha"), ("y", "omega psi chi"), ("z", "mu nu xi mu")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts * 3)], "doc_id long, text string, lang string")
    train = docs.filter(~langid.held_out()).collect()
    model = langid.fit(docs)
    assert model.languages == sorted({r.lang for r in train})
    mean = {}
    for lang in model.languages:
        rows = [r.text for r in train if r.lang == lang]
        for t in rows:
            bins = langid.bins_of(np.frombuffer(t.encode(), np.uint8))
            for b in bins:
                mean[lang, int(b)] = mean.get((lang, int(b)), 0) + 1 / len(bins) / len(rows)
    for b in {b for _, b in mean}:
        for k in range(model.code.shape[1]):
            yes, no = ([mean.get((x, b), 0) for x, c in zip(model.languages, model.code[:, k], strict=True) if c == sign] for sign in (1, -1))
            assert abs(model.weights[b, k] - np.log((sum(yes) / len(yes) + 1e-6) / (sum(no) / len(no) + 1e-6))) < 1e-4


# ---- HTML

def blocks_right(crf, pages):
    right = total = 0
    for markup, labels in pages:
        page = html_crf.blocks(markup)
        assert len(page) == len(labels)
        right += sum(a == b for a, b in zip(crf.decode(html_crf.features(page)), labels, strict=True))
        total += len(labels)
    return right / total


def test_main_text_of_held_out_pages():
    assert blocks_right(html_crf.trained(), html_crf.labelled_pages(100, seed=77)) > 0.985


@pytest.mark.parametrize("naming", ["opaque", "none"])
def test_main_text_of_a_held_out_family(naming):
    """Trained on pages whose class names tell something, tried on pages where they do not."""
    others = tuple(x for x in html_crf.NAMINGS if x != naming)
    crf = html_crf.trained(html_crf.labelled_pages(300, seed=5, namings=others))
    assert blocks_right(crf, html_crf.labelled_pages(100, seed=78, namings=(naming,))) > 0.97


def test_forward_backward_equals_enumeration():
    r = np.random.RandomState(4)
    e, transition, start = r.standard_normal((3, 5, 2)), r.standard_normal((2, 2)), r.standard_normal(2)
    mask = np.arange(5) < np.array([[5], [1], [3]])
    total, single, double = html_crf.Crf.expectations(e, transition, start, mask)
    for k in range(3):
        n = int(mask[k].sum())
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([start[y[0]] + sum(e[k, t, v] for t, v in enumerate(y)) + sum(transition[a, b] for a, b in itertools.pairwise(y)) for y in paths])
        assert np.isclose(total[k], np.log(weight.sum()))
        for t in range(5):
            for v in (0, 1):
                assert np.isclose(single[k, t, v], sum(w for y, w in zip(paths, weight, strict=True) if t < n and y[t] == v) / weight.sum())
        for t, a, b in itertools.product(range(4), (0, 1), (0, 1)):
            assert np.isclose(double[k, t, a, b], sum(w for y, w in zip(paths, weight, strict=True) if t + 1 < n and y[t] == a and y[t + 1] == b) / weight.sum())


@pytest.mark.parametrize("markup", ["<p>" + "<b>x</b> y" * 60_000, "<font><i>z" * 60_000, "<div>" * 60_000 + "x", "<ul>" + "<li>a<i>b" * 30_000, "<a href='x>y" * 30_000, "</b>" * 100_000, "<table>" + "<tr><td>q" * 30_000])
def test_parsing_is_linear(markup):
    import time

    began = time.process_time()
    html_crf.blocks(markup)
    assert time.process_time() - began < 12  # minutes, if a step walked over the open elements


def test_nothing_is_lost_behind_an_unclosed_element():
    crf = html_crf.trained()
    for tag in ("svg", "object", "video", "audio", "canvas", "math", "iframe", "noscript", "template"):
        assert html_crf.main_text(f"<article><p>Before it all.</p><{tag}><p>After it all.</p>", crf) == "Before it all.\n\nAfter it all.", tag
    assert html_crf.main_text("<article><p>One <object><object>two</object> three</object> four.</p></article>", crf) == "One two three four."
    assert html_crf.main_text("<article><p>x is <math><mi>a</mi></math> here.</p><iframe>no</iframe><p>The end.</p></article>", crf) == "x is a here.\n\nThe end."


def test_comments_without_telling_names():
    crf, article = html_crf.trained(), "<h1>A title of it</h1><p>The article text of this page is here, and it goes on for a while.</p><p>It has two paragraphs in all, this being the last.</p>"
    want = "A title of it\n\nThe article text of this page is here, and it goes on for a while.\n\nIt has two paragraphs in all, this being the last."
    assert html_crf.main_text(f"<article>{article}</article><div class='ugc'><p>I liked this one a lot, thanks for it.</p></div>", crf) == want
    assert html_crf.main_text(f"<div><a href=/>Home</a></div><div>{article}</div><div><h3>Comments</h3><div><p>Ann says: I liked this one a lot.</p></div></div>", crf) == want


def test_viterbi_equals_brute_force():
    crf = html_crf.trained()
    page = html_crf.features(html_crf.blocks(html_crf.labelled_pages(3, seed=5)[2][0]))[:9]
    e = crf.scores(page)

    def score(y):
        return crf.start[y[0]] + sum(e[t][k] for t, k in enumerate(y)) + sum(crf.transition[a][b] for a, b in itertools.pairwise(y))

    best = max(itertools.product((0, 1), repeat=len(page)), key=score)
    assert abs(score(crf.decode(page)) - score(best)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<div class="ad">Buy this now, it is cheap and good.</div><article><h1>Caf&eacute;  &amp;
 tea</h1><p><b>First line &lt;here&gt;.<br>Still first.<p>Second paragraph, unclosed<ul><li>item one<li>item two</ul></article>
<aside class=sidebar><p>Related stories for you.</p></aside><form><label>Name</label><input name=q><button>Send</button></form>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice article, I liked it.</p></div></section><footer>&copy; 2024 Site</footer>"""


def test_one_page():
    assert html_crf.main_text(PAGE, html_crf.trained()) == "Café & tea\n\nFirst line <here>. Still first.\n\nSecond paragraph, unclosed\n\nitem one\n\nitem two"


def test_pages_edge_cases(spark):
    odd = [None, "", "   ", "<", "<p", "<!-- x", "plain text", "<script>x", "</p></div>", "<a href='x>y", "<p>" * 2000 + "deep", "<div>" * 3000 + "x" * 100_000]
    pages = spark.createDataFrame([(k, "u", h, "t") for k, h in enumerate(odd)] + [(1, "u", "<article><p>Twice it is.</p></article>", "t")] * 2, "page_id long, url string, html string, text string")
    got = html_crf.extract(pages).collect()
    assert len(got) == len(odd) + 2 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got[:3]] == [""] * 3 and got[-1].text == got[-2].text == "Twice it is."
    assert html_crf.extract(pages.limit(0)).count() == 0


# ---- neighbours

def brute(rows, k, every):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v))}
    out = {}
    for q in sorted(ok):
        if q % every == 0:
            s = [(-(ok[q] @ ok[i]) / np.linalg.norm(ok[q]) / np.linalg.norm(ok[i]), i) for i in ok if i != q]
            out[q] = [(i, -c) for c, i in sorted((round(c, 12), i) for c, i in s)[:k]]
    return out


def test_recall(spark):
    vectors = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 5, 50)
    got = {}
    for r in ann.op5_dimension_scan(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_recall_on_many_vectors(spark):
    """60,000 vectors of 32 dimensions, half scattered and half in clusters; recall of every query against brute force."""
    r = np.random.RandomState(7)
    centres = r.standard_normal((300, 32))
    x = np.concatenate([r.standard_normal((30_000, 32)), centres[r.randint(0, 300, 30_000)] + 0.3 * r.standard_normal((30_000, 32))]).astype(np.float32)
    x = x[r.permutation(len(x))]
    import pyarrow as pa

    rows = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32()))})
    found = ann.search(spark.createDataFrame(rows), every=300).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q, own in found.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -2
        want = set(np.lexsort((np.arange(len(x)), -score))[:5].tolist())
        assert len(own) == 5 and np.allclose(own.sort_values("rank").score, score[own.sort_values("rank").vec_id])
        hits, total = hits + len(want & set(own.vec_id)), total + 5
    assert total == 5 * 200 and hits / total >= 0.9


def test_scan_keeps_what_brute_force_keeps():
    r = np.random.RandomState(1)
    lists = ann.unit(r.standard_normal((3000, 64)))
    for q in ann.unit(r.standard_normal((20, 64))):
        want = np.argsort(((lists - q) ** 2).sum(1))[:6]
        for worst in (np.inf, ((lists[want[-1]] - q) ** 2).sum()):
            kept = ann.scan(q, lists, 6, worst)
            assert len(set(want) & set(kept)) >= 5 and len(kept) < len(lists) / 2


def test_neighbours_with_ties_and_broken_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(k, same) for k in range(20)] + [(20, [2.0, 4.0, 4.0]), (50, [0.0, 1.0, 0.0]), (51, None), (52, []), (53, [0.0, 0.0, 0.0]), (54, [1.0, None, 1.0]), (55, [float("nan"), 1.0, 1.0]), (56, [float("inf"), 1.0, 1.0]), (57, [1.0]), (100, same)]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    lone = [(150, [1.0, 1.0, 0.0, 0.0]), (151, [1.0, 0.0, 0.0, 0.0]), (152, [0.0, 0.0, 1.0, 0.0])]  # of another dimension
    df = df.union(spark.createDataFrame([(*r, 0, 0.0) for r in lone], df.schema))
    want = brute([r for r in rows if r[0] != 57], 5, 50) | brute(lone, 5, 50)
    got = {}
    for r in ann.search(df, probe_share=1.0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in g] for q, g in want.items()}
    few = ann.search(df.filter("vec_id IN (0, 50)")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 50), (50, 1, 0)]
    assert ann.search(df.limit(0)).count() == 0


# ---- chat

def test_segmented_viterbi_equals_whole(spark, monkeypatch):
    conversations = common.table(spark, "/root/testdata/sf0.01", "conversations")
    hmm = chat.train(conversations)
    r = random.Random(3)
    long = [(1, t, "w " * r.randint(0, 300) + "\n" * r.randint(0, 5)) for t in range(700)]
    one_turn = [(2, 7, f"{k} " + "w " * r.randint(0, 300) + "\n" * r.randint(0, 5)) for k in range(600)]  # a segment of several runs
    df = spark.createDataFrame(long + one_turn, "conv_id long, turn long, text string")
    for conv in (1, 2):
        mine = df.filter(f"conv_id = {conv}")
        got = [(x.text, x.role) for x in chat.parse(mine, hmm).orderBy("turn", "text").collect()]
        seen = [(x.text, x.seen) for x in chat.numbered(mine).orderBy("turn", "text").collect()]
        assert got == [(t, chat.ROLES[s]) for (t, _), s in zip(seen, hmm.decode([o for _, o in seen], None, None), strict=True)]


def test_viterbi_of_roles_equals_enumeration():
    r = random.Random(6)
    pool = ["none/1/1/later", "user/1/2/later", "none/3/4/later", "assistant/5/7/later", "none/9/9/later"]
    counts = {(role, o): r.randint(0, 9) for role in chat.ROLES for o in pool[:3]}
    hmm = chat.Hmm({"user": 5, "system": 2}, {(a, b): r.randint(0, 9) for a in chat.ROLES for b in chat.ROLES}, counts)
    for _ in range(20):
        seen = r.choices(pool, k=6)
        e = hmm.scores(seen)

        def score(y):
            return hmm.start[y[0]] + sum(e[t, v] for t, v in enumerate(y)) + sum(hmm.move[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product(range(3), repeat=6), key=score)
        assert abs(score(hmm.decode(seen, None, None)) - score(best)) < 1e-9
        assert abs(hmm.segment(seen, True)[0].max() - score(best)) < 1e-9


def test_transitions_are_counted_across_segments(spark):
    rows = [("c", t, "x", "user" if t < 256 else "assistant") for t in range(512)]
    hmm = chat.train(spark.createDataFrame([(k, *r[1:]) for k in range(12) for r in rows], "conv_id long, turn long, text string, role string"))
    n = sum(__import__("zlib").crc32(str(k).encode()) % 3 != 1 for k in range(12))
    want = np.array([255 * n + 0.1, n + 0.1, 0.1])
    assert np.allclose(np.exp(hmm.move[0]), want / want.sum())


def test_rows_are_cut_before_inner_markers(spark):
    rows = [(1, 0, "plain\n\ntext", "user", 9), (1, 1, "User: one\nmore\nAssistant: two\n[user] three", "user", 9), (1, 2, None, None, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, seg int")
    got = [tuple(r) for r in chat.marked_blocks(df).orderBy("turn", "part").collect()]
    assert got == [(1, 0, "user", 0, "plain\n\ntext"), (1, 1, "user", 0, "User: one\nmore"), (1, 1, None, 1, "Assistant: two"), (1, 1, None, 2, "[user] three"), (1, 2, None, 0, "")]
    roles = [r.role for r in chat.parse(chat.marked_blocks(df), chat.train(chat.marked_blocks(df))).filter("turn = 1").orderBy("part").collect()]
    assert roles == ["user", "assistant", "user"]
    long = spark.createDataFrame([(1, 0, "word " * 400_000)], "conv_id long, turn long, text string")
    assert len(chat.parse(long, chat.train(df)).first().text) == 2_000_000


def test_roles_recovered_and_rendered(spark):
    conversations = common.table(spark, "/root/testdata/sf0.01", "conversations")
    hmm = chat.train(conversations)
    truth = conversations.select("conv_id", "turn", F.col("role").alias("truth"))
    found = chat.parse(conversations, hmm).join(truth, ["conv_id", "turn"])
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) == 1
    assert found.filter(fold).agg(F.avg((F.col("role") == F.col("truth")).cast("int"))).first()[0] > 0.93
    raw = spark.createDataFrame([(1, "System: be kind\n\nUser: hi\nthere\n### Assistant: hello\n\n[HUMAN] more"), (2, None), (3, "")], "conv_id long, text string")
    got = chat.parse(chat.transcript_blocks(raw), hmm).orderBy("turn").collect()
    assert [x.role for x in got] == ["system", "user", "assistant", "user"]
    assert [x.rendered for x in got][1] == "<|user|>\nhi\nthere\n<|end|>\n" and got[3].rendered == "<|user|>\nmore\n<|end|>\n"


def test_chat_edges(spark):
    rows = [(None, None, None, "x"), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, None, "", "x"), (None, 1, "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, seen string")
    hmm = chat.train(df.withColumn("role", F.lit("user")))
    assert len(chat.parse(df, hmm).collect()) == 5 and chat.parse(df.limit(0), hmm).count() == 0


def test_transcript_blocks_are_trimmed_of_spaces_alone(spark):
    raw = spark.createDataFrame([(7, " 0 first 0 \n\n1 second 1\n\n  \n\nUser: 2 third 2"), (8, None), (9, "")], "conv_id long, text string")
    got = [tuple(r) for r in chat.transcript_blocks(raw).orderBy("conv_id", "turn").collect()]
    assert got == [(7, 0, "0 first 0"), (7, 1, "1 second 1"), (7, 2, "User: 2 third 2")]


# ---- URL rules

def test_url_edges(spark):
    rows = ["http://example.net", "http://Example.NET/en/x?q", "http://a.example.net/fr/", "https://notexample.com/de/", "x://example.com/de/#a", "http://b.org/fr/y", "http://org/fr/", None, "", "no scheme", "http://net:80/", "http://net/\nx"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(rows)] + [(3, rows[3], "r")], "page_id long, url string, rule string")
    got = {(r.page_id): (r.host, r.rule, r.verdict) for r in url_rules.filter_urls(pages, url_rules.rules_frame(spark)).collect()}
    assert [got[k][1] for k in range(12)] == [None, "example.net/en/", "net/", None, "example.com/de/", "org/fr/", "org/fr/", None, None, None, None, "net/"]
    assert [got[k][2] for k in (1, 2, 4, 7)] == ["allow", "block", "block", "allow"] and got[7][0] == ""
    assert url_rules.filter_urls(pages, url_rules.rules_frame(spark)).count() == 13
    assert url_rules.filter_urls(pages.limit(0), url_rules.rules_frame(spark)).count() == 0
    anywhere = spark.createDataFrame([("regex only", "block", r"en/x$", [])], url_rules.RULE_SCHEMA)
    assert {r.page_id for r in url_rules.filter_urls(pages, anywhere).collect() if r.verdict == "block"} == {1}


# ---- BPE

ODD = [None, "", " ", "a", "\n\n  x  ", "it's they'll '' 'S", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "日本語 テキスト", "e\u0301 \u00a0 \u2003x\u0085\x1c.", "😀👩‍👩‍👧 ½ ²3", "\x00\x01", "Straße 1234567 -- …", "a" * 20_000, "ab " * 50_000]


def test_bpe_equals_the_library(spark, sf_dir):
    t = Tokenizer.from_file(BPE_FILE)
    texts = ODD + ODD[:5] + [r.text for r in common.table(spark, sf_dir, "documents").limit(60).collect()]
    docs = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "doc_id long, text string, ids int")
    found = bpe.encode(docs, BPE_FILE, block_bytes=5000).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        plain = t.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r.n_tokens == len(ids) and r.decoded == plain
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), BPE_FILE).count() == 0


def test_every_character_is_split_as_the_library_does(spark):
    t = Tokenizer.from_file(BPE_FILE)
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1 {chr(c)}x  {chr(c)}'s" for c in range(k, k + 16)) for k in [*range(1, 0x2100, 16), *range(0x3000, 0x3100, 16)]]
    single = [chr(c) + x for c in range(1, 0x250) for x in ("", "a 's", " ")]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts + single)], "doc_id long, text string")
    got = {r.doc_id: r["ids"] for r in bpe.encode(docs, BPE_FILE, decoded=False).collect()}
    assert all(got[k] == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts + single))


def test_random_texts_are_split_as_the_library_does(spark):
    t, r = Tokenizer.from_file(BPE_FILE), random.Random(8)
    parts = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "\r\n", "'", "''", "'s", "'ll", "'Re", "!", "—", "…", "<|endoftext|>", "<|", "\u00a0", "ж", "½", "_", "-", "\x1c"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in bpe.encode(docs, BPE_FILE, block_bytes=1 << 12).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k].decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_rows_nulls_and_other_keys(spark):
    docs = spark.createDataFrame([("a", None, 1), (None, "x y", 2), ("a", "x y", 3), ("a", "x y", 3)], "name string, text string, key int")
    got = sorted(((r.name, r.n_tokens) for r in bpe.encode(docs, BPE_FILE, key="name").collect()), key=str)
    assert got == [("a", 0), ("a", 2), ("a", 2), (None, 2)]
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_tokens, r["ids"], r.decoded) for r in bpe.encode(nothing, BPE_FILE).collect()] == [(0, [], "")] * 2


# ---- pipeline

def test_pipeline_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns
        docs, _ = common.written(after, f"stage{k}")
    assert 0 < docs.count() < 200
    assert docs.count() == docs.select("doc_id").distinct().count()
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    empty = common.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir, monkeypatch):
    """The whole chain against loops over the documents of the smallest tables, with nulls, repeats and other columns."""
    import re

    from test_dedup_and_leaks import components_brute, scan_brute, simhash_brute

    from loomgraph.llm import decontaminate

    given = [tuple(r) for r in common.table(spark, sf_dir, "documents").select(*corpus_pipeline.COLUMNS).collect()]
    given += [(None, "Ein kurzer deutscher Text und die Antwort darauf ist nicht bekannt", None, None, None), (10**6, None, None, None, 0), given[3], (10**6 + 1, "1234 --", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in given], "doc_id long, text string, lang string, source string, n_chars long, _block string, _h1 int")
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    model = langid.fit(docs)
    kept = []
    for r in given:
        text = r[1]
        if not text or not any(c.isalpha() for c in text):
            continue
        lang, score, unsure = (x[0] for x in model.decode(*model.margins([langid.prepared(text)])))
        if not (unsure and score <= 0.5):
            kept.append((r[0], text, lang, *r[3:]))
    got = corpus_pipeline.language(spark, docs, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)

    places = list(range(len(kept)))
    root = components_brute(places, [simhash_brute(r[1]) for r in kept])
    first = {}
    for k, r in enumerate(kept):
        order = (r[0] is None, r[0] or 0)
        first[root[k]] = min(first.get(root[k], (order, k)), (order, k))
    kept = [kept[k] for _, k in first.values()]
    stage = corpus_pipeline.near_dedup(spark, got, sf_dir)
    assert sorted(map(tuple, stage.collect()), key=str) == sorted(kept, key=str)

    words = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1])] for r in kept]
    seen = {}
    for r, spans in zip(kept, words, strict=True):
        for i in range(len(spans) - 34):
            key = tuple(r[1][a:b] for a, b in spans[i : i + 35])
            seen[key] = seen.get(key, 0) + 1
    after = []
    for r, spans in zip(kept, words, strict=True):
        gone = {p for i in range(len(spans) - 34) if seen[tuple(r[1][a:b] for a, b in spans[i : i + 35])] > 1 for p in range(i, i + 35)}
        ends = [a for a, _ in spans[1:]] + [len(r[1])]
        text = r[1][: spans[0][0]] + "".join(r[1][a:e] for p, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if p not in gone) if gone else r[1]
        if len(gone) < len(spans):
            after.append((*r[:1], text, *r[2:4], len(text)))
    stage = corpus_pipeline.substring(spark, stage, sf_dir)
    assert sorted(map(tuple, stage.collect()), key=str) == sorted(after, key=str)

    grams = {}
    for item, text in items:
        w = re.findall(decontaminate.RAW_WORD, text or "")
        for i in range(max(1, len(w) - 12) if w else 0):
            grams[tuple("".join(c.lower() if c.isascii() else c for c in x) for x in w[i : i + 13])] = item
    clean = []
    for r, (n, n_hit, *_, bad) in zip(after, scan_brute([r[1] for r in after], items), strict=True):
        if bad:
            continue
        spans = [m.span() for m in re.finditer(decontaminate.RAW_WORD, r[1])]
        low = ["".join(c.lower() if c.isascii() else c for c in r[1][a:b]) for a, b in spans]
        hit = {p for size in {len(g) for g in grams} for i in range(n - size + 1) if tuple(low[i : i + size]) in grams for p in range(i, i + size)}
        assert len(hit) == n_hit
        starts = [0] + [b for _, b in spans]
        text = "".join(r[1][s:b] for p, (s, (_, b)) in enumerate(zip(starts, spans, strict=False)) if p not in hit) + r[1][starts[-1] :] if hit else r[1]
        clean.append((*r[:1], text, *r[2:4], len(text)))
    stage = corpus_pipeline.decontamination(spark, stage, sf_dir)
    assert sorted(map(tuple, stage.collect()), key=str) == sorted(clean, key=str)

    t = Tokenizer.from_file(BPE_FILE)
    want = sorted(((r[0], t.encode(r[1], add_special_tokens=False).ids) for r in clean), key=str)
    assert sorted(((r.doc_id, r["ids"]) for r in corpus_pipeline.encoding(spark, stage, sf_dir).collect()), key=str) == want and 0 < len(want) < len(given)
