"""Brute-force comparisons and edge cases of decontamination, substring dedup and SimHash."""

import hashlib
import random
import re

import pytest
from xxhash import xxh64_intdigest

from loomgraph.llm import common, decontaminate, shards, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n):
    return [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()) + str(r.randint(0, 40)) for _ in range(n)]


def passages(seed=1):
    r = random.Random(seed)
    shared = prose(r, 60)
    texts = [" ".join(prose(r, r.randint(0, 200))) for _ in range(30)]
    texts += [" ".join(prose(r, 20)) + "\n" + "\t ".join(shared) + "\x0b" + " ".join(prose(r, 9)) for _ in range(4)]
    texts += [texts[3], texts[3], None, "", "   ", "one", " ".join(["same"] * 120), "É\u00a0x " * 50, "a" * 100_000]
    return texts


def windows_brute(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_equals_brute_force(spark):
    texts = passages()
    want = windows_brute(texts, 35)
    got = substring_dedup.cut(frame(spark, texts), block_bytes=200).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [w[:3] for w in want]
    for r, w, t in zip(got, want, texts, strict=True):
        assert (r.text or "").encode().split() == w[3].encode().split()
        if not w[1]:
            assert r.text == t
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_sha256"}


def test_substring_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text, "h"), (1, text, "h"), (None, None, None)], "doc_id long, text string, hashes string")
    got = sorted(substring_dedup.cut(docs).select("doc_id", "n_words", "n_removed", "hashes").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 50, 50, "h"), (1, 50, 50, "h"), (None, 0, 0, None)]
    assert substring_dedup.cut(docs.limit(0)).count() == 0


def test_pack_round_trip():
    import numpy as np

    x = np.sort(np.random.RandomState(0).randint(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(3))
    for n in (0, 1, substring_dedup.TABLE_PAYS - 1, substring_dedup.TABLE_PAYS, len(x)):
        assert (substring_dedup.unpack(substring_dedup.pack(x[:n])) == x[:n]).all() and len(substring_dedup.unpack(substring_dedup.pack(x[:n]))) == n
    assert len(substring_dedup.pack(x[:1])) == 9 and len(substring_dedup.pack(x)) < 8 * len(x)


def test_many_small_blocks_equal_one(spark):
    r = random.Random(6)
    passage = prose(r, 60)
    docs = frame(spark, [" ".join(prose(r, 150) + (passage if k % 3 else []) + prose(r, 20)) for k in range(60)])
    many = substring_dedup.cut(docs.repartition(4), block_bytes=1 << 7).select("doc_id", "n_removed", "kept_sha256")
    assert sorted(many.collect()) == sorted(substring_dedup.cut(docs, block_bytes=1 << 30).select("doc_id", "n_removed", "kept_sha256").collect())


def simhash_brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(keys, fps, most=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), []).append(keys[k])
    return {keys[k]: min(groups[find(k)]) for k in range(len(fps))}


def near_texts():
    r = random.Random(5)
    texts = []
    for _ in range(12):
        base = prose(r, 300)
        for _ in range(r.randint(1, 6)):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = "edit" + str(r.randint(0, 9))
            texts.append(" ".join(edited))
    return [*texts, None, "", "\n", "one two", "ONE two", "one two three four", "x" * 50_000]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    ids = [7 * k % 1000 + 3 for k in range(len(texts))]
    fps = [simhash_brute(t) for t in texts]
    want = components_brute(ids, fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts, ids)).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {i: f"{f:016x}" for i, f in zip(ids, fps, strict=True)}
    assert {k: r.component_id for k, r in got.items()} == want
    kept = simhash.keep_one(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("most_residents", [None, 2])
def test_links_keep_the_components_of_all_pairs(spark, most_residents):
    """Also with buckets split into parts of two residents."""
    r = random.Random(9)
    fps = {r.getrandbits(38) << 26 | 12345 for _ in range(40)}  # one full bucket
    for _ in range(15):
        at = r.getrandbits(64)
        for _ in range(20):
            for _ in range(r.randint(1, 4)):
                at ^= 1 << r.randrange(64)
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.links(nodes, most_residents) if most_residents else simhash.links(nodes)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    found = {r.node: r.root for r in simhash.components(links).collect()}
    want = components_brute(signed, fps)
    assert {s: found.get(s, s) for s in signed} == want


def test_simhash_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e", "x"), (5, "a b c d e", "x"), (5, "a b c d e", "x"), (None, "q r s t u v", "x")], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"] and sorted((r.doc_id for r in kept.collect()), key=str) == [5, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_of_each_group_of_null_or_repeated_ids(spark):
    alone = [f"{w} alone {w}{w} in its group {w}x" for w in ("red", "green", "blue", "white", "black", "grey")]
    copies = ["many copies of this text"] * 2
    rows = [(None, t) for t in alone[:3] + copies] + [(5, alone[3]), (5, alone[4]), (5, alone[4]), (None, alone[3]), (6, alone[4]), (7, alone[5])]
    assert len({simhash_brute(t) for _, t in rows}) == 7 and all((simhash_brute(a) ^ simhash_brute(b)).bit_count() > 4 for _, a in rows for _, b in rows if a != b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, t) for t in alone[:3] + copies[:1]] + [(5, alone[3]), (5, alone[4]), (7, alone[5])], key=str)


def scan_brute(texts, items):
    def words(t):
        return re.findall(decontaminate.WORD, "".join(c.lower() if c.isascii() else c for c in t or ""))

    grams = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for n in {len(g) for g in grams}:
                if i + n <= len(w) and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("short, most", [(None, None), ("two words", None), ("single", None), ("", None), ("two words", 0), (None, 2000)])
def test_decontamination_equals_brute_force(spark, monkeypatch, short, most):
    """Also with windows, or windows and their first words, too large to broadcast."""
    if most is not None:
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    r = random.Random(2)
    items = [(k, " ".join(prose(r, 30))) for k in range(5)] + [(10, None), (11, "..."), (None, " ".join(prose(r, 14)))]
    if short is not None:
        items.append((12, short))
    leak, other = items[0][1].split(), items[1][1].split()
    texts = [" ".join(prose(r, 100)) for _ in range(10)]
    texts += [" ".join(prose(r, 40)) + " -- " + ", ".join(leak[3:25]).upper() + "! " + " ".join(prose(r, n)) for n in (5, 2000)]
    texts += [" ".join(leak + other), " ".join(leak[:12]), " ".join(leak[:13]), None, "", "Two-Words", "SINGLE", "ÄÖ single é"]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench).orderBy("doc_id").collect()
    assert [(g.n_words, g.n_hit, g.n_items, ",".join(g["items"]), g.contaminated) for g in got] == scan_brute(texts, items)


def test_cut_drops_and_trims(spark):
    r = random.Random(4)
    leak = prose(r, 20)
    clean = "Kept -- as\n it is, " + " ".join(prose(r, 50))
    long = "Start, here. " + " ".join(prose(r, 600)) + "; " + " ".join(leak) + " .. " + " ".join(prose(r, 5)) + "!"
    docs = frame(spark, [clean, " ".join(leak), long, None])
    bench = spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string")
    got = {x.doc_id: x.text for x in decontaminate.cut(docs, bench).collect()}
    assert got.keys() == {0, 2, 3} and got[0] == clean and got[3] is None
    assert got[2] == long.replace("; " + " ".join(leak), "")
    assert decontaminate.cut(docs, bench.limit(0)).count() == 4 and decontaminate.report(docs.limit(0), bench).count() == 0


def test_cut_merges_overlapping_and_long_hits(spark):
    r = random.Random(9)
    one, two = prose(r, 40), prose(r, 30)
    short = ["solitary", "phrase"]
    words = prose(r, 30_000)
    words[100:100], words[20_000:20_000], words[25_000:25_000] = one, one[:20] + two, short
    items = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(short))]
    docs = spark.createDataFrame([(1, " ".join(words), "s", True, 7)], "doc_id long, text string, _spans string, _bad boolean, _PIECES int")
    got = decontaminate.cut(docs, spark.createDataFrame(items, "item_id long, text string"))
    want = words[:100] + words[140:20_000] + words[20_050:25_000] + words[25_002:]
    assert [tuple(x) for x in got.collect()] == [(1, " ".join(want), "s", True, 7)] and got.columns == docs.columns


def test_clashing_names_in_the_dedup_stages(spark):
    docs = spark.createDataFrame([(k, "same text here", 9, "x", "y") for k in range(3)], "doc_id long, text string, n_words int, _block string, _kept string")
    cut = substring_dedup.cut(docs)
    assert cut.columns == ["doc_id", "text", "_block", "_kept", "n_words", "n_removed", "kept_sha256"] and [r._block for r in cut.collect()] == ["x"] * 3
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(0, "same text here", 9, "x", "y")]


def test_stored_map_versions(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * (k % 50)) for k in range(2000)], "doc_id long, text string")
    _, versions = shards.shard(docs, store_at=str(tmp_path / "map"))
    assert shards.load(spark, str(tmp_path / "map")) == versions[-1] and shards.load(spark, str(tmp_path / "map"), 1) == versions[0]
    shards.store(spark, [versions[-1].grown()], str(tmp_path / "map"))
    assert shards.load(spark, str(tmp_path / "map")).n_shards == 9


def test_report_repeats_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, "c", 3)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit) for x in decontaminate.report(docs, bench).collect()), key=str)
    assert got == [(1, 2, 2), (1, 2, 2), (None, 1, 0)]


def test_shards(spark, sf_dir):
    import zlib

    docs = common.table(spark, sf_dir, "documents")
    placed, versions = shards.shard(docs)
    rows = placed.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    loads = {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert r.shard == versions[-1].shards[r.vslot]
        loads.setdefault(r.shard, []).append(r)
    for rs in loads.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sums = [sum(r.size for r in rs) for rs in loads.values()]
    assert len(loads) == 8 and max(sums) - min(sums) < 0.01 * sum(sums) / 8
    assert versions[-1].frame(spark).count() == shards.N_SLOTS


def test_shards_by_key_grow_into_the_new_one(spark):
    docs = spark.createDataFrame([(k if k % 7 else None, None if k % 5 == 0 else f"t{k}", k) for k in range(500)], "doc_id long, text string, shard int")
    rows = shards.shard(docs, law="key")[0].collect()
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {8} and len(rows) == 500
    part = {r.doc_id: r.shard for r in shards.shard(docs.filter("doc_id < 100"), law="key")[0].collect()}
    assert part.items() <= {r.doc_id: r.shard for r in rows}.items()
    assert {r.size for r in shards.shard(docs)[0].collect() if r.text_crc32 == 0} == {1}
    assert shards.shard(docs.limit(0))[0].count() == 0
    twice = shards.shard(docs.limit(3).union(docs.limit(3)))[0].collect()
    assert len(twice) == 6 and len({(r.shard, r.slot) for r in twice}) == 6
    grown = shards.SlotMap.first(4096, 8).grown()
    assert grown.version == 2 and abs(grown.shards.count(8) - grown.shards.count(0)) <= 1


def test_blocks_are_bounded_by_text_whatever_the_compression(spark, tmp_path):
    import os

    import pyarrow as pa

    line = "the very same words come again and again in this text " * 100
    docs = spark.range(4000).selectExpr("id AS doc_id", f"'{line}' AS text")
    docs.coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    files = sum(f.stat().st_size for f in os.scandir(tmp_path / "t"))
    assert common.text_bytes(stored) == 4000 * len(line) > 100 * files
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 95 + [None, "y" * 500, ""]})
    runs = list(common.blocks_of([(batch, common.lengths_of(batch.column("text")))] * 3, 100))
    sizes = [[common.lengths_of(b.column("text")).sum() for b in run] for run in runs]
    assert sum(b.num_rows for run in runs for b in run) == 3 * batch.num_rows and max(map(sum, sizes)) <= 600 and all(sum(s) >= 100 for s in sizes[:-1])
    got = substring_dedup.cut(stored, text_out=False).agg({"n_removed": "sum", "doc_id": "count"}).first()
    assert tuple(got) == (4000, 4000 * 1100) or tuple(got) == (4000 * 1100, 4000)


def test_a_bucket_over_many_batches():
    import numpy as np
    import pyarrow as pa

    fps = np.arange(40, dtype=np.int64) << 26
    names = ["key", "part", "fp", "own"]
    rows = [(0, 0, f, True) for f in fps.tolist()] + [(0, 1, 7, False), (0, 1, 5, True)] + [(1 << 20, 0, 3, True), (1 << 20, 0, 2, True)]
    one = list(simhash.linked_in_sorted([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]))
    many = list(simhash.linked_in_sorted(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 3]]) for k in range(0, len(rows), 3)))
    flat = [sorted((u, v) for b in found for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for found in (one, many)]
    assert flat[0] == flat[1] and {(7, 5), (3, 2)} <= set(flat[0])
    assert list(simhash.linked_in_sorted([])) == []


def test_placement_equals_brute_force(spark):
    """Slots' bytes, the rebalanced map and positions, recomputed by loops from each row's virtual slot."""
    r = random.Random(11)
    docs = spark.createDataFrame([(k if k % 50 else None, "x" * r.choice([0, 5, 30, 900]) if k % 7 else None) for k in range(600)] + [(1, "y" * 200_000)], "doc_id long, text string")
    rows = shards.shard(docs, n_shards=3, n_slots=40)[0].collect()
    sizes, of = [0] * 40, [k % 3 for k in range(40)]
    for x in rows:
        sizes[x.vslot] += x.size
    while True:  # the heaviest shard gives the slot that best halves its gap to the lightest
        loads = [sum(s for s, k in zip(sizes, of, strict=True) if k == j) for j in range(3)]
        high, low = loads.index(max(loads)), loads.index(min(loads))
        fits = [(abs(2 * sizes[k] - (loads[high] - loads[low])), k) for k in range(40) if of[k] == high and 0 < sizes[k] < loads[high] - loads[low]]
        if not fits:
            break
        of[min(fits)[1]] = low
    assert all(x.shard == of[x.vslot] for x in rows) and len(rows) == 601
    for j in range(3):
        mine = sorted((x for x in rows if x.shard == j), key=lambda x: x.slot)
        assert [x.slot for x in mine] == list(range(len(mine))) and [x.vslot for x in mine] == sorted(x.vslot for x in mine)
