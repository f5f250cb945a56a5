"""SimHash near-duplicates: fingerprints within 4 bits are linked, groups are connected components.

Candidates come from pigeonring filtering.  The 64 bits form a ring of five segments; if two fingerprints differ
in at most 4 bits, some segment starts a chain in which the first k segments differ in at most 4k/5 bits, for every
k: 0, 1, 2, 3, 4.  The first two links of the chain are the index: a fingerprint lies in the bucket of each segment
start with its own two segments, and visits the buckets whose second segment differs from its own in one bit.
Inside a bucket the budgets of three and four segments prune before the full Hamming check.

A bucket of more than MOST_RESIDENTS fingerprints is split: each part owns some of them, and all others visit it.
A bucket links its members by breadth-first search over those not yet reached, so a dense group of copies costs
about its size and gives a tree of links, not all pairs.  Only distinct fingerprints enter the index; exact copies
hang on their fingerprint.  Components come from alternating large-star and small-star rounds over tables, each
round written to the shared folder.

Edge cases: texts without words (null, empty, blank) have fingerprint zero and form one group; ties and repeated
rows are copies; documents with a null doc_id take part, and a component of them alone has a null id, though
keep_one keeps one document of each such component; an empty
table gives an empty result; further columns are ignored or, in keep_one, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: Fingerprints that a bucket owns on average at most; a fuller one is split into parts.
MOST_RESIDENTS = 20_000
#: The most split buckets that are broadcast (16 bytes each).
MOST_BROADCAST = 1_000_000
#: (shift, width) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes) -> int:
    """SimHash of the XXH64 of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE + 1
    spans = zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    set_bits = np.zeros(64, np.int64)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for k in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[k : k + (1 << 15)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """(key, fp): one row per row of `docs`, fp as a signed long; if hashed with (h1, h2), 128 bits of the text."""
    hashes = dict(zip(("h1", "h2"), text_hashes(), strict=True)) if hashed else {}
    names = [key, "fp", *hashes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=names)

    kind = f"{key} {docs.schema[key].dataType.simpleString()}, fp long" + "".join(f", {h} long" for h in hashes)
    return docs.select(key, "text", *(c.alias(h) for h, c in hashes.items())).mapInArrow(run, kind)


def text_hashes() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def segment_values(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in SEGMENTS]


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, own) rows of distinct fingerprints: 5 of their own and 64 visits each."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 2000):
            fps = whole[at : at + 2000]
            parts, keys, own = segment_values(fps), [], []
            for i in range(5):
                after = (i + 1) % 5
                head = np.uint64(i << 26) | (parts[i] << np.uint64(13))
                keys.append(head | parts[after])
                own.append(True)
                for bit in range(SEGMENTS[after][1]):
                    keys.append(head | (parts[after] ^ np.uint64(1 << bit)))
                    own.append(False)
            key = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fps.view(np.int64), len(keys))), pa.array(np.repeat(own, len(fps)))], names=["key", "fp", "own"])


def _masks() -> list[list[tuple[np.uint64, int]]]:
    """For each start: the bits of the first three and four segments, and all, with their budgets."""
    out = []
    for i in range(5):
        mask, steps = 0, []
        for k in range(5):
            shift, width = SEGMENTS[(i + k) % 5]
            mask |= ((1 << width) - 1) << shift
            if k >= 2:
                steps.append((np.uint64(mask), MOST_BITS * (k + 1) // 5))
        out.append(steps)
    return out


MASKS = _masks()


def near(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Positions of `others` that pass the chain's budgets, the last being the full Hamming check."""
    at, differing = np.arange(len(others)), others ^ one
    for mask, most in MASKS[start]:
        passed = np.bitwise_count(differing & mask) <= most
        at, differing = at[passed], differing[passed]
    return at


def bucket_links(start: int, own: np.ndarray, visiting: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the bucket's members as all links between own-own and own-visiting pairs would."""
    links = []
    while len(own):
        queue, own = [(own[0], True)], own[1:]
        while queue and (len(own) or len(visiting)):
            one, resident = queue.pop()
            if len(own):
                found = near(one, own, start)
                if len(found):
                    links += [(int(one), int(x)) for x in own[found]]
                    queue += [(x, True) for x in own[found]]
                    own = np.delete(own, found)
            if resident and len(visiting):
                found = near(one, visiting, start)
                if len(found):
                    links += [(int(one), int(x)) for x in visiting[found]]
                    queue += [(x, False) for x in visiting[found]]
                    visiting = np.delete(visiting, found)
    return links


def linked_in_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of rows (key, part, fp, own) sorted by key and part; one may go over several batches."""

    def links(key, part, fp, own) -> pa.RecordBatch:
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        begin, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        residents = np.add.reduceat(own.astype(np.int64), begin)
        busy, out = (residents > 0) & (end - begin > 1), []
        for a, b in zip(begin[busy].tolist(), end[busy].tolist(), strict=True):
            fps, mine = fp[a:b].view(np.uint64), own[a:b]
            out += bucket_links(int(key[a]) >> 26, fps[mine], fps[~mine])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(1, initial=-(1 << 63))), pa.array(pairs.min(1, initial=(1 << 63) - 1))], names=["u", "v"])

    held: list[list[np.ndarray]] = []  # pieces of the bucket that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        if held and (held[-1][0][-1], held[-1][1][-1]) == (rows[0][0], rows[1][0]) and last.all():
            held.append(rows)
            continue
        begin = int(np.argmax(last))  # where the last bucket of the batch starts
        done = [np.concatenate(c) for c in zip(*held, [r[:begin] for r in rows], strict=True)]
        if len(done[0]):
            yield links(*done)
        held = [[r[begin:] for r in rows]]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def full_buckets(fps: DataFrame, most: int) -> DataFrame:
    """(full, parts): the buckets that own more than `most` fingerprints."""
    segment = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in SEGMENTS]
    own = F.array(*(F.shiftleft(F.lit(i).cast("long"), 26) + F.shiftleft(segment[i], 13) + segment[(i + 1) % 5] for i in range(5)))
    counts = fps.select(F.explode(own).alias("full")).groupBy("full").count()
    return counts.filter(F.col("count") > most).select("full", F.ceil(F.col("count") / most).cast("int").alias("parts"))


def links(fps: DataFrame, most_residents: int = MOST_RESIDENTS) -> DataFrame:
    """(u, v), u > v: links whose connected components are those of all links; fps has distinct `fp`."""
    n = common.tasks_for(fps, 1 << 20)
    fps = fps.select("fp").repartition(n, "fp")  # few bytes, but 69 rows each come out of them
    index = fps.mapInArrow(index_rows, "key long, fp long, own boolean")
    full, _ = common.written(full_buckets(fps, most_residents), "full-buckets")
    if n_full := full.count():
        full = F.broadcast(full) if n_full <= MOST_BROADCAST else full
        parted = index.join(full, F.col("key") == F.col("full"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        mine = F.col("parts").isNull() | (F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))) == F.col("part"))
        index = parted.select("key", "part", "fp", (F.col("own") & mine).alias("own"))
    else:
        index = index.select("key", F.lit(0).alias("part"), "fp", "own")
    return index.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(linked_in_sorted, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the least node of its component.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the least among them.
    The links of a node with very many meet in a partial minimum; the join back may be split by adaptive
    execution.  Every round is a written table, and only counts and sums reach the driver.
    """
    spark = edges.sparkSession
    now, path = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, at_large = common.written(large, "large-star")
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        moved = large.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, at_small = common.written(moved.union(least.select("k", "m").toDF("u", "v")).distinct(), "small-star")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.remove(spark, path)
        common.remove(spark, at_large)
        now, path = small, at_small
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def groups(marked: DataFrame, least: Column) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints of marked(fp, ...), `least` aggregated over the rows of each."""
    distinct = marked.groupBy("fp").agg(least.alias("least"))
    found = components(links(distinct))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) per row of `docs`."""
    marked, _ = common.written(fingerprints(docs, key), "fingerprints")
    of_fp = groups(marked, F.min(key))
    least = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = of_fp.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(answer, F.col("fp") == F.col("_fp")).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` with one document of each group, that of the least key, nulls last, then of the least hash of its text.

    A group of null keys alone keeps one as well, and rows of one key in different groups stay, one in each.
    """
    marked, _ = common.written(fingerprints(docs, key, hashed=True), "fingerprints")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "h1", "h2")
    best = groups(marked, F.min(order)).groupBy("root").agg(F.min("least").alias("best"))
    k, h1, h2, d1, d2 = (common.unused(docs, name) for name in ("_kept", "_kept_h1", "_kept_h2", "_h1", "_h2"))
    kept = best.select(F.col("best.key").alias(k), F.col("best.h1").alias(h1), F.col("best.h2").alias(h2))
    rows = docs.withColumns(dict(zip((d1, d2), text_hashes(), strict=True)))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(d1) == F.col(h1)) & (F.col(d2) == F.col(h2))
    return rows.join(kept, same).dropDuplicates([key, d1, d2]).select(*docs.columns)


def op7_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
