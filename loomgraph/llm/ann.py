"""Approximate nearest neighbours by cosine: an inverted file scanned with adaptive dimension sampling.

Unit vectors are rotated by a fixed random orthogonal matrix and dealt to the lists of k-means centroids, fitted on
a bounded sample; every vector is indexed.  A query probes its nearest lists, in two rounds: the few nearest give it
the distance of its k-th best so far, which the second round starts from; lists whose centroid and radius show that
nothing in them can be nearer are left out there.  Within a list, columns come in blocks; after each block a hypothesis
test (partial distance against the k-th best so far, with the slack EPSILON / sqrt(dimensions read)) abandons
candidates, and each STEP of rows tightens the k-th best for the next.  Survivors get the exact cosine of the original
vectors.

Identical vectors are one entry with their k + 1 least ids, and identical queries are searched once: no more can
appear in a result, so a vector that a third of all rows share costs one entry.  Lists and their queries are cut
into blocks of bounded size, and blocks meet by an equi-cogroup.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of
different dimensions have no cosine, so each dimension is searched by itself; ties go to the smaller vec_id; rows that
repeat a vec_id and vector count once; fewer than k candidates give all of them; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
EVERY = 50
#: Vectors that k-means is fitted on, at most.
SAMPLE = 20_000
MOST_LISTS = 4096
#: Share of the lists that a query probes; its neighbours' lists are scattered in high dimension.
PROBE_SHARE = 0.7
#: Share of them that the first round probes.
NEAR_SHARE = 0.1
#: Vectors and queries that meet in one block, at most.
BLOCK, QUERY_BLOCK = 4096, 16_384
STEP = 512
COLUMNS = 16
EPSILON = 2.1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, v as array<double>."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(11).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, n_lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = sample[np.random.RandomState(5).permutation(len(sample))[:n_lists]].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan(query: np.ndarray, lists: np.ndarray, k: int, worst: float = np.inf) -> np.ndarray:
    """Rows of `lists` that may be among the k nearest of `query`; both rotated unit vectors.  `worst` is the squared
    distance of the k-th best known."""
    d, best, kept = len(query), np.full(k, worst), []
    for at in range(0, len(lists), STEP):
        part = lists[at : at + STEP]
        alive, partial = np.arange(len(part)), np.zeros(len(part))
        for a in range(0, d, COLUMNS):
            b = min(a + COLUMNS, d)
            partial = partial + ((part[alive, a:b] - query[a:b]) ** 2).sum(1)
            if worst < np.inf:
                slack = (1 + EPSILON / math.sqrt(b)) ** 2 if b < d else 1
                passed = partial <= worst * b / d * slack + 1e-12
                alive, partial = alive[passed], partial[passed]
        best = np.partition(np.concatenate([best, partial]), k - 1)[:k]
        worst = best[-1]
        kept.append(at + alive)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, k: int = K, every: int = EVERY, probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id `every` divides."""
    rows, _ = common.written(usable(vectors).distinct(), "vectors")
    found = vectors.sparkSession.createDataFrame([], RESULT)
    for d in sorted(r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()):  # one, as a rule
        found = found.union(search_dimension(rows.filter(F.size("v") == d), k, every, probe_share))
    return found


def search_dimension(rows: DataFrame, k: int, every: int, probe_share: float) -> DataFrame:
    """search() among the usable rows of one dimension."""
    spark = rows.sparkSession
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("r", least).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 ids each
    entries, _ = common.written(entries.withColumn("h", F.xxhash64("v")), "entries")
    sample = matrix(entries.orderBy("h").select("v").limit(SAMPLE).toArrow().column("v"))
    turn = rotation(sample.shape[1])
    n_lists = max(1, min(MOST_LISTS, len(sample), round(math.sqrt(entries.count()) / 2)))
    centres = centroids(unit(sample) @ turn, n_lists)
    shared = spark.sparkContext.broadcast((turn, centres))  # at most MOST_LISTS vectors

    def nearest(batches, n: int):
        turn, centres = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                near = np.clip(unit(matrix(part.column("v"))) @ turn @ unit(centres).T, -1, 1)
                at = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
                begin = np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)
                lists, angles = pa.ListArray.from_arrays(begin, at.ravel()), pa.ListArray.from_arrays(begin, np.arccos(np.take_along_axis(near, at, 1)).ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, angles], names=[*part.schema.names, "lists", "angles"])

    placed = entries.mapInArrow(lambda b: nearest(b, 1), "v array<double>, ids array<long>, h long, lists array<int>, angles array<double>")
    placed, _ = common.written(placed.select("v", "ids", "h", F.col("lists")[0].alias("list"), F.col("angles")[0].alias("angle")), "placed")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked, _ = common.written(asked.withColumn("h", F.xxhash64("v")), "queries")
    distinct = asked.groupBy("v", "h").agg(F.min("vec_id").alias("rep"))
    probes = math.ceil(probe_share * n_lists)
    probing = distinct.mapInArrow(lambda b: nearest(b, probes), "v array<double>, h long, rep long, lists array<int>, angles array<double>")
    probing, _ = common.written(probing.select("v", "h", "rep", F.posexplode(F.arrays_zip("lists", "angles")).alias("at", "z")).select("v", "h", "rep", "at", F.col("z.lists").alias("list"), F.col("z.angles").alias("angle")), "probes")

    def block(mine: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if mine.num_rows and queries.num_rows:
            turn, _ = shared.value
            original = matrix(mine.column("v"))
            norms = np.linalg.norm(original, axis=1)
            turned, ids = unit(original) @ turn, mine.column("ids").to_pylist()
            for q, rep, worst in zip(matrix(queries.column("v")), queries.column("rep").to_pylist(), queries.column("worst").to_pylist(), strict=True):
                at = scan(unit(q[None])[0] @ turn, turned, k + 1, worst)
                scores = original[at] @ q / (norms[at] * np.linalg.norm(q))
                best = sorted(((-s, i) for s, j in zip(scores.tolist(), at.tolist(), strict=True) for i in ids[j]))[: k + 1]
                out[0] += [rep] * len(best)
                out[1] += [i for _, i in best]
                out[2] += [-s for s, _ in best]
        return pa.table({"rep": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    radii = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumnRenamed("list", "l")  # at most MOST_LISTS rows

    def scanned(probing: DataFrame) -> DataFrame:
        """(rep, vec_id, score) of the probes (v, h, rep, list, worst): blocks of each list meet blocks of its queries."""
        sizes = radii.select("l", F.ceil(F.col("n") / BLOCK).cast("int").alias("vblocks"))
        loads = probing.groupBy(F.col("list").alias("l2")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qblocks"))
        both = F.broadcast(sizes.join(F.broadcast(loads), F.col("l") == F.col("l2")).select("l", "vblocks", "qblocks"))
        left = placed.join(both, F.col("list") == F.col("l")).select("v", "ids", "list", F.pmod("h", "vblocks").cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qb"))
        right = probing.join(both, F.col("list") == F.col("l")).select("v", "rep", "worst", "list", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)).alias("vb"), F.pmod("h", "qblocks").cast("int").alias("qb"))
        keys = ["list", "vb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "rep long, vec_id long, score double")

    order = [F.desc("score"), "vec_id"]
    best = F.row_number().over(Window.partitionBy("rep").orderBy(*order))
    n_near = max(1, math.ceil(NEAR_SHARE * n_lists))
    first, _ = common.written(scanned(probing.filter(F.col("at") < n_near).withColumn("worst", F.lit(float("inf")))), "near")
    kth = first.withColumn("r", best).filter(F.col("r") == k + 1).select(F.col("rep").alias("of"), F.col("score").alias("kth"))
    rest = probing.filter(F.col("at") >= n_near).join(kth, F.col("rep") == F.col("of"), "left").join(F.broadcast(radii), F.col("list") == F.col("l"))
    possible = F.col("kth").isNull() | (F.col("angle") - F.col("radius") <= F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "kth"))) + 1e-6)
    rest = rest.filter(possible).select("v", "h", "rep", "list", F.coalesce(2 - 2 * F.col("kth") + 1e-9, F.lit(float("inf"))).alias("worst"))
    rest, _ = common.written(rest, "far-probes")
    found = first.union(scanned(rest))
    top = found.withColumn("r", best).filter(F.col("r") <= k + 1)
    per_query = asked.join(distinct.select(F.col("v").alias("v2"), "rep"), F.col("v") == F.col("v2")).select(F.col("vec_id").alias("query_id"), "rep")
    answer = per_query.join(top, "rep").filter("vec_id <> query_id")
    answer = answer.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
    return answer.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
