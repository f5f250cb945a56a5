"""Document graph and personalized PageRank of many surfers at once."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, Config
from loomgraph.storage import remove, written, written_at


def document_edges(links: DataFrame, urls: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different documents; links(src, dst_url), urls(url_id, document_id)."""
    resolved = links.join(urls.filter("document_id IS NOT NULL"), F.col("dst_url") == F.col("url_id"))
    return resolved.filter("src <> document_id").select("src", F.col("document_id").alias("dst")).distinct()


def out_degrees(links: DataFrame, key: str = "src") -> DataFrame:
    return links.groupBy(key).agg(F.count("*").alias("n"))


def seed_vectors(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """(surfer, id, p): each pinned domain with documents gets an equal share, split evenly among its documents.

    nodes(id, domain), pins(surfer, domain); a surfer without such a domain has no rows.
    """
    sizes = nodes.groupBy("domain").agg(F.count("*").alias("docs"))
    pinned = pins.distinct().join(sizes, "domain")
    share = pinned.withColumn("domains", F.count("*").over(Window.partitionBy("surfer")))
    return share.join(nodes, "domain").select("surfer", "id", (1.0 / (F.col("domains") * F.col("docs"))).alias("p"))


def blended_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, p): mean over the seeded surfers; uniform over the nodes if there is none."""
    n = seeds.select("surfer").distinct().agg(F.count("*").alias("surfers"))
    mean = seeds.groupBy("id").agg(F.sum("p").alias("total")).crossJoin(F.broadcast(n)).select("id", (F.col("total") / F.col("surfers")).alias("p"))  # n is one row
    count = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(n)).filter("surfers = 0")
    return mean.union(nodes.join(F.broadcast(count)).select("id", (1.0 / F.col("nodes")).alias("p")))


#: Up to so many linked and seeded nodes (some 50 bytes each) a surfer is solved in one task; the surfers of a task, and
#: rows of a message.
SMALL_EDGES = 20_000_000
SURFERS, MESSAGE = 4, 512


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, cfg: Config = DEFAULT, iterations: int | None = None, small: int = SMALL_EDGES) -> tuple[DataFrame, int, bool]:
    """((surfer, id, x), iterations, converged) of the surfers in seeds(surfer, id, p).

    x <- d W x + (d * dangling mass + 1 - d) p, from x = p.  With `iterations` that many steps run; else until the
    largest L1 change of any surfer is within the tolerance.  Graphs of at most `small` nodes are solved a few surfers
    a task, larger ones by a join per step; the results are the same.
    """
    off = seeds.groupBy("surfer").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").limit(1).count()
    if off or seeds.join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("seed vectors must sum to 1 over the graph's nodes")
    edges, seeds = written(edges.select("src", "dst"), "edges"), seeds.select("surfer", "id", "p")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(seeds.select("id")).distinct()
    ids, n = numbered(ids, "nodes")
    if n > small:
        return by_joins(edges, seeds, cfg, iterations)
    return by_surfer(edges, ids, n, seeds, cfg, iterations)


def numbered(keys: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The one column of keys with a `number` from 0, as a written table, and how many there are: places within a
    partition, behind those of the partitions before it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    made = written(keys.withColumns({"_part": F.spark_partition_id(), "_place": place}), name)
    counts = sorted(made.groupBy("_part").agg(F.count("*")).collect())
    starts = np.cumsum([0] + [r[1] for r in counts]).tolist()
    first = keys.sparkSession.createDataFrame([(r[0], k) for r, k in zip(counts, starts, strict=False)], "_part int, _first long")
    return made.join(F.broadcast(first), "_part").select(*keys.columns, (F.col("_first") + F.col("_place")).alias("number")), starts[-1]


def by_surfer(edges: DataFrame, ids: DataFrame, n: int, seeds: DataFrame, cfg: Config, iterations: int | None) -> tuple[DataFrame, int, bool]:
    """The numbered graph goes in messages to a task for every few surfers, which keeps it in a file of its own and
    reads it once a step; a task holds a few numbers a node and nothing an edge.

    The change of a step shrinks with every step, so all surfers are done after the most steps that one needs.
    """
    spark, d, tolerance, most = edges.sparkSession, cfg.damping, cfg.tolerance, cfg.max_iterations
    surfers, count = numbered(seeds.select("surfer").distinct(), "surfers")
    groups = max(1, -(-count // SURFERS))
    names = ["surfer", "number", "other", "id", "p"]
    schema = "surfer long, number array<int>, other array<int>, id array<long>, p array<double>"

    def lists(df: DataFrame) -> DataFrame:
        """Messages of the columns of df, the others null."""
        own = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = {"surfer": pa.int64(), "number": pa.list_(pa.int32()), "other": pa.list_(pa.int32()), "id": pa.list_(pa.int64()), "p": pa.list_(pa.float64())}
            for batch in batches:
                ends = pa.array(np.r_[np.arange(0, batch.num_rows, MESSAGE), batch.num_rows].astype(np.int32))
                columns = [pa.ListArray.from_arrays(ends, batch.column(own.index(c))) if c in own else pa.nulls(len(ends) - 1, types[c]) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return df.mapInArrow(run, schema)

    def of(column: str) -> DataFrame:
        return ids.select(F.col("id").alias(column), F.col("number").cast("int").alias(f"_{column}"))

    linked = edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("number"), F.col("_dst").alias("other"))
    graph = lists(linked).union(lists(ids.select(F.col("number").cast("int").alias("number"), "id")))
    graph = graph.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    none = F.lit(None)
    own = seeds.join(ids, "id").join(surfers.select("surfer", (F.col("number") % groups).cast("int").alias("group")), "surfer")
    own = own.select("surfer", F.array(F.col("number").cast("int")).alias("number"), none.cast("array<int>").alias("other"), none.cast("array<long>").alias("id"), F.array("p").alias("p"), "group")
    dealt = graph.union(own).withColumn("group", spread(spark, groups)(F.col("group"))).repartition(min(groups, 10_000), "group")

    def solved(batches: Iterator[pa.RecordBatch], steps: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(surfer, ids, scores, steps; -1 if it did not converge) of a task's surfers; the graph is that of any one of
        its groups."""
        node, degree, seen, mine = np.zeros(n, np.int64), np.zeros(n, np.int64), None, {}
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                own = batch.filter(pc.is_valid(batch.column("surfer")))
                who, at, p = own.column("surfer").to_numpy(), own.column("number").flatten().to_numpy(), own.column("p").flatten().to_numpy()
                for surfer in np.unique(who):
                    mine.setdefault(int(surfer), []).append((at[who == surfer], p[who == surfer]))
                rest = batch.filter(pc.is_null(batch.column("surfer")))
                if seen is None and rest.num_rows:
                    seen = rest.column("group")[0].as_py()
                rest = rest.filter(pc.equal(rest.column("group"), pa.scalar(seen, pa.int32())))
                named = rest.filter(pc.is_valid(rest.column("id")))
                node[named.column("number").flatten().to_numpy()] = named.column("id").flatten().to_numpy()
                links = rest.filter(pc.is_valid(rest.column("other")))
                src, dst = links.column("number").flatten().to_numpy(), links.column("other").flatten().to_numpy()
                np.add.at(degree, src.astype(np.intp), 1)
                np.stack([src, dst], axis=1).astype(np.int32).tofile(file)
            file.flush()
            stuck = degree == 0
            weight = 1.0 / np.maximum(degree, 1)
            for surfer, parts in mine.items():
                p = np.zeros(n)
                for at, x in parts:
                    np.add.at(p, at.astype(np.intp), x)
                x, k, change = p.copy(), 0, np.inf
                while k < (steps or most):
                    y, after = x * weight, np.zeros(n)
                    file.seek(0)
                    while len(some := np.fromfile(file, np.int32, 1 << 21)):
                        np.add.at(after, some[1::2].astype(np.intp), y[some[::2]])
                    after *= d
                    after += (d * x[stuck].sum() + 1 - d) * p
                    change, x, k = np.abs(after - x).sum(), after, k + 1
                    if steps is None and change <= tolerance:
                        break
                yield surfer, node, x, k if steps or change <= tolerance else -1

    converged = True
    if iterations is None:
        dealt = written(dealt, "messages").repartition(min(groups, 10_000), "group")

        def needed_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([k for *_, k in solved(batches, None)], pa.int32())], names=["k"])

        needed = dealt.mapInArrow(needed_steps, "k int").agg(F.max("k"), F.min("k")).first()
        converged = needed[1] is None or needed[1] >= 0
        iterations = (needed[0] or 0) if converged else most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for surfer, node, x, _ in solved(batches, iterations):
            for at in range(0, n, 1 << 16):
                keep = x[at : at + (1 << 16)] > 0
                found = node[at : at + (1 << 16)][keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), surfer)), pa.array(found), pa.array(x[at : at + (1 << 16)][keep])], names=["surfer", "id", "x"])

    return dealt.mapInArrow(rows, "surfer long, id long, x double"), iterations, converged


def spread(spark: SparkSession, groups: int):
    """A function of a group's number that gives each group a key of its own shuffle task; where groups are many, the
    number."""
    if groups > 1000:
        return lambda group: group
    key = F.pmod(F.hash(F.col("id").cast("int")), F.lit(groups))
    keys = [r.id for r in spark.range(groups * 40).groupBy(key.alias("task")).agg(F.min("id").alias("id")).collect()]
    keys += sorted(set(range(2 * groups)) - set(keys))  # should a task have none
    return lambda group: F.element_at(F.array(*(F.lit(k).cast("int") for k in keys[:groups])), group + 1)


def by_joins(edges: DataFrame, seeds: DataFrame, cfg: Config, iterations: int | None) -> tuple[DataFrame, int, bool]:
    """A join per step: one shuffle on src meets the weights, partial sums by (surfer, dst) meet in a second; the
    dangling mass is one number per surfer.  Every iterate is a written table, of which the last two are kept."""
    d = cfg.damping
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    weights = written(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("n")).alias("w")), "weights")
    sources = weights.select("src").distinct()
    x, path = written_at(seeds.select("surfer", "id", F.col("p").alias("x")), "iterate")
    for step in range(1, (iterations or cfg.max_iterations) + 1):
        stuck = x.join(sources, F.col("id") == F.col("src"), "left_anti").groupBy("surfer").agg(F.sum("x").alias("stuck"))
        flow = x.join(weights, F.col("id") == F.col("src")).select("surfer", F.col("dst").alias("id"), (d * F.col("x") * F.col("w")).alias("x"))
        back = seeds.join(stuck, "surfer", "left").select("surfer", "id", ((d * F.coalesce("stuck", F.lit(0.0)) + (1 - d)) * F.col("p")).alias("x"))
        after, new_path = written_at(flow.union(back).groupBy("surfer", "id").agg(F.sum("x").alias("x")), "iterate")
        if iterations is None:
            change = after.withColumn("s", F.lit(1.0)).union(x.withColumn("s", F.lit(-1.0))).groupBy("surfer", "id").agg(F.sum(F.col("x") * F.col("s")).alias("delta"))
            worst = change.groupBy("surfer").agg(F.sum(F.abs("delta")).alias("l1")).agg(F.max("l1")).first()[0]
            if worst is None or worst <= cfg.tolerance:
                remove(edges.sparkSession, path)
                return after, step, True
        remove(edges.sparkSession, path)
        x, path = after, new_path
    return x, iterations or cfg.max_iterations, iterations is not None


def top_scores(scores: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """The k best positive scores of each surfer."""
    rank = F.row_number().over(Window.partitionBy("surfer").orderBy(F.desc("x"), "id"))
    return scores.filter("x > 0").withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def domain_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(domain, score): mean over all the domain's documents, positive ones only; scores(id, x)."""
    return nodes.join(scores, "id", "left").groupBy("domain").agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("score")).filter("score > 0")


def resolve_redirects(urls: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, doc, target, changed): every URL that redirects, with its target's document; urls(id, target, doc).

    In each round all take the document that their target had before it, so a document travels one redirect a round;
    a target without a document changes nothing.  `changed` is the round of the last change, null for none: the log
    of decisions.
    """
    state = urls.select("id", "target", "doc", F.lit(None).cast("int").alias("changed"))
    for k in range(1, rounds + 1):
        of = state.filter("doc IS NOT NULL").select(F.col("id").alias("_id"), F.col("doc").alias("_doc"))
        differs = F.col("_doc").isNotNull() & ~F.col("doc").eqNullSafe(F.col("_doc"))
        joined = state.join(of, F.col("target") == F.col("_id"), "left")
        state = written(joined.select("id", "target", F.coalesce("_doc", "doc").alias("doc"), F.when(differs, k).otherwise(F.col("changed")).alias("changed")), "redirects")
        if not state.filter(F.col("changed") == k).head(1):
            break
    return state.filter("target IS NOT NULL").select("id", "doc", "target", "changed")


def domain_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): distinct links between documents of different domains."""
    of = nodes.select(F.col("id").alias("_id"), "domain")
    a = edges.join(of, F.col("src") == F.col("_id")).select(F.col("domain").alias("a"), "dst")
    return a.join(of, F.col("dst") == F.col("_id")).select("a", F.col("domain").alias("b")).filter("a <> b").distinct()


def reach(adjacency: DataFrame, pins: DataFrame, hops: int = 2) -> DataFrame:
    """(surfer, domain, hops, path): domains first reached in that many hops; the path leads to the linking domain,
    ties to the least one.  Pinned domains are left out."""
    layer = pins.distinct().select("surfer", "domain", F.array().cast("array<string>").alias("path"))
    seen, out = layer.select("surfer", "domain"), None
    for k in range(1, hops + 1):
        step = layer.join(adjacency, F.col("domain") == F.col("a")).select("surfer", F.col("b").alias("domain"), F.col("a").alias("via"), F.concat("path", F.array(F.col("a").cast("string"))).alias("path"))
        step = step.join(seen.withColumnsRenamed({"surfer": "_s", "domain": "_d"}), (F.col("surfer") == F.col("_s")) & (F.col("domain") == F.col("_d")), "left_anti")
        layer = step.withColumn("r", F.row_number().over(Window.partitionBy("surfer", "domain").orderBy("via"))).filter("r = 1").select("surfer", "domain", "path")
        found = layer.withColumn("hops", F.lit(k).cast("long"))
        out = found if out is None else out.unionByName(found)
        seen = seen.union(layer.select("surfer", "domain"))
    return out.select("surfer", "domain", "hops", "path")
