"""Benchmark decontamination with a broadcast hash set of normalised test n-grams; DataFrame functions only.

The benchmark's windows of 13 words form a small table: broadcast after its bytes are counted.  Beyond MOST_BROADCAST
bytes the windows are joined by a shuffle of the positions that their first words let through; their first words, at 16
bytes each, are broadcast up to the same bound by themselves, and beyond it every position of every document is joined
with them by a shuffle.  Every position of every document looks up its first few words (`lead` words, as many as the
shortest window allows, 3 at most) in the set of leads; this lookup sits in the same generated code as the
explode, so the words array is never copied for the positions that miss.  Survivors build their whole window and
verify it by equality with the window text itself, not a hash.  Of each document one row and its hits are shuffled.

Edge cases: very long texts and items are read whole; null or wordless texts have n_words 0 and no hit; null items have no window; an item with a null id
counts under the id ''; repeated documents or items change nothing; empty tables give empty results or no hits;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that still has its capitals.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: The most bytes of benchmark windows that are broadcast.
MOST_BROADCAST = 128 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, lead_words, len, items): each distinct window of the benchmark with the ids of its items."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    grams = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram"), F.size("g").alias("len")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_hash, n_words, spans (array of [start, length)), items."""
    grams, _ = common.written(windows(benchmark, window), "benchmark-windows")
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + 64
    found = grams.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"), F.min("len").alias("least"), F.collect_set("len").alias("lens")).first()
    lead = min(3, found["least"] or 1)

    def small(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= MOST_BROADCAST else df


    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    shifted = [F.slice("w", k + 1, 1 << 30).alias(f"w{k}") for k in range(lead)]
    at = words.select("*", F.posexplode_outer(F.arrays_zip(*shifted) if lead > 1 else F.col("w")).alias("pos", "z"))
    parts = [F.col("z")[f"w{k}"] for k in range(lead)] if lead > 1 else [F.col("z")]
    leads = grams.select(F.xxhash64(*(F.element_at(F.split("gram", " "), k + 1) for k in range(lead))).alias("lead_key")).distinct()
    leads = small(leads.withColumn("led", F.lit(True)), 16 * found["n"])
    near = at.withColumn("lead_key", F.xxhash64(*parts)).join(leads, "lead_key", "left").filter("led OR pos IS NULL OR pos = 0")
    lens = F.array(*(F.lit(int(x)) for x in sorted(found["lens"]))) if found["lens"] else F.array(F.lit(window))
    tried = near.select(
        "doc_id", "text_hash", F.size("w").alias("n_words"), "pos",
        F.explode(F.transform(lens, lambda n: F.struct(n.alias("len"), F.when(F.col("led") & (F.col("pos") + n <= F.size("w")), F.array_join(F.slice("w", F.col("pos") + 1, n), " ")).alias("gram")))).alias("t"),
    )
    checked = tried.select("doc_id", "text_hash", "n_words", "pos", "t.len", "t.gram").join(small(grams.select("gram", "items"), found["bytes"] or 0), "gram", "left")
    kept = checked.filter("items IS NOT NULL OR pos IS NULL OR pos = 0")
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("pos").alias("start"), F.col("len")))
    return kept.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def n_covered(spans: Column) -> Column:
    """How many words sorted spans cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["len"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, step)["n"].cast("long")


def gaps(spans: Column, n: Column) -> Column:
    """The runs [start, end) of 0..n that sorted spans leave, found in one pass over them."""
    start = F.struct(F.lit(0).alias("end"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["end"].alias("start"), s["start"].alias("end"))
        return F.struct(F.greatest(acc["end"], s["start"] + s["len"]).alias("end"), F.when(s["start"] > acc["end"], F.array_append(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    return F.aggregate(spans, start, step, lambda acc: F.array_append(acc["gaps"], F.struct(acc["end"].alias("start"), n.alias("end"))))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hits() with n_hit, n_items and the verdict `contaminated`: at least a twentieth of the words are hit."""
    return (
        hits(docs, benchmark, window)
        .withColumn("n_hit", n_covered(F.col("spans")))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items, contaminated, text_hash, spans."""
    found = scan(docs, benchmark, window)
    counts = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("copies"))
    more = counts.filter("copies > 1")
    again = found.alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash")), "left").select("f.*", F.coalesce("m.copies", F.lit(1)).alias("copies"))
    return again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without contaminated documents; from the others the hit words are cut out of the text, each with
    the separators before it.  Untouched documents keep their text byte for byte."""
    id_, hash_, spans, bad, pieces, left = (common.unused(docs, c) for c in ("_id", "_hash", "_spans", "_bad", "_pieces", "_gaps"))
    found = scan(docs, benchmark, window).filter("n_hit > 0").select("doc_id", "text_hash", "spans", "contaminated").toDF(id_, hash_, spans, bad)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(docs["text"]) == found[hash_]), "left").filter(~F.coalesce(F.col(bad), F.lit(False)))
    separators = RAW_WORD.replace("[^", "[").replace("]+", "]*")
    touched = F.size(spans) > 0
    split = joined.withColumn(pieces, F.when(touched, F.regexp_extract_all("text", F.lit(f"{separators}{RAW_WORD}"), F.lit(0))))
    split = split.withColumn(left, F.when(touched, gaps(F.col(spans), F.size(pieces))))
    kept = F.flatten(F.transform(left, lambda g: F.slice(F.col(pieces), g["start"] + 1, g["end"] - g["start"])))
    rest = F.regexp_extract("text", f"{separators}$", 0)
    text = F.when(touched, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("text"))
    return split.withColumn("text", F.coalesce(text, F.col("text"))).select(*docs.columns)


def op2_ngram_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP2_SQL = r"""
WITH iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS gram
  FROM (SELECT item, w[i : i + 12] AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM iw WHERE len(w) > 0))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lens AS (SELECT DISTINCT n FROM grams
), tried AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT a.doc_id, a.i, a.n, g.item FROM tried a JOIN grams g USING (gram)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
