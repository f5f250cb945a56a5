"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary n-gram classifier (log ratio of smoothed n-gram frequencies
between the languages whose bit is 1 and the others) over hashed byte trigrams of the whole lower-cased text.
Decoding weighs each bit's logistic loss by how well that bit did in training and takes the codeword of least
loss; the score is its share among all codewords, and a text whose two best codewords lie close is flagged
ambiguous.

The classifier is fitted on at most PER_LANGUAGE labelled rows of each language, those of the least hashes of
doc_id and text among the training folds.  Predictions read the text alone and every text whole.

Edge cases: a null text or one without letters is `und` with score 0; without any labelled row everything is
`und`; a single learned language is predicted with score 1; a null doc_id is not held out; repeated rows each get
a row, and train once however often they are chosen; further columns pass through `identify`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each language that the fit reads at most.
PER_LANGUAGE = 300
BINS = 1 << 16
FOLDS, HELD_OUT = 3, 1
CHUNK = 1 << 18
#: Below this difference of the two best codewords' mean loss a text is ambiguous.
AMBIGUOUS = 0.02


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all different splits for few languages, else a fixed random code."""
    if n <= 6:
        columns = [[1 if (k >> i) & 1 == 0 else -1 for i in range(n)] for k in range(2, 1 << n, 2)]
        return np.array(columns, np.int8).reshape(-1, n).T
    bits = 10 * math.ceil(math.log2(n))
    random = np.random.RandomState(7)
    best = max((random.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50)), key=lambda c: -np.max(c @ c.T - 2 * bits * np.eye(n)))
    return best


def bins_of(raw: np.ndarray) -> np.ndarray:
    """Hashed trigram starting at each byte but the last two."""
    code = raw[:-2].astype(np.uint32) << np.uint32(16) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def prepared(text: str) -> bytes:
    return text.lower().encode()


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BINS + 1, bits); the last row is zero
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each bit for each text, and the number of n-grams."""
        n = np.array([len(t) for t in texts], np.int64)
        out, counts = np.zeros((len(texts), self.code.shape[1])), np.maximum(n - 2, 0)
        at = 0
        while at < len(texts):
            end, size = at + 1, n[at]
            while end < len(texts) and size + n[end] <= CHUNK:
                size += n[end]
                end += 1
            for k in range(at, end) if size > CHUNK else ():  # one very long text, in pieces that overlap
                raw = np.frombuffer(texts[k], np.uint8)
                for a in range(0, max(len(raw) - 2, 0), CHUNK):
                    out[k] += self.weights[bins_of(raw[a : a + CHUNK + 2])].sum(0, dtype=np.float64)
            if size <= CHUNK:
                raw = np.frombuffer(b"  ".join(texts[at:end]) + b"    ", np.uint8)
                begin = np.concatenate([[0], np.cumsum(n[at:end] + 2)])
                bins = bins_of(raw).astype(np.int64)
                inside = np.zeros(len(bins) + 1, np.int64)
                full = counts[at:end] > 0
                np.add.at(inside, begin[:-1][full], 1)
                np.add.at(inside, (begin[:-1] + counts[at:end])[full], -1)
                bins[np.cumsum(inside[:-1]) == 0] = BINS
                out[at:end] = np.add.reduceat(self.weights[bins], np.minimum(begin[:-1], len(bins) - 1), axis=0, dtype=np.float64)
            at = end
        return out / np.maximum(counts, 1)[:, None], counts

    def decode(self, margins: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        if len(self.languages) == 1:
            return [self.languages[0]] * len(margins), np.ones(len(margins)), np.zeros(len(margins), bool)
        z = margins * np.sqrt(np.maximum(counts, 1))[:, None]
        loss = np.stack([np.logaddexp(0, -z * c) @ self.trust for c in self.code], 1)
        mean = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.code], 1) / max(self.trust.sum(), 1e-9)
        two = np.sort(mean, 1)[:, :2]
        share = np.exp(loss.min(1, keepdims=True) - loss)
        best = loss.argmin(1)
        return [self.languages[k] for k in best], 1 / share.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bins, shares): n-gram frequencies of each training text."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = np.frombuffer(prepared(text), np.uint8)
            if len(raw) >= 3:
                bins, n = np.unique(bins_of(raw), return_counts=True)
                yield lang, bins, n / n.sum()


def chosen(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): at most per_language training rows of each language, those of the least hashes.

    A language of many rows keeps only hashes below a threshold that about twice as many pass; so no task ever
    ranks all rows of a language.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * per_language / F.count("*")).alias("share"))
    rows = labelled.filter(F.octet_length("text") > 2).withColumn("text_hash", F.xxhash64("text")).withColumn("h", F.xxhash64("doc_id", "text_hash"))
    ids = rows.select("lang", "doc_id", "text_hash", "h").join(F.broadcast(share), "lang")  # a row a language
    ids = ids.filter(F.shiftrightunsigned("h", 11) < F.col("share") * float(1 << 53)).select("lang", "doc_id", "text_hash", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash"))
    ids = ids.withColumn("rank", rank).filter(F.col("rank") <= per_language).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(F.broadcast(ids), same).dropDuplicates(["doc_id", "lang", "text_hash"]).select("lang", "text")  # per_language ids of each language


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of the labelled training rows of `docs` (doc_id, text, lang); None if there are none.

    Counts are summed in Spark; to the driver come one row a language and two sums a bin and bit.
    """
    rows, path = common.written(chosen(docs, per_language), "training-rows")
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(seen)
    if not names:
        common.remove(docs.sparkSession, path)
        return None
    code = codewords(len(names))
    of, bits, floor = {x: k for k, x in enumerate(names)}, code.shape[1], 1e-6

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bit, bin, yes, no): mean frequencies of the languages whose bit is 1 and of the others."""
        total = np.zeros((2, bits, BINS))
        for lang, bins, shares in histograms(batches):
            for b in range(bits):
                side = int(code[of[lang], b] < 0)
                total[side, b, bins] += shares / seen[lang] / (code[:, b] == code[of[lang], b]).sum()
        for b in range(bits):
            used = np.flatnonzero(total[:, b].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), b, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[0, b, used]), pa.array(total[1, b, used])], names=["bit", "bin", "yes", "no"])

    found = rows.mapInArrow(sums, "bit int, bin int, yes double, no double").groupBy("bit", "bin").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()
    both = np.zeros((2, BINS, bits))
    for side, name in enumerate(("yes", "no")):
        both[side, found.column("bin").to_numpy(), found.column("bit").to_numpy()] = found.column(name).to_numpy()
    weights = np.zeros((BINS + 1, bits), np.float32)
    weights[:BINS] = np.log((both[0] + floor) / (both[1] + floor))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BINS x bits, of fixed size

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(bits, np.int64)
        for lang, bins, shares in histograms(batches):
            right += (shares @ shared.value[bins]) * code[of[lang]] > 0
        yield pa.RecordBatch.from_arrays([pa.array(range(bits), pa.int32()), pa.array(right)], names=["bit", "right"])

    right = np.zeros(bits)
    for r in rows.mapInArrow(verdicts, "bit int, right long").groupBy("bit").agg(F.sum("right").alias("right")).collect():
        right[r["bit"]] = r["right"] / sum(seen.values())
    common.remove(docs.sparkSession, path)
    trust = np.where(right > 0.5, np.log((right + 0.01) / (1.01 - right)), 0.0)
    return Model(names, code, weights, trust / max(trust.sum(), 1e-9) * len(trust))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred, score and ambiguous; columns of `docs` that have these names are replaced."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x bits weights, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if t and letter.search(t)] if model else []
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                got, scores, flags = model.decode(*model.margins([prepared(texts[k]) for k in known]))
                for k, x in zip(known, got, strict=True):
                    lang[k] = x
                score[known], unsure[known] = scores, flags
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(unsure)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, lang_pred string, score double, ambiguous boolean")


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
