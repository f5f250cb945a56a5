"""Chat formatting: a hidden Markov model recovers the roles of a transcript's blocks before rendering.

Texts are first cut before lines that open with a speaker marker; a block is a run of lines, and its observation
combines the marker that it opens with, its number of lines and its length.  Markers act through the emissions alone:
the probability of a marker under each role is counted, smoothed by a prior that expects a marker to name its role.
Transitions and emissions come from labelled blocks, counted in Spark over all of them (the tables have as many rows as
there are states and observations).  Viterbi finds each conversation's roles, and turns are rendered canonically:
<|role|>, the text without its marker, <|end|>.

A conversation is cut into segments by turn number and these, as sorted rows stream by, into runs of SEGMENT blocks, so
that neither has to fit a task: first every run gives its 3 x 3 max-plus matrix (best score from the state before it to
its last state), then the matrices of a conversation are folded, and with its two end states known every run is decoded
by itself.  This equals Viterbi over the whole conversation.  Many blocks of one turn number are one segment, which one
task streams over.

Edge cases: null and empty texts are blocks of no lines; very long texts are blocks like others; blocks that share a
turn number are ordered by text; repeated rows are blocks of their own; a null conv_id is a conversation, a null turn
comes first; without labels all states are alike and ties go to the first role; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

ROLES = ("user", "assistant", "system")
SEGMENT = 256
#: Weight, in blocks, of the prior of markers.
MARKED = 20.0
FOLDS, HELD_OUT = 3, 1
#: Speaker words that open a block, by role; after them comes a colon or a closing bracket.
MARKERS = {"user": "user|human|customer|me|q|question|prompt", "assistant": "assistant|bot|ai|agent|model|a|answer|response", "system": "system|instructions?"}


def marker_pattern(role: str) -> str:
    """`User:`, `**Human:**`, `### Assistant:`, `[BOT]`, `<|system|>` and the like at the start of a block."""
    words = MARKERS[role]
    return rf"(?i)^\s*(?:(?:#+\s*|\*+|>\s*)?(?:{words})\s*\**:\**|\[(?:{words})\]|<\|?(?:{words})\|?>)\s*"


def marker_of(text: Column) -> Column:
    out = F.lit("none")
    for role in reversed(ROLES):
        out = F.when(text.rlike(marker_pattern(role)), role).otherwise(out)
    return out


def without_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "|".join(f"(?:{marker_pattern(r)})" for r in ROLES), ""))


def observation(text: Column, first: Column) -> Column:
    """One word for what the model sees of a block."""
    text = F.coalesce(text, F.lit(""))
    lines, size = F.size(F.split(text, "\n")), F.length(text)
    lines = F.when(lines == 1, "1").when(lines == 2, "2").when(lines < 5, "3").otherwise("5")
    size = F.when(size == 0, "0").otherwise(F.least(F.lit(7), F.floor(F.log2(1 + size / 50))).cast("string"))
    return F.concat_ws("/", marker_of(text), lines, size, F.when(first, "first").otherwise("later"))


def _starts() -> str:
    return "|".join(f"(?={marker_pattern(r)[4:].replace('^', '', 1)})" for r in ROLES)


def marked_blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, part, text[, role]): rows of conversations, cut before inner lines that open with a marker.

    A row without such lines is one block with its text unchanged; a role stays with the first block of its row.
    """
    cut = F.split(F.coalesce("text", F.lit("")), rf"\n(?i:{_starts()})")
    parts = rows.select("conv_id", "turn", *(["role"] if "role" in rows.columns else []), F.posexplode(cut).alias("part", "text"))
    return parts.withColumn("role", F.when(F.col("part") == 0, F.col("role"))) if "role" in rows.columns else parts


def transcript_blocks(transcripts: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """(conv_id, turn, text): raw transcripts cut before blank lines and lines that open with a marker."""
    cut = F.split(F.col(text), rf"\n\s*\n|\n(?i:{_starts()})")
    blocks = transcripts.select(F.col(key).alias("conv_id"), F.posexplode(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")).alias("turn", "text"))
    return blocks.withColumn("turn", F.col("turn").cast("long"))


def numbered(blocks: DataFrame) -> DataFrame:
    """conv_id, turn, part, text[, role], seg: blocks with their segment, and what the model sees of them.

    The segment follows from the turn number, so no conversation is sorted whole.
    """
    turn = F.coalesce(F.col("turn"), F.lit(-1)).cast("long")
    part = F.col("part") if "part" in blocks.columns else F.lit(0)
    names = [c for c in blocks.columns if c != "part"]
    return blocks.select(*names, part.cast("int").alias("part"), F.floor(turn / SEGMENT).alias("seg"), observation(F.col("text"), (turn <= 0) & (part == 0)).alias("seen"))


def order() -> list[Column]:
    return [F.coalesce(F.col("turn"), F.lit(-1)), F.col("part"), F.coalesce(F.col("text"), F.lit(""))]


class Hmm:
    """Log probabilities of start, transition and emission.  An emission is that of the marker times that of the rest
    of the observation; both are smoothed, so neither a marker nor a rest that was never seen decides alone."""

    def __init__(self, starts: dict, moves: dict, emissions: dict):
        n = len(ROLES)
        self.start = np.array([starts.get(r, 0) + 1 for r in ROLES], float)
        self.start = np.log(self.start / self.start.sum())
        self.move = np.array([[moves.get((a, b), 0) + 0.1 for b in ROLES] for a in ROLES], float)
        self.move = np.log(self.move / self.move.sum(1, keepdims=True))
        markers, rests = ("none", *ROLES), sorted({o.split("/", 1)[1] for _, o in emissions})
        # the prior of markers: as many blocks as MARKED with a marker, of which nearly all name their role
        of_marker = np.array([[MARKED * (1.0 if m == "none" else 0.97 if m == r else 0.015) for m in markers] for r in ROLES])
        of_rest = np.full((n, len(rests) + 1), 0.1)
        for (role, seen), count in emissions.items():
            marker, rest = seen.split("/", 1)
            of_marker[ROLES.index(role), markers.index(marker)] += count
            of_rest[ROLES.index(role), rests.index(rest)] += count
        of_marker, of_rest = (np.log(x / x.sum(1, keepdims=True)) for x in (of_marker, of_rest))
        self.emission = {m: of_marker[:, k] for k, m in enumerate(markers)}
        self.rest = {r: of_rest[:, k] for k, r in enumerate(rests)}
        self.unseen = of_rest[:, -1]
        self.n = n

    def scores(self, seen: list[str]) -> np.ndarray:
        split = (o.split("/", 1) for o in seen)
        return np.array([self.emission[m] + self.rest.get(r, self.unseen) for m, r in split]).reshape(-1, self.n)

    def segment(self, seen: list[str], first: bool) -> np.ndarray:
        """Best score from each state before the segment (any, if it is the first) to each last state."""
        e = self.scores(seen)
        best = np.tile(self.start + e[0], (self.n, 1)) if first else self.move + e[0]
        for row in e[1:]:
            best = (best[:, :, None] + self.move[None]).max(1) + row
        return best

    def decode(self, seen: list[str], before: int | None, last: int | None) -> list[int]:
        """States of a segment between two known ones; ties go to the earlier role."""
        e = self.scores(seen)
        best, back = (self.start if before is None else self.move[before]) + e[0], []
        for row in e[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(0))
            best = total.max(0) + row
        states = [int(best.argmax()) if last is None else last]
        for from_ in reversed(back):
            states.append(int(from_[states[-1]]))
        return states[::-1]


def train(blocks: DataFrame) -> Hmm:
    """Counts of the labelled blocks outside the held-out fold of conversations.

    Transitions inside a segment come from its rows, those between segments from the last and first rows of each.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = numbered(blocks.select("conv_id", "turn", "text", "role", *(["part"] if "part" in blocks.columns else []))).filter(F.col("role").isin(*ROLES) & (fold != HELD_OUT))
    inside = rows.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id", "seg").orderBy(*order())))
    counted = inside.groupBy("role", "before", "seen").count().collect()  # states x states x observations at most
    place = F.struct(*order())
    ends = rows.groupBy("conv_id", "seg").agg(F.min_by("role", place).alias("first"), F.max_by("role", place).alias("last"))
    last = F.lag("last").over(Window.partitionBy("conv_id").orderBy("seg"))  # a row a segment
    between = ends.withColumn("before", last).filter("before IS NOT NULL").groupBy("before", "first").count().collect()
    starts, moves, emissions = {}, {}, {}
    for r in counted:
        emissions[r["role"], r["seen"]] = emissions.get((r["role"], r["seen"]), 0) + r["count"]
        if r["before"] is not None:
            moves[r["before"], r["role"]] = moves.get((r["before"], r["role"]), 0) + r["count"]
        elif r["seen"].endswith("first"):
            starts[r["role"]] = starts.get(r["role"], 0) + r["count"]
    for r in between:
        moves[r["before"], r["first"]] = moves.get((r["before"], r["first"]), 0) + r["count"]
    return Hmm(starts, moves, emissions)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in runs of SEGMENT, the last one aside."""
    while part := list(islice(rows, SEGMENT)):
        yield part


def parse(blocks: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, turn, part, role, text, rendered) for every block of (conv_id, turn[, part], text).

    Segments and conversations come as sorted rows, so a task streams over them and holds one run of blocks.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(hmm)  # a few hundred numbers
    rows = numbered(blocks.select("conv_id", "turn", "text", *(["part"] if "part" in blocks.columns else [])))
    conv = blocks.schema["conv_id"].dataType
    ids, size, n = to_arrow_type(conv), len(ROLES), common.tasks_for(blocks, 8 << 20)
    kind = conv.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (conv_id, seg), own in groupby(rows_of(batches), key=lambda r: r[:2]):
                for k, run in enumerate(runs(own)):
                    seen = [r[2] for r in run]
                    yield conv_id, seg, k, [*shared.value.segment(seen, True)[0].tolist(), *shared.value.segment(seen, False).ravel().tolist()]

        yield from batched(found(), pa.schema([("conv_id", ids), ("seg", pa.int64()), ("run", pa.int64()), ("best", pa.list_(pa.float64()))]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv_id, own in groupby(rows_of(batches), key=lambda r: r[0]):
                places, best, back = [], None, []
                for _, seg, run, flat in own:
                    places.append((seg, run))
                    flat = np.array(flat)
                    if best is None:
                        best = flat[:size]
                    else:
                        total = best[:, None] + flat[size:].reshape(size, size)
                        back.append(total.argmax(0).astype(np.int8))
                        best = total.max(0)
                last = [int(best.argmax())]
                for from_ in reversed(back):
                    last.append(int(from_[last[-1]]))
                last.reverse()
                yield from ((conv_id, seg, run, before, state) for (seg, run), before, state in zip(places, [None, *last], last, strict=False))

        yield from batched(found(), pa.schema([("conv_id", ids), ("seg", pa.int64()), ("run", pa.int64()), ("before", pa.int32()), ("last", pa.int32())]))

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, own in groupby(rows_of(batches), key=lambda r: r[:2]):
                ends, first = [], None
                for r in own:  # the ends of a segment's runs come before its rows
                    if not r[2]:
                        first = r
                        break
                    ends.append(r[3:5])
                for (before, last), run in zip(ends, runs(chain([first], own)), strict=True):
                    states = shared.value.decode([r[5] for r in run], before, last)
                    yield from ((r[0], r[6], r[7], ROLES[s], r[8]) for r, s in zip(run, states, strict=True))

        yield from batched(found(), pa.schema([("conv_id", ids), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())]))

    dealt = rows.repartition(n, "conv_id", "seg").sortWithinPartitions("conv_id", "seg", *order())
    segments = dealt.select("conv_id", "seg", "seen").mapInArrow(matrices, f"conv_id {kind}, seg long, run long, best array<double>")
    ends = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seg", "run").mapInArrow(fold, f"conv_id {kind}, seg long, run long, before int, last int")
    columns = ["conv_id", "seg", "is_end", "before", "last", "seen", "turn", "part", "text"]
    none = F.lit(None)
    both = ends.select(
        "conv_id", "seg", F.lit(True).alias("is_end"), "before", "last", none.cast("string").alias("seen"), F.col("run").alias("turn"), F.lit(0).alias("part"), none.cast("string").alias("text")
    ).unionByName(
        rows.select("conv_id", "seg", F.lit(False).alias("is_end"), none.cast("int").alias("before"), none.cast("int").alias("last"), "seen", F.col("turn").cast("long").alias("turn"), "part", "text")
    )
    known = both.repartition(n, "conv_id", "seg").sortWithinPartitions("conv_id", "seg", F.desc("is_end"), *order()).select(*columns)
    found = known.mapInArrow(roles, f"conv_id {kind}, turn long, part int, role string, text string")
    return found.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), without_marker(F.coalesce("text", F.lit(""))), F.lit("\n<|end|>\n")))


def op3_hmm_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = marked_blocks(common.table(spark, sf_dir, "conversations"))
    return parse(blocks, train(blocks)).select("conv_id", "turn", "part", "role", "rendered")
