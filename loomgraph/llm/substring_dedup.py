"""Exact-substring deduplication: every word that lies in a repeated window of 35 words goes.

Rabin-Karp hashes of all windows come from prefix sums modulo 2^64 (numpy, whole texts).  Runs of documents become
blocks of BLOCK_BYTES of text, each packed into one row.  A block sends each bucket its sorted distinct window hashes,
so that a window of a hot passage goes out once per block however often it occurs.  A bucket counts its hashes over
all blocks and answers each block with one bit per hash sent.  Blocks, which went through the same exchange, turn the
bits into repeated windows, merge them into maximal intervals and cut.  Nothing of corpus size reaches the driver or a
broadcast; what a task holds is one block of text or one bucket of hashes, both bounded by bytes of text and not of
compressed files, and their numbers grow with the input.

The count is over arrays of hashes and not over rows of Spark: a row a window, there and back, would shuffle several
times the input.  A window's identity is 64 bits inside a bucket that an independent second hash chose: with b
buckets, 64 + log2(b) bits.  For n windows the expected number of false pairs is n^2 / (b 2^65), below 1e-3 at 30 GB
(n = 8e9, b > 6e3).

Edge cases: null or short texts have no window and keep all words; repeated rows repeat each other's windows;
windows never span two documents; a text longer than a block is a block of its own; an empty table gives an empty
result; further columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

WINDOW = 35
#: Bytes of text after which a block ends; a bucket gets the windows of twice as many on average.
BLOCK_BYTES = 4 << 20
#: Bytes of text that a task of the exchange stands for.
TASK_BYTES = 32 << 20
#: Text hashed at a time.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.RandomState(20240607)
_BYTES = _RANDOM.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 5 for x in _RANDOM.randint(1 << 40, 1 << 62, 3, dtype=np.int64)]


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rabin-Karp hash of values[start:end] for each pair."""
        up, down = self.to(len(values) + 1)
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * down[starts]


_OF_BYTES, _FIRST, _SECOND = map(Powers, _BASES)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a run of texts: byte positions and, per text, the range of its words."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        space = _SPACE[self.raw]
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        edges = self.begin[:-1][self.lengths > 0]
        before[edges] = True
        self.starts = np.flatnonzero(~space & before)
        after = np.ones(len(space), bool)
        after[:-1] = space[1:]
        after[edges[1:] - 1] = True
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.begin)  # of each text, and the end

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each window, and the index of its first word."""
        tokens = mixed(_OF_BYTES.sums(_BYTES[self.raw], self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        counts = np.diff(self.first)
        n = np.maximum(counts - window + 1, 0)
        at = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return _FIRST.sums(tokens, at, at + window), mixed(_SECOND.sums(tokens, at, at + window)), at


def chunks(texts: list[bytes]):
    """Runs of texts of about CHUNK bytes; a longer text stands alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > CHUNK:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


class BlockHashes:
    """The distinct windows of a block, ordered by bucket and hash."""

    def __init__(self, texts: list[bytes], window: int, n_buckets: int):
        first, bucket = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for run in chunks(texts):
            a, b, _ = Words(run).windows(window)
            first.append(a)
            bucket.append((b % np.uint64(n_buckets)).astype(np.uint32))
        first, bucket = np.concatenate(first), np.concatenate(bucket)
        order = np.argsort(first)
        kind = np.uint16 if n_buckets < 1 << 16 else np.uint32
        order = order[np.argsort(bucket[order].astype(kind), kind="stable")]
        a, b = first[order], bucket[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.order, self.group = order, np.cumsum(new) - 1
        self.hashes, self.buckets = a[new], b[new]
        self.many = np.bincount(self.group, minlength=len(self.hashes)) > 1 if len(a) else np.zeros(0, bool)
        self.cuts = np.searchsorted(self.buckets, np.arange(n_buckets + 1))

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each window in text order: does it occur anywhere else?"""
        known = self.many.copy()
        for k, packed in bits.items():
            a, b = self.cuts[k], self.cuts[k + 1]
            known[a:b] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = known[self.group]
        return out


def packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def texts_of(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


#: From this many hashes on, a table of 1 KB saves a byte of each.
TABLE_PAYS = 1024


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes: many of them in 7 bytes each, behind how many there are of each top byte; few of them whole, as
    messages get smaller with every block and bucket more."""
    if len(hashes) < TABLE_PAYS:
        return b"\0" + hashes.astype("<u8").tobytes()
    top = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256).astype("<u4")
    return b"\1" + top.tobytes() + np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if not packed[0]:
        return np.frombuffer(packed, "<u8", offset=1).astype(np.uint64)
    top = np.frombuffer(packed, "<u4", 256, offset=1)
    out = np.zeros((top.sum(), 8), np.uint8)
    out[:, :7] = np.frombuffer(packed, np.uint8, offset=1025).reshape(-1, 7)
    out[:, 7] = np.repeat(np.arange(256), top)
    return out.view("<u8").ravel().astype(np.uint64)


def cut(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_out: bool = True) -> DataFrame:
    """`docs` with n_words, n_removed and kept_sha256; with text_out the text has lost the removed words, each
    with the white space behind it, and is otherwise unchanged; without it the text column is dropped.  Columns of
    `docs` that have the new names are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    names, size = docs.columns, common.text_bytes(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets, n_tasks = max(least, -(-size // (2 * block_bytes))), max(least, -(-size // TASK_BYTES))
    sent_schema = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("mark", pa.int64()), ("packed", pa.binary()), ("many", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (to < 0: themselves), packed, and their messages (to: a bucket)."""

        def block(id_: int, run: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(run).combine_chunks()
            own = BlockHashes(texts_of(rows), window, n_buckets)
            mark = zlib.crc32(own.hashes.tobytes())
            used = np.flatnonzero(np.diff(own.cuts)).tolist()
            parts, n = [slice(own.cuts[k], own.cuts[k + 1]) for k in used], len(used) + 1
            packed = [packed_rows(rows)] + [pack(own.hashes[p]) for p in parts]
            many = [None] + [np.packbits(own.many[p]).tobytes() for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([id_, *used], [id_] * n, [mark] * n, packed, many), sent_schema, strict=True)], schema=sent_schema)

        yield from map(block, common.block_ids(), common.blocks_of(((b, common.lengths_of(b.column("text"))) for b in batches), block_bytes))

    def answer(table: pa.Table) -> pa.Table:
        """Which hashes of a bucket's messages occur in two blocks, or twice in one."""
        if not table.num_rows or table.column("to")[0].as_py() < 0:
            return table.schema.empty_table().select(["block", "to", "mark", "packed"])
        sets = [unpack(x) for x in table.column("packed").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(s)).astype(bool) for m, s in zip(table.column("many").to_pylist(), sets, strict=True)]
        every, own = np.concatenate(sets), np.concatenate(many)
        order = np.argsort(every, kind="stable")
        sorted_, own = every[order], own[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        group = np.cumsum(new) - 1
        known = (np.bincount(group) > 1) | (np.bincount(group, weights=own) > 0)
        bits = np.zeros(len(order), bool)
        bits[order] = known[group]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        replies = [np.packbits(bits[a:b]).tobytes() if bits[a:b].any() else None for a, b in zip(at[:-1], at[1:], strict=True)]
        answers = table.select(["block", "to", "mark"]).append_column("packed", pa.array(replies, pa.binary()))
        return answers.filter(pa.array([r is not None for r in replies]))

    def finish(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows or mine.column("to")[0].as_py() >= 0:
            return out_schema.empty_table()
        table = pa.ipc.open_stream(mine.column("packed")[0].as_buffer()).read_all()
        texts = texts_of(table)
        block = BlockHashes(texts, window, n_buckets)
        if any(m != mine.column("mark")[0].as_py() for m in replies.column("mark").to_pylist()):
            raise RuntimeError("a block changed between two reads of the input: its rows came in another order")
        repeated = block.repeated(dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True)))
        n_words, n_removed, digests, kept_texts, done = [], [], [], [], 0
        for run in chunks(texts):
            words = Words(run)
            n = np.maximum(np.diff(words.first) - window + 1, 0)
            for k, text in enumerate(run):
                a, b = words.first[k], words.first[k + 1]
                flags = repeated[done : done + n[k]]
                done += n[k]
                gone = np.zeros(b - a + 1, np.int64)
                if flags.any():
                    at = np.flatnonzero(flags)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                starts, ends = words.starts[a:b] - words.begin[k], words.ends[a:b] - words.begin[k]
                kept = [text[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
                n_words.append(b - a)
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if text_out:
                    kept_texts.append(without(text, starts, gone))
        out = {c: table.column(c) for c in names if c != "text"}
        if text_out:
            null = table.column("text").is_null().to_pylist()
            out["text"] = pa.array([None if z else t.decode() for t, z in zip(kept_texts, null, strict=True)], pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({c: out[c] for c in order_out})

    order_out = [c for c in names if text_out or c != "text"] + ["n_words", "n_removed", "kept_sha256"]
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in order_out[:-3]), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    out_schema = to_arrow_schema(schema)
    sent = docs.mapInArrow(send, "to long, block long, mark long, packed binary, many binary").repartition(n_tasks, "to")
    replies = sent.groupBy("to").applyInArrow(answer, "block long, to long, mark long, packed binary").toDF("block", "bucket", "mark", "bits").repartition(n_tasks, "block")
    return sent.groupBy("to").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def without(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """text without the words that are gone and the white space behind each."""
    if not gone.any():
        return text
    edges = np.append(starts, len(text)).tolist()
    flips = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).tolist()
    pieces, last = [], 0
    for k in range(0, len(flips), 2):
        pieces.append(text[last : edges[flips[k]]])
        last = edges[flips[k + 1]] if k + 1 < len(flips) else len(text)
    return b"".join([*pieces, text[last:]])


def op6_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(common.table(spark, sf_dir, "documents").select("doc_id", "text"), text_out=False)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM win JOIN rep USING (g)
), word AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d
), kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
