"""Byte-level BPE encoding and decoding through a distinct-word table.

1. Spark splits each text into words by the tokenizer's own pattern; BPE never crosses them.
2. Runs of texts become blocks of about BLOCK_BYTES.  A block holds its texts as positions in the sorted list of its
   distinct words, and asks for these words only: one message a bucket, a word always going to the same bucket.
3. A bucket encodes each distinct word once, whatever number of blocks ask for it, and answers each message with
   the ids of its words.
4. The answers of a block, in the order of its words, are its table of ids; positions are joined with it, and for
   decoding ids are joined with the table of pieces (id -> bytes).  Both joins are Arrow gathers.

Blocks and messages go through one exchange, used by steps 3 and 4, so a text is split once.  A word that every
document holds is one entry of a message a block, and messages are dealt to buckets alike, so no key is hot.  A task
holds one block, or the distinct words of its buckets, whose number grows with the input.

Only texts of plain characters (PLAIN) are split by Spark's regular expressions.  Those with a character on which
they and the library might differ (anything past U+024F but a few marks of punctuation, and the separators
U+001C-U+001F, U+0085), or with the string of a special token, which becomes its own id as in the library's default,
are split by the library.

Edge cases: a null or empty text has no ids and decodes to ''; very long texts are encoded whole; repeated rows
each get a row; an empty table gives an empty result; of further columns only the named key is read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Bytes of words after which a block ends; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of input a task of the exchange stands for.
TASK_BYTES = 128 << 20
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character outside those whose classes are the same everywhere.
NOT_PLAIN = r"[^\x00-\x1b\x20-\x7e¡-ɏ–—‘’“”…]"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the
    other bytes, in order, for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def special_tokens(tokenizer_json: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.loads(tokenizer_json)["added_tokens"]}


class Codec:
    """Splitter, encoder of words and table of pieces of one tokenizer file."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(tokenizer_json)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix space is needed")
        self.special = special_tokens(tokenizer_json)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """The words of a text as the library finds them; a special token is a word."""
        words = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                words.append(part)
            elif part:
                words += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return words

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> pa.LargeBinaryArray:
        """The bytes of each id."""
        chars, special = byte_characters(), {i: c for c, i in self.special.items()}
        by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return pa.array([special[i].encode() if i in special else bytes(chars[c] for c in by_id.get(i, "")) for i in range(max(by_id) + 1)], pa.large_binary())


_CODECS: dict[str, tuple[Codec, pa.LargeBinaryArray]] = {}


def codec(tokenizer_json: str) -> tuple[Codec, pa.LargeBinaryArray]:
    """The codec of a tokenizer file and its pieces, kept by a worker from task to task."""
    at = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if at not in _CODECS:
        made = Codec(tokenizer_json)
        _CODECS[at] = made, made.pieces()
    return _CODECS[at]


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, the bytes of each place together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unsqueezed(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def squeezed_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 3)


def unsqueezed_words(packed: bytes) -> list[str]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, offset=4)).tolist()
    body = raw[4 * n + 4 :]
    return [body[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def sized(batches: Iterator[pa.RecordBatch], split) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(key, words) of the rows that Spark has split, then of the others, which `split` does; with the bytes of each."""
    for batch in batches:
        key, words, raw = (batch.column(c) for c in ("key", "words", "raw"))
        others = pa.array(map(split, raw.drop_null().to_pylist()), pa.list_(pa.string()))
        for k, w in ((key.filter(words.is_valid()), words.filter(words.is_valid())), (key.filter(raw.is_valid()), others)):
            lengths = np.concatenate([[0], np.cumsum(common.lengths_of(w.flatten()), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([k, w], names=["key", "words"]), np.diff(lengths[w.offsets.to_numpy() - w.offsets[0].as_py()])


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: bool = True, decoded: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) per row of `docs`."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of fixed size
    n_buckets = common.tasks_for(docs, TASK_BYTES)
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)

    text, plain = F.coalesce("text", F.lit("")), ~F.coalesce("text", F.lit("")).rlike(NOT_PLAIN)
    for token in special_tokens(tokenizer_json):
        plain = plain & ~text.contains(token)
    split = docs.select(F.col(key).alias("key"), F.when(plain, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).alias("words"), F.when(~plain, text).alias("raw"))
    sent_schema = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("mark", pa.int64()), ("keys", pa.list_(key_type)), ("lengths", pa.list_(pa.int32())), ("packed", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks (to < 0: themselves) and their messages (to: a bucket)."""

        def block(id_: int, run: list[pa.RecordBatch]) -> pa.RecordBatch:
            words = [b.column("words") for b in run]
            lengths = np.concatenate([pc.list_value_length(w).to_numpy(zero_copy_only=False) for w in words])
            coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in distinct), np.int64, len(distinct))
            order = pc.sort_indices(pa.table({"b": bucket, "w": coded.dictionary}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            positions = squeezed(place[coded.indices.to_numpy(zero_copy_only=False)])
            mark = zlib.crc32(positions)
            buckets, begin = np.unique(bucket[order], return_index=True)
            cuts = [*begin.tolist(), len(order)]
            parts = [[distinct[k] for k in order[a:b].tolist()] for a, b in zip(cuts, cuts[1:], strict=False)]
            n = len(parts)
            rows = [[id_, *buckets.tolist()], [id_] * (n + 1), [mark] * (n + 1), [pa.chunked_array([b.column("key") for b in run]).to_pylist()] + [None] * n, [lengths.tolist()] + [None] * n, [positions, *map(squeezed_words, parts)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, sent_schema, strict=True)], schema=sent_schema)

        yield from map(block, common.block_ids(), common.blocks_of(sized(batches, codec(shared.value)[0].split), block_bytes))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        schema = pa.schema([("to", pa.int64()), ("bucket", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])
        for batch in batches:
            for to, block, mark, packed in zip(*(batch.column(c) for c in ("to", "block", "mark", "packed")), strict=True):
                if to.as_py() < 0:
                    continue
                words = unsqueezed_words(packed.as_py())
                new = [w for w in words if w not in known]
                for word, found in zip(new, codec(shared.value)[0].ids(new), strict=True):
                    known[word] = np.array(found, "<u4").tobytes()
                replies = [known[w] for w in words]
                counts = np.fromiter(map(len, replies), np.uint32, len(replies)) // 4
                row = block.as_py(), to.as_py(), mark.as_py(), len(words), squeezed(np.concatenate([counts, np.frombuffer(b"".join(replies), "<u4")]))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
    types = dict(zip(names, [key_type, pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids + [pa.string()] * decoded, strict=True))

    def finish(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        if mine.num_rows and mine.column("to")[0].as_py() < 0:
            row = {c: mine.column(c)[0] for c in ("mark", "keys", "lengths", "packed")}
            tables = sorted(zip(*(replies.column(c).to_pylist() for c in ("bucket", "mark", "n", "packed")), strict=True))
            if any(mark != row["mark"].as_py() for _, mark, _, _ in tables):
                raise RuntimeError("a block changed between two reads of the input: its rows came in another order")
            counts, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
            for _, _, n, packed in tables:
                both = unsqueezed(packed)
                counts.append(both[:n])
                flat.append(both[n:])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])
            of_word = pa.LargeListArray.from_arrays(offsets, np.concatenate(flat))
            positions = unsqueezed(row["packed"].as_py())
            joined = of_word.take(pa.array(positions))  # ids by position
            tokens, word_ends = joined.flatten(), joined.offsets.to_numpy()
            pieces = codec(shared.value)[1].take(tokens)  # pieces by id
            piece_ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, offset=8 * pieces.offset) if len(pieces) else np.zeros(1, np.int64)
            raw_ids, raw = tokens.to_numpy().astype("<u4"), pieces.buffers()[2]
            ends = word_ends[np.concatenate([[0], np.cumsum(np.array(row["lengths"].as_py(), np.int64))])].tolist()
            out["key"] = row["keys"].values
            for a, b in zip(ends, ends[1:], strict=False):
                plain = raw[int(piece_ends[a]) : int(piece_ends[b])].to_pybytes() if b > a else b""
                try:
                    plain.decode()
                except UnicodeDecodeError:
                    plain = plain.decode(errors="replace").encode()  # broken sequences become U+FFFD, as in the library
                out["n_tokens"].append(b - a)
                out["ids_sha256"].append(hashlib.sha256(raw_ids[a:b].tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
                if decoded:
                    out["decoded"].append(plain.decode())
            if ids:
                out["ids"] = pa.ListArray.from_arrays(np.array(ends, np.int32), raw_ids.astype(np.int32))
        return pa.table({n: x if isinstance(x, pa.Array) else pa.array(x, types[n]) for n, x in out.items()})

    k = kind.simpleString()
    sent = split.mapInArrow(send, f"to long, block long, mark long, keys array<{k}>, lengths array<int>, packed binary").repartition(n_buckets, "to")
    replies = sent.mapInArrow(answer, "to long, bucket long, mark long, n int, packed binary").repartition(n_buckets, "to")
    schema = f"key {k}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return sent.groupBy("to").cogroup(replies.groupBy("to")).applyInArrow(finish, schema).withColumnRenamed("key", key)


def op10_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, decoded=False)
