"""Sharding by fixed virtual slots.

Records hash into `n_slots` virtual slots that never change.  A versioned map assigns slots to shards; all
rebalancing edits that map, so whole slots move and everything else stays.  Bytes are aggregated per slot
(partial aggregation first), so the driver sees at most n_slots rows whatever the input holds.

Two laws: `bytes` edits the map until the shards' bytes are near equal; `key` derives it from the slot number
and the shard count alone, and growing by a shard moves slots only into the new one.

Under the law `bytes`, id and text decide the slot together.  A group of equal texts is not kept in one shard: such a
group may hold a third of all rows, and with it no shards of near equal bytes exist.  Only rows alike in id and text
share a slot.

Edge cases: a null text has no bytes, size 1 and crc32 0; a null doc_id hashes like any other value; very long texts are measured whole; repeated
rows share a slot and get neighbouring positions; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_SLOTS = 4096
#: The driver holds a handful of numbers per slot; this bounds it.
MOST_SLOTS = 1 << 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map."""

    version: int
    n_shards: int
    shards: tuple[int, ...] = field(repr=False)

    @staticmethod
    def first(n_slots: int, n_shards: int) -> SlotMap:
        if not 0 < n_shards <= n_slots <= MOST_SLOTS:
            raise ValueError(f"need 0 < shards <= slots <= {MOST_SLOTS}")
        return SlotMap(1, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def grown(self) -> SlotMap:
        """One shard more: each old shard hands slots to it until all hold near equal numbers."""
        shards, new = list(self.shards), self.n_shards
        held = [[] for _ in range(new)]
        for slot, shard in enumerate(shards):
            held[shard].append(slot)
        for _ in range(len(shards) // (new + 1)):
            giver = max(range(new), key=lambda k: (len(held[k]), -k))
            shards[held[giver].pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(shards))

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that narrows the gap between them."""
        loads = [0] * self.n_shards
        held: list[list[tuple[int, int]]] = [[] for _ in loads]
        shards = list(self.shards)
        for slot, shard in enumerate(shards):
            if size := sizes.get(slot, 0):
                loads[shard] += size
                held[shard].append((size, slot))
        while True:
            high = max(range(len(loads)), key=lambda k: (loads[k], -k))
            low = min(range(len(loads)), key=lambda k: (loads[k], k))
            gap = loads[high] - loads[low]
            movable = [x for x in held[high] if x[0] < gap]
            if not movable:
                return SlotMap(self.version + 1, self.n_shards, tuple(shards))
            size, slot = min(movable, key=lambda x: (abs(2 * x[0] - gap), x[1]))
            held[high].remove((size, slot))
            held[low].append((size, slot))
            loads[high] -= size
            loads[low] += size
            shards[slot] = low

    def column(self, slot: Column) -> Column:
        return by_slot(self.shards, slot, "int")

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, slot, shard)."""
        return spark.range(len(self.shards)).select(
            F.lit(self.version).alias("version"), F.col("id").alias("slot"), self.column(F.col("id")).alias("shard")
        )


def store(spark: SparkSession, versions: list[SlotMap], path: str) -> None:
    """Add versions of the map to the table at `path`, one folder a version; a version is never overwritten."""
    for m in versions:
        m.frame(spark).withColumn("n_shards", F.lit(m.n_shards)).drop("version").coalesce(1).write.parquet(f"{path}/version={m.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version of the map, the newest by default; at most MOST_SLOTS rows are read."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def by_slot(values, slot: Column, kind: str) -> Column:
    """values[slot] as an expression; the array is one folded literal, at most MOST_SLOTS long."""
    return F.element_at(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), (slot + 1).cast("int"))


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots))
    )


def with_key_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """The same, for the law `key`: doc_id alone decides the slot."""
    return with_slots(docs, n_slots).withColumn("vslot", F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)))


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (rows, bytes); at most n_slots entries."""
    totals = rows.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return {r["vslot"]: (r["n"], r["bytes"]) for r in totals.collect()}


def shard(docs: DataFrame, n_shards: int = 8, law: str = "bytes", n_slots: int = N_SLOTS, store_at: str | None = None) -> tuple[DataFrame, list[SlotMap]]:
    """Place every document.  Returns the placement (doc_id, size, text_crc32, law, shard, slot, grown_shard,
    vslot, map_version) and the versions of the map, the last being the one in force; with `store_at` they are stored
    there.

    slot is the document's position in its shard, from 0 and without gaps: the rows of earlier virtual slots of
    the shard come first, so only rows of one virtual slot meet in a task.
    """
    if law not in ("bytes", "key"):
        raise ValueError("law is bytes or key")
    rows = with_slots(docs, n_slots) if law == "bytes" else with_key_slots(docs, n_slots)
    totals = slot_totals(rows)
    versions = [SlotMap.first(n_slots, n_shards)]
    if law == "bytes":
        versions.append(versions[-1].rebalanced({s: b for s, (_, b) in totals.items()}))
        grown = F.lit(None).cast("int")
    else:
        grown = versions[-1].grown().column(F.col("vslot"))
    now = versions[-1]
    if store_at:
        store(docs.sparkSession, versions, store_at)
    offsets, reached = [0] * n_slots, [0] * n_shards
    for slot, k in enumerate(now.shards):
        offsets[slot] = reached[k]
        reached[k] += totals.get(slot, (0, 0))[0]
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), now.column(F.col("vslot")).alias("shard"),
        (within - 1 + by_slot(offsets, F.col("vslot"), "bigint")).cast("long").alias("slot"),
        grown.alias("grown_shard"), "vslot", F.lit(now.version).alias("map_version"),
    )
    return placed, versions


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"), store_at=f"{common.shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")[0]
