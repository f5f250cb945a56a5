"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import remove, shared_dir
from loomgraph.storage import written_at as written

__all__ = ["ascii_lower", "block_ids", "blocks_of", "lengths_of", "remove", "shared_dir", "table", "tasks_for", "text_bytes", "unused", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tasks_for(df: DataFrame, bytes_per_task: int) -> int:
    """Number of shuffle tasks for df: the session's setting, or more where the planner's size
    estimate asks for it.  It only sets parallelism, never what is computed."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 58 else max(least, math.ceil(size / bytes_per_task))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: what blocks and buckets hold, whatever the files' compression."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def block_ids() -> Iterator[int]:
    """Negative ids of the blocks that this task makes, the same ones if it runs again."""
    first = -1 - (TaskContext.get().partitionId() << 24)
    while True:
        yield first
        first -= 1


def blocks_of(parts: Iterator[tuple[pa.RecordBatch, np.ndarray]], block_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows whose sizes reach block_bytes, the last run aside; `parts` gives batches with each row's size."""
    run, held = [], 0
    for batch, sizes in parts:
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - held)) + 1)  # the first row that fills the block
            run.append(batch.slice(at, stop - at))
            held, at = held + int(ends[stop - 1]) - before, stop
            if held >= block_bytes:
                yield run
                run, held = [], 0
    if run:
        yield run


def lengths_of(strings: pa.Array) -> np.ndarray:
    """Bytes of each string, 0 for a null."""
    return pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False)
