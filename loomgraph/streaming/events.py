"""The event log as a stream: append-only, de-duplicated impressions, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, user long, doc long, kind string, recommendation_id long, at timestamp"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_impressions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with each (recommendation, document) impression once within the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["kind", "recommendation_id", "doc", "user"])


def counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, kind, n) of each event-time window; late events beyond the delay are dropped."""
    grouped = events.withWatermark("at", delay).groupBy(F.window("at", window), "kind").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "kind", "n")


def append(events: DataFrame, path: str, checkpoint: str):
    """Append to a table, exactly once per batch; ends when the available input is read."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
