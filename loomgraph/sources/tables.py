"""Files in and out: taxonomy, JSON side inputs, partitioned sinks."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_taxonomy(spark: SparkSession, path: str, header_rows: int = 2, tiers: int = 4) -> DataFrame:
    """(topic, parent, name, tier) of a tab-separated taxonomy: id, parent, name, then one column per tier."""
    names = ["topic", "parent", "name", *(f"t{k}" for k in range(1, tiers + 1))]
    raw = spark.read.text(path, wholetext=False).withColumn("c", F.split("value", "\t")).filter(F.get("c", F.lit(0)).rlike(r"^\d+$"))
    rows = raw.select(*(F.nullif(F.trim(F.get("c", F.lit(k))), F.lit("")).alias(n) for k, n in enumerate(names)))
    tier = sum(F.col(f"t{k}").isNotNull().cast("int") for k in range(1, tiers + 1))
    return rows.select(F.col("topic").cast("long").alias("topic"), F.col("parent").cast("long").alias("parent"), "name", tier.alias("tier"))


def read_toml(path: str) -> dict:
    """A small side input, read on the driver."""
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that df has."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
