"""Exact duplicates by refinement: size, prefix hash, full hash, bytes. Each stage only sees what the last one left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashing import content_hash


def at_least_two(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur twice or more: counts are summed before the shuffle, and the rows follow by a semi join
    that adaptive execution can broadcast or split."""
    shared = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return items.join(shared, keys, "left_semi")


def exact_groups(files: DataFrame, algorithm: str = "sha256", prefix_bytes: int = 1 << 20, byte_verify: bool = False, min_size: int = 0) -> DataFrame:
    """Item rows with `hash`; `content` is binary and is dropped unless bytes are verified."""
    sized = at_least_two(files.filter(F.col("size") >= min_size), ["size"])
    short = F.col("size") <= prefix_bytes
    start = sized.withColumn("prefix", F.when(short, F.lit("")).otherwise(content_hash(F.substring("content", 1, prefix_bytes), algorithm)))
    same = at_least_two(start, ["size", "prefix"]).withColumn("hash", content_hash(F.col("content"), algorithm))
    keys = ["size", "hash"] + ["content"] * byte_verify
    return at_least_two(same, keys).drop("prefix").withColumn("reason", F.lit("same size + same full hash" + ", byte-by-byte verified" * byte_verify))
