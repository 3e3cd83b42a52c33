"""The hash cache as tables: lookup by path or identity, and upsert.

Validity (size and time) is kept with each hash, so a hash of an older state is never taken for a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the cache.
SCHEMA = "path string, device_id string, inode string, size long, modified_unix long, algorithm string, scope string, bytes_hashed long, hash string, created_unix long"
KEY = ["path", "algorithm", "scope", "bytes_hashed"]


def times_match(a, b, tolerance: int):
    """Both unknown, or apart by no more than the tolerance."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= max(tolerance, 0), F.lit(False))


def lookup(files: DataFrame, cache: DataFrame, algorithm: str, scope: str, bytes_hashed: int, tolerance: int = 0) -> DataFrame:
    """files with `hash`, null for a miss. Two equi-joins instead of one on either key; a path match comes before an
    identity match, a newer entry before an older."""
    c = cache.filter((F.col("algorithm") == algorithm) & (F.col("scope") == scope) & (F.col("bytes_hashed") == bytes_hashed))
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in ("path", "device_id", "inode", "size", "modified_unix", "hash", "created_unix")])
    valid = (F.col("size") == F.col("c_size")) & times_match(F.col("modified_unix"), F.col("c_modified_unix"), tolerance)
    key = files.select("path", "device_id", "inode", "size", "modified_unix")
    by_path = key.join(c, F.col("path") == F.col("c_path")).filter(valid).select("path", F.lit(1).alias("by"), "c_created_unix", "c_hash")
    same = (F.col("device_id") == F.col("c_device_id")) & (F.col("inode") == F.col("c_inode"))
    by_identity = key.join(c, same).filter(valid).select("path", F.lit(0).alias("by"), "c_created_unix", "c_hash")
    best = by_path.unionByName(by_identity).groupBy("path").agg(F.max(F.struct("by", "c_created_unix", "c_hash")).alias("m"))
    return files.join(best.select("path", F.col("m.c_hash").alias("hash")), "path", "left")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    both = cache.unionByName(new)
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("created_unix").desc(), "hash"))
    return both.withColumn("__i", newest).filter("__i = 1").drop("__i")
