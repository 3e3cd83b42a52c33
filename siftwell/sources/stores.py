"""Saved reports and the hash cache as Parquet tables."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import cache_join

REPORTS = "id long, created_at_unix long, name string, mode string, risk string, scanned_files long, group_count long, report_json string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


class ReportStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, name: str, report: dict) -> int:
        new = (_read(self.spark, self.path, REPORTS).agg(F.max("id")).first()[0] or 0) + 1
        row = (new, int(time.time()), name, report["mode"], report["risk"], report["scanned_files"], len(report["duplicate_groups"]), json.dumps(report))
        self.spark.createDataFrame([row], REPORTS).write.mode("append").parquet(self.path)
        return new

    def list(self, needle: str = "") -> DataFrame:
        rows = _read(self.spark, self.path, REPORTS).drop("report_json")
        needle = needle.strip().lower()
        hit = F.lit(not needle)
        for c in ("id", "name", "mode", "risk"):
            hit = hit | F.lower(F.col(c).cast("string")).contains(needle)
        return rows.filter(hit).orderBy(F.desc("id"))

    def load(self, ident: int) -> dict:
        row = _read(self.spark, self.path, REPORTS).filter(F.col("id") == ident).select("report_json").first()
        if row is None:
            raise KeyError(f"no report {ident}")
        return json.loads(row[0])


class HashCache:
    """Entries are never changed in place: a new table is written beside the old one and named by a pointer file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [x.getPath() for x in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(cache_join.SCHEMA).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], cache_join.SCHEMA)

    def lookup(self, files: DataFrame, algorithm: str, scope: str, bytes_hashed: int, tolerance: int = 0) -> DataFrame:
        return cache_join.lookup(files, self.table(), algorithm, scope, bytes_hashed, tolerance)

    def store(self, entries: DataFrame) -> None:
        v = self._versions()
        cache_join.upsert(self.table(), entries).write.parquet(f"{self.path}/v{(v[-1] if v else 0) + 1}")

    def clear(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
