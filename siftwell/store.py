"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set (local runs)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftwell-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
        return sc._jsc.sc().getCheckpointDir().get()
    return base


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: a table of a few files that cannot be split, with
    work to do on each row that outweighs moving it. Larger tables, and what a shuffle has dealt, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():  # to ask for its partitions would run it
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet and read again: lineage ends here, and a lost executor costs no recomputation.

    The schema is passed on, so reading needs no job and empty tables keep their columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwell_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing lazy depends on any more."""
    path = getattr(df, "_siftwell_path", None)
    if path:
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder, of every run that used it: for when no result is to be read any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark).rstrip('/')}/siftwell")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: For tables of few, large binary rows: close a row group by bytes, not after a hundred rows.
LARGE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "4",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
    "compression": "none",
}
