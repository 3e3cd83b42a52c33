"""The driver's tables as virtual file indexes: path, size, modified_unix, is_protected and, where needed, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roots whose files are protected.
PROTECTED = ("/src0", "/src3")


def under(path: Column, roots) -> Column:
    """Whether a path lies in one of the roots, by whole components."""
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        out = out | (path == r) | path.startswith(r + "/")
    return out


def hidden(path: Column) -> Column:
    """Whether any component is hidden: a leading dot, or the two system names."""
    return F.exists(F.split(F.ltrim(path, F.lit("/")), "/"), lambda c: c.startswith(".") | F.lower(c).isin("thumbs.db", "desktop.ini"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("modified_unix"),
        F.encode("text", "UTF-8").alias("content"),
    ).withColumn("is_protected", under(F.col("path"), PROTECTED))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as folders, their turns as files."""
    t = table(spark, sf_dir, "conversations")
    folder = F.concat(F.lit("/conv/"), F.col("conv_id").cast("string"))
    name = F.concat(F.col("turn").cast("string"), F.lit("_"), "role", F.lit(".txt"))
    return t.select(folder.alias("folder"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders; a line is an entry `part:quantity`."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string")).alias("entry"), F.col("l_quantity").cast("long").alias("size"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images: each number in -1..1 as one of 256 grey levels."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128))).cast("long")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("pixels"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as media files: duration from the value, fingerprint from what the event says, tags from its type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("value").alias("duration"), F.sha2(F.concat("event_type", F.lit("|"), "props").cast("binary"), 256).alias("fingerprint"),
        "event_type", "user_id", F.unix_timestamp("ts").alias("modified_unix"),
    )
