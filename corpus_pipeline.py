"""From documents to packed training sequences in five stages, each the work of one operator.

Every stage takes what its predecessor kept, all of it, and its decisions take effect: rejected documents go and failing
lines are cut (quality), one document of each near-duplicate group stays, strings of 200 bytes that stand more than once
are cut, documents with benchmark passages go, and what is left is packed. Stages but the last return the columns of
their input; `n_chars` follows the text. A null text does not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._names import fresh
from siftwell.llm._store import discard, written
from siftwell.llm.decontaminate import without_leaks
from siftwell.llm.near_dedup import near_components
from siftwell.llm.packing import pack
from siftwell.llm.quality import line_first_clean
from siftwell.llm.suffix_dedup import cut_repeats


def _as_before(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[f"`{c}`" for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row number keeps the filter above the projections: pushed below, every rule would be computed many times over
    quality, row = fresh(docs, "quality", "row")
    judged = line_first_clean(docs, into=quality).withColumn(row, F.monotonically_increasing_id())
    judged = judged.filter(F.col(f"{quality}.kept") & (F.col(row) >= 0))
    return _as_before(judged.withColumn("text", F.col(f"{quality}.clean_text")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat an id and its text are one document, told by the least of their other columns; rows with a null id are all kept."""
    kept = near_components(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    mine = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    key = [columns[names.index("doc_id")], columns[names.index("text")]]
    rest = [c for c in columns if c not in key]
    one = mine.toDF(*columns).groupBy(*key).agg(F.min(F.struct(F.lit(0).alias("none"), *rest)).alias("rest"))
    one = one.select(*[c if c in key else F.col(f"rest.{c}") for c in columns]).toDF(*names)
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_before(cut_repeats(docs), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Near-duplicate groups, repeated strings and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
