"""Order of items in a group, the copy to keep, and rules that choose another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = ("keep-suggested", "keep-newest", "keep-oldest")


def item_order() -> list[Column]:
    """Protected first, then oldest (unknown times first), fewest path components, lower-cased path, path."""
    return [F.col("is_protected").desc(), F.col("modified_unix").asc_nulls_first(), F.size(F.split("path", "/")), F.lower("path"), F.col("path")]


def large_order() -> list[Column]:
    return [F.col("is_protected").desc(), F.col("size").desc(), F.col("modified_unix").asc_nulls_first(), F.lower("path"), F.col("path")]


def ranked(items: DataFrame, group: list[str], order: list[Column] | None = None) -> DataFrame:
    """items with `rank` and `suggested_keep`; groups of duplicates are ranked whole, spilling sorts where they are large."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*(order or item_order())))
    return items.withColumn("rank", rank).withColumn("suggested_keep", F.col("rank") == 1)


def keep_rank(items: DataFrame, group: list[str], rule: str) -> DataFrame:
    """items with `keep`, chosen by a rule: ties go to the last for the newest, to the first otherwise."""
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    order = {
        "keep-newest": [F.coalesce("modified_unix", low).desc(), F.col("rank").desc()],
        "keep-oldest": [F.coalesce("modified_unix", high).asc(), F.col("rank").asc()],
        "keep-suggested": [F.col("suggested_keep").desc(), F.col("rank").asc()],
    }[rule]
    return items.withColumn("keep", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` over all of them: sorted by range partitions, numbered in each, shifted by the sizes of those before.

    Written once after the sort, so that partitions stay as they are between the count and the numbering.
    """
    from siftwell.store import written

    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(keyed.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row for each partition
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    joined = numbered.join(F.broadcast(before.select("__p", "__before")), "__p")
    return joined.withColumn("rank", F.coalesce("__before", F.lit(0)) + F.col("__i") + 1).drop("__p", "__i", "__id", "__before")
