"""Connected components of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.store import discard, written


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, comp): the smallest id reachable from each node of the links (a, b).

    The least neighbour of each node is written before it is joined with the edges: a join of two written tables is one
    whose hot nodes adaptive execution can split. Tables of finished rounds are deleted.
    """
    edges = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is joined with the smallest one of the neighbourhood, itself included
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: the smaller neighbours and the node itself are joined with the smallest
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        for done in (edges, low, large, least):
            discard(done)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
        before = state
    raise RuntimeError("components did not settle")
