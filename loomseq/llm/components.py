"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.cluster import written


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps, which need O(log n) rounds in practice; each step is one aggregation with
    map-side combining and one join of two plain exchanges, which adaptive execution splits where a node has very many edges.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    at = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        if at.isEmpty():
            break
        # large-star: every larger neighbour of u links to the least of u and its neighbours
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select("b", "a"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        # small-star: u and its smaller neighbours link to the least of them
        least = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        moved = large.select(F.col("a").alias("u"), "b").join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        at = written(moved.union(least.select("u", "m")).distinct(), "edges")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select("component", "component").distinct())
