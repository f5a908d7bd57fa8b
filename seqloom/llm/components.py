"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node that isn't the smallest of its component.

    ``edges`` has ``(a, b)`` whole numbers. A large star links all larger
    neighbours of a node to the smallest one, a small star the smaller ones;
    edges and their number never grow, and every round is written, so that
    neither lineage nor memory builds up. A hub is a key of joins only, which
    adaptive execution splits, and of aggregations that combine before the shuffle.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = scratch.write(e, "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        nxt, path_next = scratch.write(small.select("e.*").where("a <> b").distinct(), "edges")
        scratch.drop(path)
        e, path = nxt, path_next
