"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); component is the smallest id that links reach.

    Alternates large and small stars until the edges no longer change, which takes a number of rounds
    logarithmic in the longest path.  Only minima are aggregated; no node's neighbours are collected.
    Loops are allowed (such a node is its own component); null ends are an error of the caller's.
    """
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.union(e.select("a", "b").join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).filter("a <> b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        e = checkpointed(e)
        now = _state(e)
        if now == state:
            break
        state = now
    found = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return nodes.distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
