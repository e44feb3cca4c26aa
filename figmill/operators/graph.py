"""Connected components by alternating stars."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, only a local session may use a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", "")
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that its lineage ends there.

    A checkpoint would keep the size that Spark estimated and what it inferred of the values; in rounds of joins both
    grow without bound, until planning a round takes longer than running it.  A file's size is what it is.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join both of whose sides grow with the input: they are shuffled and merged.

    Spark guesses sizes from compressed files and before rows are exploded, so otherwise it may take a whole table to the
    driver to broadcast it.
    """
    return df.hint("merge")


def tasks(rows: int, a_task: int) -> int:
    """How many tasks rows are dealt to by their number, where the session's own number of partitions would let a task grow with the input."""
    return max(8, math.ceil(rows / a_task))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); component is the least id that they reach."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = both.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.filter("a <> m").select("a", F.col("m").alias("b"))
        e = cut(up.union(own).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    low = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return nodes.join(low, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def on_circles(edges: DataFrame) -> DataFrame:
    """(id, circle) of the nodes of directed edges (a, b) that lie on a circle, with the largest id of those that reach each other.

    Nodes without a way in or out are peeled off in rounds; of what is left, each node takes the largest id that reaches it,
    and the nodes of one such id that reach it in turn are on circles with it.  The rest is peeled again.  Rounds are as
    many as the longest way is long.  A node with an edge to itself is a circle; edges with a null end are left out.
    """
    e, done = cut(edges.select("a", "b").dropna().distinct()), None
    while True:
        while True:  # peel
            ends = e.select(F.col("a").alias("id")).distinct().join(e.select(F.col("b").alias("id")).distinct(), "id")
            kept = cut(e.join(ends.select(F.col("id").alias("a")), "a", "left_semi").join(ends.select(F.col("id").alias("b")), "b", "left_semi"))
            if kept.count() == e.count():
                break
            e = kept
        if e.isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("a").alias("circle")).limit(0) if done is None else done
        colour = e.select(F.col("a").alias("id"), F.col("a").alias("colour")).distinct()
        while True:
            push = e.join(colour, e["a"] == colour["id"]).select(F.col("b").alias("id"), "colour")
            new = cut(colour.unionByName(push).groupBy("id").agg(F.max("colour").alias("colour")))
            grown = new.exceptAll(colour).isEmpty()
            colour = new
            if grown:
                break
        inner = e.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").filter("ca = cb")
        inner = cut(inner.select("a", "b", F.col("ca").alias("circle")))
        back = cut(colour.filter("id = colour").select("id", F.col("colour").alias("circle")))
        while True:
            more = inner.join(back.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "circle")
            new = cut(back.unionByName(more).distinct())
            if new.count() == back.count():
                break
            back = new
        done = back if done is None else done.unionByName(back)
        e = cut(e.join(back.select(F.col("id").alias("a")), "a", "left_anti").join(back.select(F.col("id").alias("b")), "b", "left_anti"))
