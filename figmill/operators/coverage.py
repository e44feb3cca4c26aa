"""Coverage, foreign-key and sequence checks; each returns one row per violation or per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks; null keys count as missing."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def two_way(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a = left.select(*keys).distinct().withColumn("l_", F.lit(True))
    b = right.select(*keys).distinct().withColumn("r_", F.lit(True))
    return a.join(b, keys, "full").filter("l_ is null or r_ is null").select(*keys, F.when(F.col("r_").isNull(), "left only").otherwise("right only").alias("side"))


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key doesn't match exactly one right row, with the number it matches."""
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return left.join(n, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0))).filter("matches <> 1")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sequence_gaps(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Per group: n, last, n_distinct, has_gap (indices aren't 1..max), n_repeated."""
    g = df.groupBy(*keys).agg(F.count(index).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"), F.count_distinct(index).alias("n_distinct"))
    return g.select(*keys, "n", "last", "n_distinct", (~((F.col("first") == 1) & (F.col("last") == F.col("n_distinct")))).alias("has_gap"), (F.col("n") - F.col("n_distinct")).alias("n_repeated"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with repeats, and which."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def violations(rules: dict[str, DataFrame], subject: str) -> DataFrame:
    """(rule, subject): one row per error of every rule."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject")) for name, d in rules.items()])
