"""Ordered series: smoothing, peaks, interpolation, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.operators import graph


def _window(keys, order):
    return (Window.partitionBy(*keys) if keys else Window).orderBy(*order)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """df with `smooth`: centred mean that shrinks at the ends; an even width is raised by one."""
    r = max(1, width | 1) // 2
    return df.withColumn("smooth", F.avg(value).over(_window(keys, order).rowsBetween(-r, r)))


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int) -> DataFrame:
    """Interior rows that are not below the one before and above the next, with `prominence` over `reach` rows each way."""
    w = _window(keys, order)
    low = F.greatest(F.min(value).over(w.rowsBetween(-reach, 0)), F.min(value).over(w.rowsBetween(0, reach)))
    d = df.withColumn("before_", F.lag(value).over(w)).withColumn("after_", F.lead(value).over(w)).withColumn("prominence", F.col(value) - low)
    return d.filter((F.col(value) >= F.col("before_")) & (F.col(value) > F.col("after_"))).drop("before_", "after_")


def suppress(df: DataFrame, keys: list[str], x: str, apart: float) -> DataFrame:
    """(keys, x, prominence) of the greedy choice by prominence, then x: a peak stays if it is at least `apart` from all that stay.

    In rounds, every open peak that none outranks within `apart` stays, and what lies within `apart` of one that stays goes.
    A peak meets the three cells around it only, and of a cell only the best can stay, so no array of peaks is made.
    Peaks with a null place or prominence are left out; of those at one place the most prominent counts.
    """
    rank = lambda p, at: F.struct(p.alias("p"), (-at).alias("at"))
    side = apart * (1 + 1e-9)
    d = df.select(*keys, F.col(x).cast("double").alias(x), F.col("prominence").cast("double").alias("prominence")).filter(F.col(x).isNotNull() & F.col("prominence").isNotNull())
    open_ = d.groupBy(*keys, x).agg(F.max("prominence").alias("prominence"))
    if apart <= 0:
        return open_
    open_, done = graph.cut(open_.withColumn("cell_", F.floor(F.col(x) / side))), None
    cells = F.explode(F.array(*(F.col("cell_") + k for k in (-1, 0, 1)))).alias("cell_")
    at = [*keys, "cell_"]
    while not open_.isEmpty():
        best = open_.groupBy(*at).agg(F.max(rank(F.col("prominence"), F.col(x))).alias("m")).select(*at, F.col("m.p").alias("top_"), (-F.col("m.at")).alias("x_"))
        asks = best.select(*keys, F.col("cell_").alias("home_"), "top_", "x_", cells)
        over = asks.join(open_, at).filter((F.abs(F.col(x) - F.col("x_")) < apart) & (rank(F.col("prominence"), F.col(x)) > rank(F.col("top_"), F.col("x_"))))
        stay = graph.cut(asks.filter("cell_ = home_").join(over.select(*keys, "home_").distinct(), [*keys, "home_"], "left_anti").select(*keys, F.col("home_").alias("cell_"), "top_", "x_"))
        found = stay.select(*keys, F.col("x_").alias(x), F.col("top_").alias("prominence"))
        done = found if done is None else done.unionByName(found)
        near = stay.select(*keys, "x_", cells)
        gone = open_.join(near, at).filter(F.abs(F.col(x) - F.col("x_")) < apart).select(*keys, x).distinct()
        open_ = graph.cut(open_.join(gone, [*keys, x], "left_anti"))
    return d.select(*keys, x, "prominence").limit(0) if done is None else done


def interpolate(df: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """df with nulls of `value` replaced on the line between its neighbours, by the nearest one at the ends."""
    w = _window(keys, [x])
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(x))
    d = df.withColumn("v0_", F.last(value, True).over(back)).withColumn("x0_", F.last(at, True).over(back)).withColumn("v1_", F.first(value, True).over(ahead)).withColumn("x1_", F.first(at, True).over(ahead))
    line = F.col("v0_") + (F.col("v1_") - F.col("v0_")) * (F.col(x) - F.col("x0_")) / (F.col("x1_") - F.col("x0_"))
    return d.withColumn(value, F.when(F.col("v0_").isNull(), F.col("v1_")).when(F.col("v1_").isNull() | (F.col("x1_") == F.col("x0_")), F.col("v0_")).otherwise(line)).drop("v0_", "x0_", "v1_", "x1_")


def resample(df: DataFrame, keys: list[str], points: int = 201) -> DataFrame:
    """(keys, i, x, y) of the series (x, y) on `points` even steps from 0 to 1; of equal x (to 1e-12) the least y counts."""
    known = df.groupBy(*keys, F.round("x", 12).alias("x")).agg(F.min("y").alias("y"))
    grid = known.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.round(F.col("i") / (points - 1), 12))
    return interpolate(grid.join(known, [*keys, "x"], "full"), keys, "x", "y").filter("i is not null").select(*keys, "i", "x", "y")


def monotone(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Whether each series never falls or never rises."""
    d = df.withColumn("d_", F.col(value) - F.lag(value).over(_window(keys, order)))
    return d.groupBy(*keys).agg((F.coalesce(F.bool_and(F.col("d_") >= 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("d_") <= 0), F.lit(True))).alias("monotone"))


def valleys(df: DataFrame, chosen: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The lowest point (first on ties) strictly between each two neighbouring chosen peaks."""
    nxt = chosen.select(*keys, F.col(x).alias("from_"), F.lead(x).over(_window(keys, [x])).alias("to_")).filter("to_ is not null")
    d = df.join(nxt, keys).filter((F.col(x) > F.col("from_")) & (F.col(x) < F.col("to_")))
    return d.groupBy(*keys, "from_", "to_").agg(F.min(F.struct(y, x)).alias("m")).select(*keys, F.col(f"m.{x}").alias(x), F.col(f"m.{y}").alias(y))


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket) -> DataFrame:
    """df with `n_`, the place of each row in its key's order from 0: places within buckets (a column that rises with the order), and the buckets' counts added up."""
    d = df.withColumn("bucket_", bucket)
    w = Window.partitionBy(*keys, "bucket_").orderBy(*order)
    before = F.sum("c_").over(Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    counts = d.groupBy(*keys, "bucket_").agg(F.count(F.lit(1)).alias("c_")).select(*keys, "bucket_", F.coalesce(before, F.lit(0)).alias("first_"))
    return d.withColumn("own_", F.row_number().over(w) - 1).join(counts, [*keys, "bucket_"]).withColumn("n_", F.col("own_") + F.col("first_")).drop("own_", "first_", "bucket_")


def moving_average_wide(df: DataFrame, keys: list[str], order: list[str], bucket, value: str, width: int, size: int = 10_000) -> DataFrame:
    """moving_average() for few keys with many rows: rows go to blocks of `size` places, with the rows next to a block, so no window holds a key."""
    r = max(1, width | 1) // 2
    at = lambda n: F.floor(n / size)
    d = numbered(df, keys, order, bucket).withColumn("home_", at(F.col("n_")))
    d = d.withColumn("block_", F.explode(F.array_distinct(F.array(at(F.col("n_") - r), F.col("home_"), at(F.col("n_") + r)))))
    w = Window.partitionBy(*keys, "block_").orderBy("n_").rowsBetween(-r, r)
    return d.withColumn("smooth", F.avg(value).over(w)).filter("block_ = home_").drop("n_", "home_", "block_")
