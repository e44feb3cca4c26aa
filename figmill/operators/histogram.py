"""Histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over the value's range; at most `bins` rows."""
    r = df.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    b = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * bins))
    return df.select(value).join(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(h: DataFrame) -> DataFrame:
    """(threshold, n_below): the first bin of greatest between-class variance.  The window is over the bins only."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    s = F.col("n") * F.col("bin")
    c = h.select("bin", F.sum("n").over(w).alias("n0"), F.sum(s).over(w).alias("s0"), F.sum("n").over(all_).alias("nt"), F.sum(s).over(all_).alias("st"))
    a, b = F.col("n0").cast("double"), (F.col("nt") - F.col("n0")).cast("double")
    between = F.when(b == 0, 0.0).otherwise(a * b * F.pow(F.col("s0") / a - (F.col("st") - F.col("s0")) / b, F.lit(2)))
    return c.withColumn("between", between).orderBy(F.desc("between"), "bin").limit(1).select(F.col("bin").alias("threshold"), F.col("n0").alias("n_below"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """(keys, p0, p1, ...): exact percentiles, linear between neighbours, of the values that aren't null.

    Values are counted first.  The bins that hold the wanted places are found from `bins` counts a group, and only
    their values are put in order, so no task holds a group's values.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    span = v.groupBy(*keys).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.sum("c_").alias("n_"))
    at = F.when(F.col("hi_") > F.col("lo_"), F.least(F.lit(bins - 1), F.floor((F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * bins))).otherwise(0)
    b = v.join(span, keys).withColumn("bin_", at)
    up = Window.partitionBy(*keys).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    first = b.groupBy(*keys, "bin_").agg(F.sum("c_").alias("in_")).withColumn("first_", F.coalesce(F.sum("in_").over(up), F.lit(0)))
    places = F.array(*(F.struct(F.lit(k).alias("k_"), F.lit(end).alias("end_"), (F.floor if not end else F.ceil)((F.col("n_") - 1) * share).alias("place_"), ((F.col("n_") - 1) * share).alias("exact_")) for k, share in enumerate(shares) for end in (0, 1)))
    wanted = span.select(*keys, F.inline(places)).join(first, keys).filter("place_ >= first_ and place_ < first_ + in_")
    held = b.join(first.join(wanted.select(*keys, "bin_").distinct(), [*keys, "bin_"], "left_semi"), [*keys, "bin_"])
    inner = Window.partitionBy(*keys, "bin_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("to_", F.col("first_") + F.sum("c_").over(inner)).select(*keys, "bin_", "v_", (F.col("to_") - F.col("c_")).alias("from_"), "to_")
    found = wanted.select(*keys, "bin_", "k_", "end_", "place_", "exact_").join(held, [*keys, "bin_"]).filter("place_ >= from_ and place_ < to_")
    one = found.groupBy(*keys, "k_").agg(F.max(F.when(F.col("end_") == 0, F.col("v_"))).alias("a_"), F.max(F.when(F.col("end_") == 1, F.col("v_"))).alias("z_"), F.max(F.col("exact_") - F.floor("exact_")).alias("f_"))
    return one.groupBy(*keys).agg(*(F.max(F.when(F.col("k_") == k, F.col("a_") + (F.col("z_") - F.col("a_")) * F.col("f_"))).alias(f"p{k}") for k in range(len(shares))))
