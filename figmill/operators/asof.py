"""As-of (bracketing) joins without a range join: one sort of both sides by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: dict[str, str]) -> DataFrame:
    """left with the columns `take` (right's name -> new name) of the latest right row up to its time, or nulls.

    On equal times the right row counts as earlier; of right rows with one time the greatest struct of taken
    columns wins.  Null keys match nothing.
    """
    value = F.struct(*(F.col(c).alias(n) for c, n in take.items()))
    r = right.select(*keys, F.col(time).alias("t_"), F.lit(0).alias("side_"), value.alias("v_"))
    l = left.select(*keys, F.col(time).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("l_"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t_", "side_", "v_").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("v_", F.last("v_", ignorenulls=True).over(w)).filter("side_ = 1")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return filled.select("l_.*", *(F.when(known, F.col(f"v_.{n}")).alias(n) for n in take.values()))
