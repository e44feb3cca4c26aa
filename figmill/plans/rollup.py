"""Checks, their states, and one verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state(applies: Column, verified: Column, failed: Column) -> Column:
    """NOT_APPLICABLE, NOT_VERIFIED (missing evidence never passes), FAIL or PASS."""
    return F.when(~F.coalesce(applies, F.lit(False)), "NOT_APPLICABLE").when(~F.coalesce(verified, F.lit(False)) | failed.isNull(), "NOT_VERIFIED").when(failed, "FAIL").otherwise("PASS")


def report(counts: DataFrame) -> DataFrame:
    """(name, required, status, failed, open, reason, passed) of counted checks (name, required, applies, ran, failed, open, reason).

    What failed is a FAIL even if more wasn't verified; `passed` needs every required check to pass or not to apply.
    """
    bad = F.coalesce(F.col("failed") > 0, F.lit(False))
    verified = F.col("ran") & (bad | (F.coalesce("open", F.lit(0)) == 0))
    c = counts.withColumn("status", state(F.col("applies"), verified, bad))
    fine = F.bool_and(~F.col("required") | F.col("status").isin("PASS", "NOT_APPLICABLE"))
    return c.join(F.broadcast(c.agg(F.coalesce(fine, F.lit(True)).alias("passed")))).select("name", "required", "status", "failed", "open", "reason", "passed")  # one row


def statuses(checks: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """(name, required, n, status, passed) of tables of violations; passed: no required check has any."""
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(required).alias("required"), "n") for name, (d, required) in checks.items()]
    c = reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))
    return c.join(F.broadcast(c.agg(F.bool_and(F.when(F.col("required"), F.col("n") == 0)).alias("passed"))))
