"""Audit of font sizes by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import finite
from figmill.operators import coverage, graph
from figmill.operators import patterns as P

SLACK = 1e-9


def resolved_size(direct: Column, nested: Column) -> Column:
    """The element's own size, or its style's; sizes that aren't positive numbers don't count."""
    return F.coalesce(F.when(finite(direct) & (direct > 0), direct), F.when(finite(nested) & (nested > 0), nested))


def assigned(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """Elements that have text with `n_roles` and, if one role's pattern finds the name, its `role`."""
    e = elements.filter((T.stripped("name") != "") & (T.stripped("text") != ""))
    names = P.matches(e, roles).join(graph.dealt(roles.select("role", "pattern")), "pattern").groupBy("name").agg(F.count(F.lit(1)).alias("n_roles"), F.min("role").alias("role"))
    return e.join(graph.dealt(names), "name")


def run_spread(elements: DataFrame) -> DataFrame:
    """(name, spread, exempt) of elements (name, size, runs array of (text, size, baseline)).

    The spread of a text's run sizes relative to its own; raised or lowered runs that aren't larger than the
    text are exempt.
    """
    r = elements.select("name", "size", F.explode("runs").alias("r")).select("name", "size", F.col("r.size").alias("run"), F.coalesce("r.baseline", F.lit(0.0)).alias("baseline"))
    exempt = (F.col("baseline") != 0) & (F.col("run") <= F.col("size"))
    kept = F.when(~exempt & finite(F.col("run")) & (F.col("run") > 0), F.col("run"))
    return r.groupBy("name", "size").agg(F.coalesce((F.max(kept) - F.min(kept)) / F.col("size"), F.lit(0.0)).alias("spread"), F.count_if(exempt).alias("exempt")).drop("size")


def role_sizes(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, count, median, least, most, spread) of the roles that have sized elements."""
    one = assigned(elements, roles).filter("n_roles = 1 and size > 0")
    g = one.groupBy("role").agg(F.count(F.lit(1)).alias("count"), F.median("size").alias("median"), F.min("size").alias("least"), F.max("size").alias("most"))
    return g.withColumn("spread", (F.col("most") - F.col("least")) / F.col("median"))


def audit(elements: DataFrame, roles: DataFrame, baseline: str, spread: float = 0.10, tolerance: float = 0.12, run: float = 0.5) -> DataFrame:
    """(rule, subject) for elements (name, text, size[, runs]) and roles (role, pattern, target_ratio, tolerance, required).

    A name that several roles match is an error and is left out.  A role's sizes must not spread by more than
    `spread` of their median; the median must be target_ratio times that of the baseline role, to a share
    `tolerance` of the ratio.  A text's runs must not spread by more than `run`.
    """
    found = assigned(elements, roles)
    one = found.filter("n_roles = 1")
    g = role_sizes(elements, roles)
    base = g.filter(F.col("role") == baseline).select(F.col("median").alias("base"))
    off = F.coalesce("tolerance", F.lit(tolerance))
    ratio = g.join(roles.select("role", "target_ratio", "tolerance"), "role").join(F.broadcast(base))  # the baseline is one row
    observed, target = F.col("median") / F.col("base"), F.col("target_ratio")
    nothing = base.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(baseline).alias("role"))
    rules = {
        "several roles": found.filter("n_roles > 1").select(F.col("name").alias("s")),
        "no size": one.filter("size is null or size <= 0").select(F.col("name").alias("s")),
        "no element": roles.filter("required").join(g, "role", "left_anti").select(F.col("role").alias("s")),
        "sizes spread": g.filter(F.col("spread") > spread + SLACK).select(F.col("role").alias("s")),
        "no baseline": nothing.select(F.col("role").alias("s")),
        "wrong ratio": ratio.filter((observed < target * (1 - off) - SLACK) | (observed > target * (1 + off) + SLACK)).select(F.col("role").alias("s")),
    }
    if "runs" in elements.columns:
        rules["run spread"] = run_spread(one).filter(F.col("spread") > run + SLACK).select(F.col("name").alias("s"))
    return coverage.violations(rules, "s")
