"""Audit of a diagram's grammar: which objects must be there, in which shapes, and what each edge joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import finite
from figmill.operators import graph
from figmill.operators import patterns as P

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "NOT_VERIFIED"


def nodes(elements: DataFrame, outputs: DataFrame) -> DataFrame:
    """(rule, subject) of outputs (role, name, allowed array of geometries): each must be one element of an allowed geometry."""
    named = elements.filter(T.stripped("name") != "")
    n = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("geometry").alias("kinds"))
    j = outputs.join(graph.dealt(n), "name", "left")
    bad = F.size(F.array_except(F.coalesce("kinds", F.array().cast("array<string>")), "allowed")) > 0
    issue = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing object"), F.when(F.col("n") > 1, "object is not unique"), F.when(bad, "geometry not allowed")))
    return j.select(F.explode(issue).alias("rule"), F.concat_ws("/", "role", "name").alias("subject"))


def edges(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """(edge, n_lines, n_others): what each edge role's pattern (edge, pattern) finds among the names."""
    names = elements.filter(T.stripped("name") != "").groupBy("name").agg(F.count_if(F.col("geometry") == "line").alias("l"), F.count(F.lit(1)).alias("n"))
    hits = P.matches(names, roles).join(graph.dealt(names), "name")
    found = roles.select("edge", "pattern").join(graph.dealt(hits), "pattern", "left").groupBy("edge").agg(F.coalesce(F.sum("l"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.select("edge", "n_lines", (F.col("n") - F.col("n_lines")).alias("n_others"))


def continuity(points: DataFrame, tolerance: float) -> DataFrame:
    """(edge, broken) of directed legs (edge, ord, x0, y0, x1, y1): whether some leg doesn't begin where the one before ends."""
    w = Window.partitionBy("edge").orderBy("ord")
    gap = F.hypot(F.lead("x0").over(w) - F.col("x1"), F.lead("y0").over(w) - F.col("y1"))
    return points.withColumn("gap", gap).groupBy("edge").agg(F.coalesce(F.bool_or(F.col("gap") > tolerance), F.lit(False)).alias("broken"))


def on_boundary(px, py, x, y, w, h, tolerance):
    """Whether a point is on the boundary of a box."""
    inside = px.between(x - tolerance, x + w + tolerance) & py.between(y - tolerance, y + h + tolerance)
    return (w > 0) & (h > 0) & inside & (F.least(F.abs(px - x), F.abs(px - x - w), F.abs(py - y), F.abs(py - y - h)) <= tolerance)


def evidence(elements: DataFrame, roles: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(edge, state, reason) of edge roles (edge, pattern, source, target, ordered array of names).

    elements: name, geometry, bbox, endpoints (array of two [x, y]) and, of bound connectors, source_name and
    target_name.  A line's box can't say which way it runs, so without endpoints nothing is verified.  The first
    reason that applies counts.
    """
    named, roles = graph.cut(elements.filter(T.stripped("name") != "")), graph.cut(roles)
    count = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("geometry").alias("geometry"), F.first("bbox").alias("bbox"), F.first("endpoints").alias("endpoints"))
    lines = named.filter(F.col("geometry") == "line")
    matched = roles.select("edge", "pattern").join(graph.dealt(P.matches(lines, roles)), "pattern").join(graph.dealt(lines), "name").groupBy("edge").agg(F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list("name")).alias("names"), F.first("source_name").alias("source_name"), F.first("target_name").alias("target_name"))
    end = lambda which: count.select(F.col("name").alias(which), *(F.col(c).alias(f"{which}_{c}") for c in ("n", "geometry", "bbox")))
    legs = roles.filter("ordered is not null").select("edge", F.posexplode("ordered").alias("ord", "name")).join(graph.dealt(count), "name", "left")
    good = (F.size("endpoints") == 2) & F.forall("endpoints", lambda p: (F.size(p) == 2) & F.forall(p, lambda v: finite(v)))
    leg = legs.select("edge", "ord", F.coalesce(F.col("n") == 1, F.lit(False)).alias("one"), F.coalesce(good, F.lit(False)).alias("good"), *(F.get(F.get("endpoints", F.lit(i)), F.lit(k)).alias(f"{c}{i}") for i in (0, 1) for k, c in enumerate("xy")))
    ends = leg.groupBy("edge").agg(F.bool_and("one").alias("one"), F.bool_and("good").alias("good"), F.min(F.struct("ord", "x0", "y0")).alias("a"), F.max(F.struct("ord", "x1", "y1")).alias("z"))
    j = roles
    for side, on in ((matched, "edge"), (ends, "edge"), (continuity(leg, tolerance), "edge"), (end("source"), "source"), (end("target"), "target")):
        j = j.join(graph.dealt(side), on, "left")
    at = lambda which, k: F.get(F.col(f"{which}_bbox"), F.lit(k))
    rect = lambda which: (F.col(f"{which}_geometry") == "rect") & (F.size(f"{which}_bbox") == 4)
    touches = lambda which, p: on_boundary(F.col(f"{p}.x{0 if p == 'a' else 1}"), F.col(f"{p}.y{0 if p == 'a' else 1}"), *(at(which, k) for k in range(4)), tolerance)
    bound = (F.col("n_lines") == 1) & F.col("source_name").isNotNull() & F.col("target_name").isNotNull()
    same = (F.col("source_name") == F.col("source")) & (F.col("target_name") == F.col("target"))
    ladder = [
        (F.col("source").isNull() & F.col("target").isNull() & F.col("ordered").isNull(), UNKNOWN, "no binding declared"),
        (F.coalesce("n_lines", F.lit(0)) == 0, FAIL, "no line"),
        ((F.coalesce("source_n", F.lit(0)) != 1) | (F.coalesce("target_n", F.lit(0)) != 1), FAIL, "endpoint missing or ambiguous"),
        (bound & same, PASS, "bound endpoints"),
        (bound, FAIL, "bound endpoints differ"),
        (F.coalesce(F.size("ordered") < 1, F.lit(True)), UNKNOWN, "no ordered names"),
        (F.sort_array("ordered") != F.col("names"), FAIL, "route does not cover the lines"),
        (~F.col("one"), FAIL, "segment name is ambiguous"),
        (~F.col("good"), UNKNOWN, "no directed endpoints"),
        (F.col("broken"), FAIL, "route is discontinuous"),
        (~F.coalesce(rect("source") & rect("target"), F.lit(False)), UNKNOWN, "endpoints aren't rectangles"),
        (~touches("source", "a") | ~touches("target", "z"), FAIL, "endpoint misses the boundary"),
    ]
    state, reason = F, F
    for test, s, why in ladder:
        state, reason = state.when(test, s), reason.when(test, why)
    return j.select("edge", state.otherwise(PASS).alias("state"), reason.otherwise("continuous and attached").alias("reason"))


def audit(elements: DataFrame, outputs: DataFrame, roles: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(rule, subject): issues of nodes and edges; edges that can't be verified come as `not verified`."""
    e = evidence(elements, roles, tolerance)
    seen = edges(elements, roles)
    return nodes(elements, outputs).unionByName(seen.filter("n_lines = 0").select(F.lit("no editable line").alias("rule"), F.col("edge").alias("subject"))).unionByName(e.filter(F.col("state") == FAIL).filter("reason <> 'no line'").select(F.col("reason").alias("rule"), F.col("edge").alias("subject"))).unionByName(e.filter(F.col("state") == UNKNOWN).select(F.concat(F.lit("not verified: "), "reason").alias("rule"), F.col("edge").alias("subject")))


def scope(reasons: DataFrame, names: DataFrame, patterns: DataFrame) -> DataFrame:
    """reasons (name, reason) with `selected`: whether a contract's names (name) or patterns (pattern) choose the object."""
    by_pattern = P.matches(reasons, patterns).select("name")
    chosen = names.select("name").union(by_pattern).distinct().withColumn("selected", F.lit(True))
    return reasons.join(graph.dealt(chosen), "name", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
