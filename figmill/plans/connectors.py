"""Audit of bound connectors: their ends, names, arrows and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions.numeric import EMU_PER_POINT

SIDES = ("top", "left", "bottom", "right")


def port(side: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y) of the middle of a box's side (named, or numbered 0 to 3 from the top against the clock)."""
    px = F.when(side.isin("top", "0", "bottom", "2"), x + w / 2).when(side.isin("left", "1"), x).when(side.isin("right", "3"), x + w)
    py = F.when(side.isin("left", "1", "right", "3"), y + h / 2).when(side.isin("top", "0"), y).when(side.isin("bottom", "2"), y + h)
    return F.struct(px.alias("x"), py.alias("y"))


def outward(side: Column) -> Column:
    """struct(x, y): the direction out of a box at a side."""
    return F.struct(F.when(side == "left", -1).when(side == "right", 1).otherwise(0).alias("x"), F.when(side == "top", -1).when(side == "bottom", 1).otherwise(0).alias("y"))


def link_issue(start: Column, end: Column, source_side: Column, target_side: Column) -> Column:
    """Why a straight link between two ports isn't one that leaves and enters its boxes, or null."""
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    dot = lambda side: dx * outward(side)["x"] + dy * outward(side)["y"]
    return F.when((dx == 0) & (dy == 0), "no length").when((F.abs(dx) > 1e-8) & (F.abs(dy) > 1e-8), "not aligned").when((dot(source_side) <= 0) | (dot(target_side) >= 0), "runs through a box")


def dangling(edges: DataFrame, ids: DataFrame, page: str, ends: list[str]) -> DataFrame:
    """(page, edge, side, target): ends of edges (page, id, ends...) that name no id of their page."""
    e = edges.select(page, F.col("id").alias("edge"), F.inline(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("target")) for c in ends)))).filter("target is not null")
    return e.join(ids.select(page, F.col("id").alias("target")).distinct(), [page, "target"], "left_anti").select(page, "edge", "side", "target")


def audit(connectors: DataFrame, shapes: DataFrame, expected: DataFrame | None = None, require_bound: bool = False, tolerance_pt: float = 0.25) -> DataFrame:
    """(rule, slide, name, detail) of connectors (slide, id, name, source_id, source_port, target_id, target_port, start_arrow, end_arrow, x, y, w, h, flip_h, flip_v, plain).

    shapes: slide, id, name, x, y, w, h, plain.  plain: top-level, not rotated, and a straight line or a rectangle; only such
    ones have their geometry checked.  expected (slide, name, source, target, start_arrow, end_arrow; null: any)
    are compared by name.
    """
    out = []
    issue = lambda d, rule, detail: out.append(d.select(F.lit(rule).alias("rule"), "slide", "name", detail.cast("string").alias("detail")))
    known = shapes.select("slide", "id", "name").unionByName(connectors.select("slide", "id", "name"))
    issue(known.groupBy("slide", "id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate shape id", F.col("id"))
    issue(connectors.groupBy("slide", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate connector name", F.col("n"))
    first = known.groupBy("slide", "id").agg(F.max("name").alias("node"))
    ends = connectors
    for side in ("source", "target"):
        ends = ends.join(first.select("slide", F.col("id").alias(f"{side}_id"), F.col("node").alias(side)), ["slide", f"{side}_id"], "left")
        if require_bound:
            issue(connectors.filter(F.col(f"{side}_id").isNull()), "unbound end", F.lit(side))
        issue(ends.filter(F.col(f"{side}_id").isNotNull() & F.col(side).isNull()), "dangling end", F.concat(F.lit(f"{side}:"), f"{side}_id"))
    if expected is not None:
        want = expected.select("slide", "name", *(F.col(c).alias(f"want_{c}") for c in ("source", "target", "start_arrow", "end_arrow")))
        both = ends.join(want, ["slide", "name"])
        for c in ("source", "target", "start_arrow", "end_arrow"):
            issue(both.filter(F.col(f"want_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"want_{c}"))), "connection differs", F.concat_ws(":", F.lit(c), F.coalesce(c, F.lit("none"))))
        issue(want.join(connectors.select("slide", "name"), ["slide", "name"], "left_anti"), "missing connector", F.col("name"))
    near = EMU_PER_POINT * tolerance_pt
    boxes = shapes.filter("plain").select("slide", "id", *(F.col(c).cast("double").alias(f"n{c}") for c in "xywh"))
    flat = ends.filter("plain")
    for side in ("source", "target"):
        b = boxes.select("slide", F.col("id").alias(f"{side}_id"), *(F.col(f"n{c}").alias(f"{side}_{c}") for c in "xywh"))
        flat = flat.join(b, ["slide", f"{side}_id"]).withColumn(f"{side}_at", port(F.col(f"{side}_port"), *(F.col(f"{side}_{c}") for c in "xywh")))
    at = {"source": ("flip_h", "flip_v", False), "target": ("flip_h", "flip_v", True)}
    issue(flat.filter((F.col("w") > near) & (F.col("h") > near)), "diagonal connector", F.lit(None))
    issue(flat.filter("w = 0 and h = 0"), "zero-length connector", F.lit(None))
    for side, (fh, fv, far) in at.items():
        x = F.when(F.col(fh) != F.lit(far), F.col("x") + F.col("w")).otherwise(F.col("x"))
        y = F.when(F.col(fv) != F.lit(far), F.col("y") + F.col("h")).otherwise(F.col("y"))
        issue(flat.filter(F.hypot(x - F.col(f"{side}_at.x"), y - F.col(f"{side}_at.y")) > near), "end off its port", F.lit(side))
    total = out[0]
    for d in out[1:]:
        total = total.unionByName(d)
    return total


def readback(package: DataFrame, application: DataFrame) -> DataFrame:
    """(slide, id, side, rule): where the application's connectors (slide, id, name, begin_*, end_*) differ from the package's.

    package: slide, id, name, source_id, source_name, source_port, target_...; the application counts sites from 1.
    """
    j = package.alias("p").join(application.alias("a"), ["slide", "id"], "left")
    rules = []
    for side, end in (("source", "begin"), ("target", "end")):
        bound = F.col(f"p.{side}_id").isNotNull()
        rule = (
            F.when(F.col("a.name").isNull() | (F.col("a.name") != F.col("p.name")), "name")
            .when(~F.col(f"a.{end}_connected").eqNullSafe(bound), "binding")
            .when(bound & (~F.col(f"a.{end}_id").cast("string").eqNullSafe(F.col(f"p.{side}_id").cast("string")) | ~F.col(f"a.{end}_name").eqNullSafe(F.col(f"p.{side}_name"))), "endpoint")
            .when(bound & ~F.col(f"a.{end}_site").eqNullSafe(F.col(f"p.{side}_port").cast("int") + 1), "site")
        )
        rules.append(F.struct(F.lit(side).alias("side"), rule.alias("rule")))
    return j.select("slide", "id", F.inline(F.array(*rules))).filter("rule is not null")
