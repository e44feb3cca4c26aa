"""Audit of orthogonal routes and buses drawn as line segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.numeric import number, projected_overlap
from figmill.operators import coverage, graph

# Which names are flow lines, and how route legs and buses are named.
INCLUDE = r"(?i)(?:^|[-_])(flow|connector|route|segment|bus|link)(?:[-_]|$)"
SEGMENT, BUS = r"(?i)^(.+?)[-_]segment(?:[-_])?(\d+)$", r"(?i)^(.+?)[-_]bus(?:[-_](\d+))?$"


def selected(elements: DataFrame, include: str = INCLUDE, allow: str | None = None) -> DataFrame:
    """The line elements that are audited: geometry `line`, a name that `include` finds and `allow` doesn't."""
    d = elements.filter((F.col("geometry") == "line") & F.coalesce(F.col("name"), F.lit("")).rlike(include))
    return d if allow is None else d.filter(~F.col("name").rlike(allow))


def lines(elements: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Line elements (file, ord, name, bbox, rotation) with ends, orientation, route, index and bus; those without four box values are left out."""
    b = [number(F.get("bbox", F.lit(k))) for k in range(4)]
    d = elements.filter(F.size("bbox") == 4).select("file", "ord", "name", b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"), F.abs(b[2]).alias("w"), F.abs(b[3]).alias("h"), F.pmod(number(F.col("rotation")), F.lit(360.0)).alias("rotation"))
    kind = F.when((F.col("w") <= tolerance) & (F.col("h") <= tolerance), "point").when(F.col("w") <= tolerance, "vertical").when(F.col("h") <= tolerance, "horizontal").otherwise("diagonal")
    found = lambda p, k: F.nullif(F.lower(F.regexp_extract("name", p, k)), F.lit(""))
    return d.withColumn("orientation", kind).withColumn("route", found(SEGMENT, 1)).withColumn("index", found(SEGMENT, 2).cast("int")).withColumn("bus", found(BUS, 1))


def _on(px, py, tolerance):
    """Whether a point is on the axis-aligned line of the row."""
    flat = F.abs(py - F.col("by0")) <= tolerance
    flat &= px.between(F.least("bx0", "bx1") - tolerance, F.greatest("bx0", "bx1") + tolerance)
    steep = F.abs(px - F.col("bx0")) <= tolerance
    steep &= py.between(F.least("by0", "by1") - tolerance, F.greatest("by0", "by1") + tolerance)
    return F.when(F.col("borientation") == "horizontal", flat).otherwise(steep)


def audit(elements: DataFrame, tolerance: float = 0.05, shared: float = 1.0, include: str = INCLUDE, allow: str | None = None) -> DataFrame:
    """(file, rule, subject): one row per issue of the elements (file, ord, name, geometry, bbox, rotation).  A file is audited by itself.

    Names are compared without case.  Of the legs with one index, the first stands for the others in the
    test of continuity; all legs' ends count for a bus.  A branch belongs to every bus whose name its own begins with.
    """
    chosen = selected(elements, include, allow)
    l = graph.cut(lines(chosen, tolerance))  # every rule below reads it
    issue = lambda d, rule, subject: d.select("file", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    turned = F.least(F.col("rotation"), F.abs(F.col("rotation") - 360)) > tolerance
    own = F.array_compact(F.array(F.when(F.col("orientation") == "point", "zero-length line").when(F.col("orientation") == "diagonal", "diagonal line"), F.when(turned, "rotated line")))
    found = [issue(chosen.filter("bbox is null or size(bbox) <> 4"), "invalid bbox", "name"), l.select("file", F.explode(own).alias("rule"), F.col("name").alias("subject"))]
    legs = l.filter("route is not null")
    gaps = coverage.sequence_gaps(legs, ["file", "route"], "index")
    numbering = F.array_compact(F.array(F.when(F.col("has_gap"), "numbering gap"), F.when(F.col("n_repeated") > 0, "repeated index")))
    found.append(gaps.select("file", F.explode(numbering).alias("rule"), F.col("route").alias("subject")))
    ends = F.struct("ord", "name", "x0", "y0", "x1", "y1")
    first = legs.groupBy("file", "route", "index").agg(F.min(ends).alias("e")).select("file", "route", "index", "e.*")
    w = Window.partitionBy("file", "route").orderBy("index")
    nxt = [F.lead(c).over(w) for c in ("x0", "y0", "x1", "y1")]
    apart = F.least(*(F.greatest(F.abs(F.col(x) - nx), F.abs(F.col(y) - ny)) for x, y in (("x0", "y0"), ("x1", "y1")) for nx, ny in ((nxt[0], nxt[1]), (nxt[2], nxt[3]))))
    found.append(issue(first.withColumn("apart", apart).filter(F.col("apart") > tolerance), "disconnected", "name"))
    named = l.filter("bus is not null")
    bus = named.filter("orientation in ('horizontal', 'vertical')").select("file", "bus", F.col("ord").alias("bord"), F.col("name").alias("bname"), F.col("orientation").alias("borientation"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    # A route begins with a bus if one of its prefixes before a dash or underscore is the bus: an equi-join on prefixes.
    cut = F.filter(F.transform(F.sequence(F.lit(1), F.length("route")), lambda k: F.when(F.substring("route", k, F.lit(1)).isin("-", "_"), F.substring("route", F.lit(1), k - 1))), lambda p: p.isNotNull() & (p != ""))
    branch = legs.select("file", "route", "x0", "y0", "x1", "y1", F.explode(F.array_distinct(cut)).alias("bus")).join(named.select("file", "bus").distinct(), ["file", "bus"])
    touch = branch.join(bus, ["file", "bus"]).filter(_on(F.col("x0"), F.col("y0"), tolerance) | _on(F.col("x1"), F.col("y1"), tolerance)).select("file", "bus", "route").distinct()
    found.append(issue(branch.select("file", "bus", "route").distinct().join(touch, ["file", "bus", "route"], "left_anti"), "misses bus", "route"))
    a = bus.select(*(F.col(c).alias(f"a_{c}") if c not in ("file", "bus") else F.col(c) for c in bus.columns))
    pair = a.join(bus, ["file", "bus"]).filter((F.col("a_bord") < F.col("bord")) & (F.col("a_borientation") == F.col("borientation")))
    flat = F.col("borientation") == "horizontal"
    over = F.when(flat, projected_overlap(F.col("a_bx0"), F.col("a_bx1"), F.col("bx0"), F.col("bx1"))).otherwise(projected_overlap(F.col("a_by0"), F.col("a_by1"), F.col("by0"), F.col("by1")))
    off = F.when(flat, F.abs(F.col("a_by0") - F.col("by0"))).otherwise(F.abs(F.col("a_bx0") - F.col("bx0")))
    doubled = pair.filter((over > tolerance) & (off <= shared))
    found.append(doubled.select("file", F.when(off > tolerance, "misaligned parallel bus").otherwise("duplicate bus").alias("rule"), F.col("bname").alias("subject")))
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out
