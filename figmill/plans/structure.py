"""Comparison of two pixel supports: overlap, boundary distances, topology, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.operators import coverage, graph, masks

KEYS = ["image_id", "y", "x"]
NEAR = 2  # side of the first cells in which boundaries meet


def selector_issues(selectors: DataFrame) -> DataFrame:
    """(rule, subject) of selectors (id, rgb array of [low, high], differences array of [a, b, low, high], observation)."""
    rgb = (F.size("rgb") == 3) & F.forall("rgb", lambda r: (F.size(r) == 2) & F.forall(r, lambda v: v.isNotNull()) & (r[0] >= 0) & (r[0] <= r[1]) & (r[1] <= 255))
    pairs = F.transform("differences", lambda d: F.concat_ws(",", F.get(d, F.lit(0)), F.get(d, F.lit(1))))
    one = F.forall("differences", lambda d: (F.size(d) == 4) & F.forall(d, lambda v: v.isNotNull()) & F.get(d, F.lit(0)).between(0, 2) & F.get(d, F.lit(1)).between(0, 2) & (F.get(d, F.lit(0)) != F.get(d, F.lit(1))) & (F.get(d, F.lit(2)) >= -255) & (F.get(d, F.lit(2)) <= F.get(d, F.lit(3))) & (F.get(d, F.lit(3)) <= 255))
    no = lambda c: selectors.filter(~F.coalesce(c, F.lit(False)))
    return coverage.violations({"rgb ranges": no(rgb), "too many differences": no(F.size("differences").between(0, 6)), "channel differences": no(one & (F.size(F.array_distinct(pairs)) == F.size(pairs))), "no observation": no(T.stripped("observation") != "")}, "id")


def nearest(a: DataFrame, b: DataFrame, cell: int = 16) -> DataFrame:
    """(image_id, y, x, distance): exact distance of each point of a from the nearest of b, for images that both have.

    Points meet over grid cells: a point is compared with its cell and the eight around it.  What lies outside them
    is farther than a cell's side, so a nearest one within that is final; the other points go on with cells of twice
    the side.  Far-off points are never paired while near ones exist, and a round has nine cells a point at any size.
    Points with a null or endless coordinate have no distance.
    """
    finite = lambda d: d.select(*KEYS).filter("abs(y) < 9e15 and abs(x) < 9e15")
    right = finite(b).select("image_id", F.col("y").alias("by"), F.col("x").alias("bx"))
    open_, done, side = finite(a).join(right.select("image_id").distinct(), "image_id", "left_semi"), None, cell
    while True:
        at = lambda c: F.floor(F.col(c) / side)  # noqa: E731, B023
        cells = F.array(*(F.struct((at("y") + dy).alias("cy"), (at("x") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        dy, dx = (F.col(c).cast("double") - F.col(f"b{c}") for c in ("y", "x"))
        square = dy * dy + dx * dx
        around = open_.select(*KEYS, F.inline(cells)).join(right.withColumn("cy", at("by")).withColumn("cx", at("bx")), ["image_id", "cy", "cx"], "left")
        found = graph.cut(around.groupBy(*KEYS).agg(F.min(square).alias("s")))
        final = F.coalesce(F.col("s") <= side * side, F.lit(False))
        settled = found.filter(final).select(*KEYS, F.sqrt("s").alias("distance"))
        done, open_ = settled if done is None else done.unionByName(settled), found.filter(~final).select(*KEYS)
        if open_.isEmpty():
            return done
        side *= 2


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per image: max and 95th percentile of boundary distances both ways, the direction and place of the worst (first in row order on ties; a to b on equal)."""
    x, y = graph.cut(masks.boundary(a)), graph.cut(masks.boundary(b))
    both = nearest(x, y, NEAR).withColumn("way", F.lit(0)).unionByName(nearest(y, x, NEAR).withColumn("way", F.lit(1)))
    g = both.groupBy("image_id", "way").agg(F.max("distance").alias("most"), F.percentile("distance", 0.95).alias("p95"), F.max(F.struct("distance", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("worst"))
    top = F.max(F.struct("most", (-F.col("way")).alias("way"), "worst"))
    out = g.groupBy("image_id").agg(F.max("most").alias("boundary_max"), F.max("p95").alias("boundary_p95"), top.alias("t"))
    return out.select("image_id", "boundary_max", "boundary_p95", F.when(F.col("t.way") == 0, "a to b").otherwise("b to a").alias("direction"), (-F.col("t.worst.x")).alias("worst_x"), (-F.col("t.worst.y")).alias("worst_y"))


def differing_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per image: the box of the pixels that b lacks and of those that it has beyond a (null if none)."""
    j = a.select(*KEYS, F.lit(1).alias("a_")).join(b.select(*KEYS, F.lit(1).alias("b_")), KEYS, "full")
    box = lambda where: F.when(F.count_if(where) > 0, F.struct(F.min(F.when(where, F.col("x"))).alias("x0"), F.min(F.when(where, F.col("y"))).alias("y0"), (F.max(F.when(where, F.col("x"))) + 1).alias("x1"), (F.max(F.when(where, F.col("y"))) + 1).alias("y1")))
    return j.groupBy("image_id").agg(box(F.col("b_").isNull()).alias("missing_box"), box(F.col("a_").isNull()).alias("extra_box"))


def region_counts(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, label, n): how many of a mask's pixels each labelled region has."""
    return labels.join(mask.select(*KEYS), KEYS, "left_semi").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


def coverage_changes(a: DataFrame, b: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, event, label, area, changed): holes that b has where a is filled, and holes of a that b fills.  Regions at the border aren't holes."""
    events = []
    for name, voids_of, filled in (("introduced hole", b, a), ("filled hole", a, b)):
        labels = masks.regions(masks.complement(voids_of, height, width))
        stats = masks.region_stats(labels, height, width).filter("not touches_border")
        events.append(stats.join(region_counts(labels, filled), ["image_id", "label"]).select("image_id", F.lit(name).alias("event"), "label", "area", F.col("n").alias("changed")))
    return events[0].unionByName(events[1])


def owned(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """(image_id, status, label) for seeds (image_id, y, x): all must be on one region of the mask, none twice."""
    labels = masks.regions(mask, eight=True)
    j = seeds.join(labels, KEYS, "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y", "x").alias("places"), F.count("label").alias("hits"), F.count_distinct("label").alias("labels"), F.min("label").alias("label"))
    status = F.when(F.col("places") < F.col("n"), "repeated seed").when(F.col("hits") < F.col("n"), "seed off the support").when(F.col("labels") != 1, "seeds disagree").otherwise("owned")
    return j.select("image_id", status.alias("status"), F.when(status == "owned", F.col("label")).alias("label"))


def compare(a: DataFrame, b: DataFrame, height: int, width: int, min_iou: float, max_px: float, max_p95: float, exact_topology: bool = True) -> DataFrame:
    """Per image: iou, distances, topology of both sides, and whether all gates pass (the 95th percentile never replaces the maximum)."""
    m = masks.compare(a, b).join(distances(a, b), "image_id", "left")
    for side, mask in (("a", a), ("b", b)):
        t = masks.topology(mask, height, width).select("image_id", F.col("parts").alias(f"{side}_parts"), F.col("holes").alias(f"{side}_holes"))
        m = m.join(t, "image_id", "left")
    same = F.col("a_parts").eqNullSafe(F.col("b_parts")) & F.col("a_holes").eqNullSafe(F.col("b_holes"))
    passed = (F.col("iou") >= min_iou) & (F.col("boundary_max") <= max_px) & (F.col("boundary_p95") <= max_p95) & (same | F.lit(not exact_topology))
    return m.withColumn("topology_equal", same).withColumn("passed", F.coalesce(passed, F.lit(False)))
