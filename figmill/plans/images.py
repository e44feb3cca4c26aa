"""Raster audits: pixels as rows (image_id, y, x, r, g, b, a), compared and measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figmill.functions.numeric import crosses, finite, point_segment
from figmill.operators import graph, grid, masks

KEYS = ["image_id", "y", "x"]
FEW = 32
SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of every image file under the path, row by row.  Alpha is 255 where an image has none.

    Decoded by Spark's image source; its channels come as blue, green, red.  A file that it can't decode has no rows.
    """
    d = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path).select("image.*")
    n = F.col("nChannels")
    at = lambda k: F.conv(F.hex(F.substring("data", (F.col("p") * n + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = d.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    gray = n == 1
    return px.select(F.col("origin").alias("image_id"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), F.when(gray, at(0)).otherwise(at(2)).alias("r"), F.when(gray, at(0)).otherwise(at(1)).alias("g"), at(0).alias("b"), F.when(n == 4, at(3)).otherwise(255).alias("a"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Display luminance of 8-bit channels, in whole codes."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536)


def asset(pixels: DataFrame, sizes: DataFrame, threshold: int = 8, edge: float = 0.02, min_edge: int = 256, occupancy: tuple[float, float] = (0.05, 0.98)) -> DataFrame:
    """(image_id, x0, y0, x1, y1, visible, bbox_occupancy, rules) of images (image_id, width, height): the visible box and what speaks against the asset."""
    p = pixels.join(sizes, "image_id")
    on = F.col("a") > threshold
    box = lambda f, c, add=0: (f(F.when(on, F.col(c))) + add)
    g = p.groupBy("image_id", "width", "height").agg(F.min("a").alias("least"), F.count_if(on).alias("visible"), box(F.min, "x").alias("x0"), box(F.min, "y").alias("y0"), box(F.max, "x", 1).alias("x1"), box(F.max, "y", 1).alias("y1"))
    limit = F.greatest(F.lit(1), F.ceil(F.least("width", "height") * edge))
    near = (F.col("x0") < limit) | (F.col("y0") < limit) | (F.col("width") - F.col("x1") < limit) | (F.col("height") - F.col("y1") < limit)
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    clear = F.col("least") < 255
    rules = F.array_compact(F.array(F.when(F.col("visible") == 0, "nothing visible"), F.when(clear & near, "visible at the edge"), F.when(clear & (share < occupancy[0]), "subject too small"), F.when(clear & (share > occupancy[1]), "bounds too tight"), F.when(F.greatest("width", "height") < min_edge, "too few pixels")))
    return g.select("image_id", "x0", "y0", "x1", "y1", "visible", F.coalesce(F.round(share, 6), F.lit(0.0)).alias("bbox_occupancy"), rules.alias("rules"))


def patch_colours(pixels: DataFrame, patches: DataFrame, whole: str = "half even") -> DataFrame:
    """(patch, n, r, g, b): the median colour of patches (patch, image_id, x, y, w, h), rounded half to even or cut off; null where a pixel isn't opaque."""
    j = patches.select("patch", "image_id", F.col("x").alias("px"), F.col("y").alias("py"), "w", "h").join(pixels, "image_id").filter("x >= px and x < px + w and y >= py and y < py + h")
    fit = {"half even": F.bround, "down": F.floor}[whole]
    opaque = F.min("a") == 255
    return j.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), *(F.when(opaque, fit(F.median(c)).cast("int")).alias(c) for c in "rgb"))


def probes(pixels: DataFrame, samples: DataFrame, matte: int = 255) -> DataFrame:
    """(probe, sample, n, median, spread) of samples (probe, sample, image_id, x, y, w, h): luminance over a matte, 0 to 1; spread is the 90th less the 10th percentile."""
    j = samples.select("probe", "sample", "image_id", F.col("x").alias("px"), F.col("y").alias("py"), "w", "h").join(pixels, "image_id").filter("x >= px and x < px + w and y >= py and y < py + h")
    over = [F.bround((F.col(c) * F.col("a") + matte * (255 - F.col("a"))) / 255) for c in "rgb"]
    v = luma(*over) / 255
    return j.withColumn("v", v).groupBy("probe", "sample").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"), (F.percentile("v", 0.9) - F.percentile("v", 0.1)).alias("spread"))


def appearance(probe: DataFrame, requirements: DataFrame) -> DataFrame:
    """(id, value, state) of requirements (id, probe, kind `luma_median`, `luma_spread` or `luma_delta`, low, high, min_pixels): measured between low and high.

    A delta is sample 0 less sample 1.  A probe without its samples, or with too few pixels, isn't verified.
    """
    g = probe.groupBy("probe").agg(F.min("n").alias("n"), *(F.max(F.when(F.col("sample") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("median", "spread")))
    j = requirements.join(g, "probe", "left")
    value = F.when(F.col("kind") == "luma_delta", F.col("median0") - F.col("median1")).when(F.col("kind") == "luma_spread", F.col("spread0")).otherwise(F.col("median0"))
    good = F.coalesce((F.col("n") >= F.col("min_pixels")) & value.isNotNull(), F.lit(False))
    return j.select("id", F.when(good, value).alias("value"), F.when(~good, "NOT_VERIFIED").when(value.between(F.col("low"), F.col("high")), "PASS").otherwise("FAIL").alias("state"))


def paint_order(objects: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, state) of orders (id, back, front) among objects (ord, name): both names must be one object, and back comes before front."""
    n = objects.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    j = orders
    for side in ("back", "front"):
        j = j.join(n.select(F.col("name").alias(side), F.col("n").alias(f"{side}_n"), F.col("ord").alias(f"{side}_ord")), side, "left")
    one = F.coalesce((F.col("back_n") == 1) & (F.col("front_n") == 1), F.lit(False))
    return j.select("id", F.when(~one, "NOT_VERIFIED").when(F.col("back_ord") < F.col("front_ord"), "PASS").otherwise("FAIL").alias("state"))


def differences(a: DataFrame, b: DataFrame, threshold: int = 16) -> DataFrame:
    """Per image: mean difference and similarity over all pixels and over the foreground (ink above the threshold in either), and shares of changed pixels."""
    both = a.select(*KEYS, *(F.col(c).alias(f"{c}0") for c in "rgb")).join(b.select(*KEYS, *(F.col(c).alias(f"{c}1") for c in "rgb")), KEYS)
    d = [F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in "rgb"]
    mean = (d[0] + d[1] + d[2]) / 3 / 255
    changed = luma(*d) > threshold
    front = F.greatest(*(255 - luma(*(F.col(f"{c}{k}") for c in "rgb")) for k in (0, 1))) > threshold
    n = F.count_if(front)
    on = F.avg(F.when(front, mean))
    return both.groupBy("image_id").agg(
        F.avg(mean).alias("mean_difference"), (1 - F.avg(mean)).alias("similarity"), (F.count_if(changed) / F.count(F.lit(1))).alias("changed"), (n / F.count(F.lit(1))).alias("foreground"),
        F.coalesce(on, F.lit(0.0)).alias("foreground_difference"), (1 - F.coalesce(on, F.lit(0.0))).alias("foreground_similarity"), F.coalesce(F.count_if(changed & front) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("foreground_changed"),
    )


def _tiled(pixels: DataFrame) -> DataFrame:
    """Pixels dealt by tiles, so that what neighbours add to one place is summed before it is shuffled."""
    return pixels.repartition("image_id", *(F.floor(F.col(c) / masks.TILE) for c in ("y", "x")))


def edges(gray: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, v): eight times a gray pixel less its eight neighbours, cut to 0..255; the outermost pixels stay as they are."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    spread = _tiled(gray).select("image_id", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), (F.col("v") * (8 if (dy, dx) == (0, 0) else -1)).alias("s"), F.when(F.lit((dy, dx) == (0, 0)), F.col("v")).alias("own")) for dy, dx in steps))).alias("e")).select("image_id", "e.*")
    rim = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    g = spread.groupBy(*KEYS).agg(F.sum("s").alias("s"), F.max("own").alias("own")).filter("own is not null")
    return g.select(*KEYS, F.when(rim, F.col("own")).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.col("s")))).cast("int").alias("v"))


def worst_window(diff: DataFrame, size: int) -> DataFrame:
    """(image_id, y, x, total): the size by size window (by its first corner) of greatest sum of v, first in row order on ties.  A plain difference, not a perceptual one.

    A pixel adds to the `size` windows of its row that hold it, and a row's sum to those of its column.
    """
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    rows = _tiled(diff).withColumn("k", F.explode(steps)).filter("x >= k").groupBy("image_id", "y", (F.col("x") - F.col("k")).alias("x")).agg(F.sum("v").alias("s"))
    total = rows.withColumn("k", F.explode(steps)).filter("y >= k").groupBy("image_id", (F.col("y") - F.col("k")).alias("y"), "x").agg(F.sum("s").alias("t"))
    best = F.max(F.struct("t", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    return total.groupBy("image_id").agg(best.alias("b")).select("image_id", (-F.col("b.y")).alias("y"), (-F.col("b.x")).alias("x"), F.col("b.t").alias("total"))


def palette(pixels: DataFrame, most: int = 64) -> DataFrame:
    """(image_id, r, g, b, a, n, rule): distinct colours with counts, however many; those of an image with more than `most` carry the rule that says so."""
    c = pixels.groupBy("image_id", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("n"))
    k = c.groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
    return c.join(k, "image_id").select("image_id", *(F.col(x).cast("int").alias(x) for x in "rgba"), "n", F.when(F.col("k") > most, "too many colours").alias("rule"))


def masked(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with alpha 0 outside a mask (image_id, y, x, v of 0 or 255); an image whose mask has another value, or lacks a pixel, is left out."""
    ok = pixels.select(*KEYS).join(mask, KEYS, "left").groupBy("image_id").agg(F.bool_and(F.coalesce(F.col("v").isin(0, 255), F.lit(False))).alias("ok")).filter("ok").select("image_id")
    j = pixels.join(ok, "image_id", "left_semi").join(mask.select(*KEYS, "v"), KEYS)
    return j.select(*KEYS, *(F.when(F.col("v") == 255, F.col(c)).otherwise(0).alias(c) for c in "rgba"))


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1) of polygons (id, points array of struct(x, y)), the last point joined to the first."""
    nxt = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    e = polygons.select("id", F.explode(F.arrays_zip(F.col("points").alias("s"), nxt.alias("t"))).alias("e"))
    return e.select("id", F.col("e.s.x").alias("x0"), F.col("e.s.y").alias("y0"), F.col("e.t.x").alias("x1"), F.col("e.t.y").alias("y1"))


def inside_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, px, py) of the distinct points (id, px, py) strictly inside the polygon of their id: crossings of the edges that reach their height, summed over its slab."""
    at = [F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")]
    over = grid.crossings(points.select("id", "px", "py").distinct(), polygon_edges(polygons), ["id"], crosses(*at) == 1)
    return over.groupBy("id", "px", "py").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")


def to_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (id, px, py, ...) with `distance` from the edge of the polygon of their id and `inside`, the edge (to 1e-7) included; points without a polygon are left out.

    A point is compared with all edges of its polygon where those are at most FEW; the points of larger polygons go by cells and slabs.
    """
    e = grid.whole_edges(polygon_edges(polygons))
    n = e.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    place = points.filter(finite(F.col("px")) & finite(F.col("py")))
    few = e.join(graph.dealt(n.filter(F.col("n") <= FEW)), "id").groupBy("id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("sides_"))
    j = place.join(graph.dealt(few), "id")
    at = lambda s: (F.col("px"), F.col("py"), *(s[c] for c in ("x0", "y0", "x1", "y1")))
    j = j.withColumn("distance", F.array_min(F.transform("sides_", lambda s: point_segment(*at(s))))).withColumn("in_", F.size(F.filter("sides_", lambda s: crosses(*at(s)) == 1)) % 2 == 1)
    out = lambda d: d.select(*points.columns, "distance", ((F.col("distance") < 1e-7) | F.coalesce("in_", F.lit(False))).alias("inside"))
    many = graph.cut(n.filter(F.col("n") > FEW).select("id"))
    if many.isEmpty():
        return out(j)
    rest, theirs = (d.join(graph.dealt(many), "id", "left_semi") for d in (place, polygons))
    near = grid.edge_distances(rest, polygon_edges(theirs), ["id"])
    within = inside_polygon(rest, theirs).withColumn("in_", F.lit(True))
    return out(j).unionByName(out(rest.join(graph.dealt(near), ["id", "px", "py"]).join(graph.dealt(within), ["id", "px", "py"], "left")))


def densified(polygons: DataFrame, per_px: float = 2.0) -> DataFrame:
    """(id, px, py): points along the edges of polygons, their ends included, `per_px` for each pixel of length."""
    e = polygon_edges(polygons)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * per_px))
    s = e.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("k") / F.col("n")
    return s.select("id", at("x").alias("px"), at("y").alias("py")).distinct()


def surfaces(relations: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, landmark_error, escape, rules) of relations (id, host, detail, occluders, max_landmark, max_escape, landmarks array of struct(side, x, y)).

    paths: name, ord, slide, points.  A detail lies within its host, is painted after it and before its occluders;
    landmarks lie on the outline of their side, `host` or `detail`.
    """
    n = paths.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min("slide").alias("slide"), F.first("points").alias("points"))
    j = relations
    for side in ("host", "detail"):
        j = j.join(n.select(F.col("name").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "ord", "slide", "points"))), side, "left")
    over = relations.select("id", F.explode("occluders").alias("name")).join(n, "name", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("front_one"), F.min("ord").alias("front_ord"), F.min("slide").alias("front_s0"), F.max("slide").alias("front_s1"))
    known = j.filter("host_n = 1 and detail_n = 1")
    marks = known.select("id", "host_points", "detail_points", F.explode("landmarks").alias("m")).select("id", F.when(F.col("m.side") == "host", F.col("host_points")).otherwise(F.col("detail_points")).alias("points"), F.col("m.x").alias("px"), F.col("m.y").alias("py"), F.col("m.side").alias("side"))
    by_side = [to_polygon(marks.filter(F.col("side") == s).select("id", "px", "py"), known.select("id", F.col(f"{s}_points").alias("points"))) for s in ("host", "detail")]
    error = by_side[0].unionByName(by_side[1]).groupBy("id").agg(F.max("distance").alias("landmark_error"))
    out = to_polygon(densified(known.select("id", F.col("detail_points").alias("points"))), known.select("id", F.col("host_points").alias("points"))).groupBy("id").agg(F.max(F.when(F.col("inside"), 0.0).otherwise(F.col("distance"))).alias("escape"))
    d = j.join(over, "id", "left").join(error, "id", "left").join(out, "id", "left")
    one = F.coalesce((F.col("host_n") == 1) & (F.col("detail_n") == 1) & F.coalesce(F.col("front_one"), F.lit(True)), F.lit(False))
    far = F.col("host_slide") != F.col("detail_slide")
    front = F.coalesce((F.col("front_ord") <= F.col("detail_ord")) | (F.col("front_s0") != F.col("host_slide")) | (F.col("front_s1") != F.col("host_slide")), F.lit(False))
    rules = F.array_compact(F.array(F.when(far, "different slides"), F.when(F.col("host_ord") >= F.col("detail_ord"), "detail painted before host"), F.when(front, "wrong foreground order"), F.when(F.col("landmark_error") > F.col("max_landmark"), "landmarks off"), F.when(F.col("escape") > F.col("max_escape"), "detail leaves host")))
    return d.select("id", "landmark_error", "escape", F.when(~one, F.array(F.lit("not one object"))).otherwise(rules).alias("rules"))


def candidates(images: DataFrame, operations: DataFrame, most: int = 32) -> DataFrame:
    """(id, n, numbers, cut): for images (id, box), the operations (seq, box) of the same box to four places: how many, and the first `most`."""
    key = lambda c: F.transform(c, lambda v: F.round(v, 4))
    at = operations.select("seq", key("box").alias("k"))
    first = at.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("seq"))).filter(F.col("place") <= most)
    g = at.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(first.groupBy("k").agg(F.array_sort(F.collect_list("seq")).alias("numbers")), "k")
    j = images.select("id", key("box").alias("k")).join(g, "k", "left")
    return j.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"), (F.coalesce("n", F.lit(0)) > most).alias("cut"))


def unresolved(operations: DataFrame, records: DataFrame) -> DataFrame:
    """operations (seq, kind) that no record (seq, type) stands for; a record of type `fs` also stands for a stroke right after it."""
    stroke = operations.filter("kind = 'stroke-path'").select((F.col("seq") - 1).alias("seq"))
    after = records.filter("type = 'fs'").select("seq").join(stroke, "seq", "left_semi").select((F.col("seq") + 1).alias("seq"))
    return operations.join(records.select("seq").unionByName(after), "seq", "left_anti")


def channel_status(has_method: Column, failed: Column, rejected: Column) -> Column:
    """What came of an optional channel: EXTRACTED, UNAVAILABLE, ERROR or REJECTED."""
    return F.when(~has_method, "UNAVAILABLE").when(failed, "ERROR").when(rejected, "REJECTED").otherwise("EXTRACTED")


def native_groups(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (slide, id, name) that hold some object (slide, group)."""
    return groups.join(objects.select("slide", F.col("group").alias("id")), ["slide", "id"], "left_semi")
