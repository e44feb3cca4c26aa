"""Measurements of text: what an application laid out, and the ink in a raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import finite
from figmill.operators import intervals

# When an ink measurement isn't to be trusted.
MIN_SEPARATION, MIN_INK, MAX_INK, RATIO = 25.0, 8, 0.45, 1.18


def overflow(bounds: Column, frame: Column) -> Column:
    """How far a box reaches out of another (arrays of x, y, w, h), to three places; 0 if it doesn't."""
    b, f = ([F.get(v, F.lit(k)) for k in range(4)] for v in (bounds, frame))
    return F.round(F.greatest(f[0] - b[0], f[1] - b[1], b[0] + b[2] - f[0] - f[2], b[1] + b[3] - f[1] - f[3], F.lit(0.0)), 3)


def layout(items: DataFrame, frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, status, overflow, rules) of items (id, slide, name, shape_id, text) against an application's frames and text bounds.

    frames: slide, name, shape_id, box, rotation.  bounds: the same with text and line_count.  An item is checked
    if exactly one frame and one text of its slide and name have its shape id; else it isn't verified, and `rules` says why.
    """
    one = lambda d, p: d.groupBy("slide", "name").agg(F.count(F.lit(1)).alias(f"{p}_n"), *(F.first(c).alias(f"{p}_{c}") for c in d.columns if c not in ("slide", "name")))
    j = items.join(one(frames, "f"), ["slide", "name"], "left").join(one(bounds, "b"), ["slide", "name"], "left")
    box = lambda c: (F.size(c) == 4) & F.forall(c, lambda v: finite(v)) & (F.get(c, F.lit(2)) > 0) & (F.get(c, F.lit(3)) > 0)
    upright = lambda c: finite(F.col(c)) & (F.abs(F.col(c)) <= 0.001)
    bound = (F.col("f_n") == 1) & (F.col("b_n") == 1) & (F.col("f_shape_id") == F.col("shape_id")) & (F.col("b_shape_id") == F.col("shape_id"))
    fit = box("f_box") & box("b_box") & upright("f_rotation") & upright("b_rotation")
    said = T.nfc(T.line_breaks(F.col("text")))
    why = F.when(~F.coalesce(bound, F.lit(False)), "no single frame and text").when(~F.coalesce(fit, F.lit(False)), "not upright").when(~F.coalesce(T.nfc(T.line_breaks(F.col("b_text"))) == said, F.lit(False)), "text differs").when(~F.coalesce(F.col("b_line_count") >= 1, F.lit(False)), "no line count")
    lines = F.length(said) - F.length(F.replace(said, F.lit("\n"), F.lit(""))) + 1
    over = overflow(F.col("b_box"), F.col("f_box"))
    issues = F.array_compact(F.array(F.when(F.col("b_line_count") != lines, "line count"), F.when(over > 1.0, "outside its frame")))
    d = j.withColumn("why", why)
    return d.select("id", F.when(F.col("why").isNotNull(), "NOT_VERIFIED").when(F.size(issues) > 0, "FAIL").otherwise("PASS").alias("status"), F.when(F.col("why").isNull(), over).alias("overflow"), F.when(F.col("why").isNotNull(), F.array("why")).otherwise(issues).alias("rules"))


def thresholds(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold, separation) of gray pixels (image_id, y, x, v): the first level of greatest between-class variance.  A window over 256 levels an image."""
    h = pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    s = F.col("n") * F.col("v")
    c = h.select("image_id", "v", F.sum("n").over(w).alias("a"), F.sum(s).over(w).alias("sa"), F.sum("n").over(whole).alias("t"), F.sum(s).over(whole).alias("st"))
    apart = F.abs(F.col("sa") / F.col("a") - (F.col("st") - F.col("sa")) / F.nullif(F.col("t") - F.col("a"), F.lit(0)))
    between = F.coalesce(F.col("a").cast("double") * (F.col("t") - F.col("a")) * apart * apart, F.lit(0.0))
    best = c.withColumn("between", between).withColumn("apart", F.coalesce(apart, F.lit(0.0))).groupBy("image_id").agg(F.max(F.struct("between", (-F.col("v")).alias("v"), "apart")).alias("m"))
    return best.select("image_id", F.when(F.col("m.between") > 0, -F.col("m.v")).otherwise(0).alias("threshold"), F.when(F.col("m.between") > 0, F.col("m.apart")).otherwise(0.0).alias("separation"))


def ink(pixels: DataFrame) -> DataFrame:
    """Ink pixels (image_id, y, x, polarity): the class, dark or light, that has at most half of an image's pixels; none without two classes."""
    t = pixels.join(thresholds(pixels), "image_id")
    n = t.groupBy("image_id").agg((2 * F.count_if(F.col("v") <= F.col("threshold")) <= F.count(F.lit(1))).alias("dark"))
    return t.join(n, "image_id").filter((F.col("separation") > 0) & ((F.col("v") <= F.col("threshold")) == F.col("dark"))).select("image_id", "y", "x", F.when(F.col("dark"), "dark").otherwise("light").alias("polarity"))


def bands(mask: DataFrame, gap: int = 2) -> DataFrame:
    """(image_id, y0, y1, x0, x1): boxes of the ink in each run of rows, gaps of up to `gap` rows bridged."""
    rows = intervals.occupied_runs(mask, ["image_id"], "y", gap).select("image_id", F.col("start").alias("y0"), F.col("end").alias("y1"))
    j = rows.join(mask, "image_id").filter("y >= y0 and y < y1")
    return j.groupBy("image_id", "y0", "y1").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def measure(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, status, threshold, separation, polarity, pixels, fraction, lines, uncertain) of images (image_id, width, height, text).

    `uncertain` lists why a measurement may be wrong; only one without reasons is INK_MEASURED.
    """
    mask = ink(pixels)
    t = thresholds(pixels)
    m = mask.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("polarity").alias("polarity"))
    b = bands(mask).groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"))
    edge = pixels.join(sizes, "image_id").filter("x = 0 or y = 0 or x = width - 1 or y = height - 1").groupBy("image_id").agg(F.median("v").alias("ground"))
    light = pixels.join(edge, "image_id").groupBy("image_id").agg(F.count_if(F.col("v") - F.col("ground") <= -MIN_SEPARATION).alias("darker"), F.count_if(F.col("v") - F.col("ground") >= MIN_SEPARATION).alias("lighter"))
    wide = F.greatest(F.lit(12), F.ceil(0.85 * (F.col("x1") - F.col("x0") + 1)))
    runs = intervals.occupied_runs(mask, ["image_id", "y"], "x", 0).join(m.select("image_id", wide.alias("wide")), "image_id").filter(F.col("end") - F.col("start") >= F.col("wide"))
    rule = intervals.occupied_runs(runs, ["image_id"], "y", 0).groupBy("image_id").agg(F.bool_or(F.col("end") - F.col("start") <= 3).alias("rule"))
    j = sizes.join(t, "image_id", "left").join(m, "image_id", "left").join(b, "image_id", "left").join(light, "image_id", "left").join(rule, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, area = zero("pixels"), F.col("width") * F.col("height")
    said = F.size(F.filter(F.split(T.line_breaks(F.col("text")), "\n"), lambda v: T.stripped(v) != ""))
    touch = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y1") == F.col("height") - 1)
    why = F.array_compact(
        F.array(
            F.when(n == 0, "no_detectable_ink"), F.when(zero("separation") < MIN_SEPARATION, "low_luminance_contrast"), F.when((n > 0) & (n < MIN_INK), "limited_ink_pixels"), F.when(n / area > MAX_INK, "high_ink_fraction"), F.when(touch, "ink_touches_crop_edge"),
            F.when((zero("darker") >= MIN_INK) & (zero("lighter") >= MIN_INK), "suspected_mixed_polarity"), F.when(F.col("rule"), "suspected_thin_rule"), F.when(said != zero("lines"), "line_count_disagrees_with_transcription"), F.when(said == 0, "no_nonempty_explicit_lines"),
        )
    )
    return j.select("image_id", F.when(F.size(why) > 0, "AMBIGUOUS").otherwise("INK_MEASURED").alias("status"), "threshold", F.round("separation", 2).alias("separation"), "polarity", n.alias("pixels"), F.round(n / area, 6).alias("fraction"), zero("lines").alias("lines"), why.alias("uncertain"))


def font_size(lines: DataFrame) -> DataFrame:
    """(id, status, size) of lines (id, width, height, ref_width, ref_height, ref_size): the median of the sizes that widths and heights imply.

    No estimate where they differ by more than a factor RATIO, or a line is under 6 pixels high.
    """
    sizes = lines.select("id", "height", F.explode(F.array(F.col("width") * F.col("ref_size") / F.col("ref_width"), F.col("height") * F.col("ref_size") / F.col("ref_height"))).alias("v"))
    g = sizes.groupBy("id").agg(F.median("v").alias("size"), (F.max("v") / F.min("v")).alias("ratio"), F.min("height").alias("least"))
    status = F.when(F.coalesce(F.col("least") < 6, F.lit(True)), "glyph_size_not_comparable").when(F.col("ratio") > RATIO, "scales_disagree").otherwise("ADVISORY_ESTIMATE")
    return g.select("id", status.alias("status"), F.when(status == "ADVISORY_ESTIMATE", F.round("size", 2)).alias("size"))


def chosen(items: DataFrame, ids: DataFrame | None, width: float, height: float) -> DataFrame:
    """(id, rule): the text items (id, role, text, bbox) that `ids` (id) choose, or all, and what is wrong with their boxes."""
    t = items.filter("role = 'text'")
    if ids is not None:
        t = t.join(ids.select("id").distinct(), "id", "left_semi")
    v = [F.get("bbox", F.lit(k)) for k in range(4)]
    good = (F.size("bbox") == 4) & F.forall("bbox", lambda x: finite(x)) & (v[0] >= 0) & (v[1] >= 0) & (v[2] > 0) & (v[3] > 0) & (v[0] + v[2] <= width) & (v[1] + v[3] <= height)
    return t.select("id", F.when(~F.coalesce(good, F.lit(False)), "invalid box").when(F.col("text").isNull(), "no text").alias("rule"))
