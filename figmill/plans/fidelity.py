"""Fidelity of regions, of what reviewers say of appearance, and of paints sampled from a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.plans.images import KEYS, luma, patch_colours

# The scales of review views, those that every review needs, and those that transparency needs too.
SCALES, NEEDED, CLEAR = ("delivered", "detail", "light", "dark", "actual"), ("delivered", "detail"), ("light", "dark", "actual")
PASS, FAIL, OPEN = "PASS", "FAIL", "NOT_VERIFIED"


def regional(a: DataFrame, b: DataFrame, regions: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """(id, mismatch_ratio, worst_window_ratio, color_passed, structure_status, passed) of regions (id, image_id, x, y, w, h, threshold, window, max_mismatch_ratio, max_window_ratio) of two images' pixels (image_id, y, x, r, g, b).

    A pixel mismatches if its difference's luminance is over the threshold, or one side lacks it.  The whole region and its
    worst window of `window` by `window` pixels have limits of their own; a declared structure (id, passed, null where it could
    not be measured) must pass besides, and never makes up for colour.
    """
    both = a.select(*KEYS, *(F.col(c).alias(f"{c}0") for c in "rgb")).join(b.select(*KEYS, *(F.col(c).alias(f"{c}1") for c in "rgb")), KEYS, "full")
    inside = both.join(regions.select("id", "image_id", F.col("x").alias("left"), F.col("y").alias("top"), "w", "h", "threshold", "window"), "image_id").filter("x >= left AND x < left + w AND y >= top AND y < top + h")
    far = F.coalesce(luma(*(F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in "rgb")) > F.col("threshold"), F.lit(True))
    bad = inside.filter(far).select("id", "window", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"))
    n = bad.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(0), F.col("window") - 1)
    rows = bad.withColumn("k", F.explode(steps)).filter("x >= k").groupBy("id", "window", "y", (F.col("x") - F.col("k")).alias("x")).agg(F.count(F.lit(1)).alias("s"))
    worst = rows.withColumn("k", F.explode(steps)).filter("y >= k").groupBy("id", (F.col("y") - F.col("k")).alias("y"), "x").agg(F.sum("s").alias("t")).groupBy("id").agg(F.max("t").alias("t"))
    j = regions.join(n, "id", "left").join(worst, "id", "left").withColumn("mismatch_ratio", F.coalesce("n", F.lit(0)) / (F.col("w") * F.col("h"))).withColumn("worst_window_ratio", F.coalesce("t", F.lit(0)) / F.pow("window", F.lit(2)))
    color = (F.col("mismatch_ratio") <= F.col("max_mismatch_ratio")) & (F.col("worst_window_ratio") <= F.col("max_window_ratio"))
    if structure is None:
        j = j.withColumn("structure_status", F.lit("NOT_DECLARED"))
    else:
        s = structure.select("id", F.lit(True).alias("said"), F.col("passed").alias("fits"))
        j = j.join(s, "id", "left").withColumn("structure_status", F.when(F.col("said").isNull(), "NOT_DECLARED").when(F.col("fits").isNull(), OPEN).when(F.col("fits"), PASS).otherwise(FAIL))
    return j.select("id", "mismatch_ratio", "worst_window_ratio", color.alias("color_passed"), "structure_status", (color & F.col("structure_status").isin("NOT_DECLARED", PASS)).alias("passed"))


def reviews(requirements: DataFrame, records: DataFrame, views: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, requirement, review, reasons) of requirements (item, requirement, dimension, certainty), and (rule, item, requirement) of what is wrong with the records.

    records: item, requirement, status, observation; views: item, requirement, path, sha256, scale; files: path, sha256.  A
    review counts with views of all scales that its dimension needs, each bound to its file; what a source leaves uncertain
    stays unverified whatever the reviewer says, and a rejection fails whatever is missing.
    """
    key = ["item", "requirement"]
    broken = records.withColumn("rule", F.when(~F.coalesce(F.col("status").isin(PASS, FAIL, OPEN), F.lit(False)) | F.coalesce(T.stripped("observation") == "", F.lit(True)), "status or observation")).filter("rule IS NOT NULL").select("rule", *key)
    unknown = records.join(requirements.select(*key), key, "left_anti").select(F.lit("unknown requirement").alias("rule"), *key)
    twice = records.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("reviewed twice").alias("rule"), *key)
    seen = views.join(files.select("path", F.col("sha256").alias("is")), "path", "left")
    good = F.coalesce((F.col("is") == F.col("sha256")) & F.col("scale").isin(*SCALES), F.lit(False))
    off = seen.filter(~good).select(F.when(~F.coalesce(F.col("scale").isin(*SCALES), F.lit(False)), "unknown scale").when(F.col("is").isNull(), "view missing").otherwise("view changed").alias("rule"), *key)
    scales = seen.filter(good).groupBy(*key).agg(F.collect_set("scale").alias("scales"))
    one = records.groupBy(*key).agg(F.when(F.count(F.lit(1)) == 1, F.first("status")).alias("status"))
    j = requirements.join(one, key, "left").join(scales, key, "left")
    needed = F.when(F.col("dimension") == "transparency", F.array(*map(F.lit, (*NEEDED, *CLEAR)))).otherwise(F.array(*map(F.lit, NEEDED)))
    short = F.array_sort(F.array_except(needed, F.coalesce("scales", F.array().cast("array<string>"))))
    unsure, rejected = F.col("certainty") == "uncertain", F.col("status") == FAIL
    reasons = F.array_compact(F.array(F.when(unsure, "uncertain source"), F.when(F.coalesce("status", F.lit(OPEN)) == OPEN, "no review"), F.when(F.col("status").isNotNull() & (F.size(short) > 0), F.concat(F.lit("no view: "), F.array_join(short, ", "))), F.when(rejected, "rejected")))
    review = F.when(rejected, FAIL).when((F.size(reasons) > 0) | (F.coalesce("status", F.lit("")) != PASS), OPEN).otherwise(PASS)
    return j.select(*key, review.alias("review"), reasons.alias("reasons")), broken.unionByName(unknown).unionByName(twice).unionByName(off)


def sampled_paints(pixels: DataFrame, patches: DataFrame, paints: DataFrame) -> DataFrame:
    """(paint, rule, sampled): paints (paint, kind `solid`, `linear` or `path`, stops array of struct(position, color)) against the median colours of their source patches (paint, place, image_id, x, y, w, h).

    A patch stands for the stop of its place; it must be whole and opaque, or nothing can be said.
    """
    named = patches.withColumn("patch", F.struct("paint", "place"))
    found = patch_colours(pixels, named.select("patch", "image_id", "x", "y", "w", "h"))
    hex_ = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb"))
    whole = named.join(found, "patch", "left").select("paint", "place", F.when((F.col("n") == F.col("w") * F.col("h")) & F.col("r").isNotNull(), hex_).alias("color"))
    g = whole.groupBy("paint").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "color"))), lambda s: s["color"]).alias("sampled"))
    j = paints.join(g, "paint", "left")
    said = F.transform("stops", lambda s: F.upper(s["color"]))
    ordered = F.transform("stops", lambda s: s["position"]) == F.array_sort(F.transform("stops", lambda s: s["position"]))
    rule = F.when(~F.coalesce(F.col("kind").isin("solid", "linear", "path"), F.lit(False)), "unknown kind").when(F.col("sampled").isNull(), "no patches").when((F.size("sampled") != F.size("stops")) | ((F.col("kind") == "solid") & (F.size("stops") != 1)), "patches and stops differ").when(F.exists("sampled", lambda c: c.isNull()), "patch not whole or not opaque").when(~ordered, "stops out of order").when(F.col("sampled") != said, "another colour")
    return j.select("paint", rule.alias("rule"), F.array_join("sampled", ",", "-").alias("sampled"))
