"""Audit of curves against source traces, and traces of curves from pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.operators import graph, intervals, series
from figmill.operators import patterns as P

EDGES_A_TASK = 5000
POINTS = 201
REACH = round(0.12 * POINTS)
STEPS = 16


def bezier(points: list[tuple[Column, Column]]) -> Column:
    """Array of struct(x, y): STEPS points of a quadratic or cubic curve after its start."""
    n = len(points) - 1
    weight = {2: (1, 2, 1), 3: (1, 3, 3, 1)}[n]

    def at(k, axis):
        t = k / F.lit(float(STEPS))
        total = F.lit(0.0)
        for i, p in enumerate(points):
            total += F.lit(float(weight[i])) * F.pow(1 - t, F.lit(float(n - i))) * F.pow(t, F.lit(float(i))) * p[axis]
        return total

    return F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda k: F.struct(at(k, 0).alias("x"), at(k, 1).alias("y")))


def decode(commands: DataFrame) -> DataFrame:
    """(path, status, reason, closed, points) of path commands (path, ord, kind, points array of struct(x, y), w, h).

    One contour a path: move, then lines, quadratic and cubic curves (sampled), then close.  Points are shares
    of w and h.  Anything else is unsupported, with the reason.
    """
    w = Window.partitionBy("path").orderBy("ord")
    last = F.element_at(F.when(F.size("points") > 0, F.col("points")), -1)
    start = F.first(last, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = commands.withColumn("start", start).withColumn("pen", F.last(F.when(F.col("kind") == "close", F.col("start")).otherwise(last), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    want = F.create_map(*(F.lit(x) for kv in (("moveTo", 1), ("lnTo", 1), ("quadBezTo", 2), ("cubicBezTo", 3), ("close", 0)) for x in kv))
    bad = F.coalesce(F.size("points") != want[F.col("kind")], F.lit(True)) | ((F.col("kind") == "moveTo") & F.col("pen").isNotNull()) | ((F.col("kind") != "moveTo") & F.col("pen").isNull())
    xy = lambda s: (s["x"], s["y"])
    p = [F.get("points", F.lit(k)) for k in range(3)]
    got = F.when(F.col("kind") == "quadBezTo", bezier([xy(F.col("pen")), xy(p[0]), xy(p[1])])).when(F.col("kind") == "cubicBezTo", bezier([xy(F.col("pen")), *map(xy, p)])).when(F.col("kind") == "close", F.when(F.col("pen") != F.col("start"), F.array("start")).otherwise(F.array().cast("array<struct<x:double,y:double>>"))).otherwise(F.col("points"))
    got = F.transform(got, lambda s: F.struct((s["x"] / F.col("w")).alias("x"), (s["y"] / F.col("h")).alias("y")))
    d = c.withColumn("bad", bad).withColumn("got", F.when(~bad & (F.col("w") > 0) & (F.col("h") > 0), got))
    g = d.groupBy("path").agg(F.bool_or("bad").alias("bad"), F.bool_or(~((F.col("w") > 0) & (F.col("h") > 0))).alias("flat"), F.bool_or(F.col("kind") == "close").alias("closed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "got"))), lambda s: s["got"])).alias("points"))
    reason = F.when(F.col("flat"), "no width or height").when(F.col("bad"), "unsupported command").when(F.coalesce(F.size("points"), F.lit(0)) < 2, "fewer than two points")
    return g.select("path", F.when(reason.isNull(), "supported").otherwise("unsupported").alias("status"), reason.alias("reason"), "closed", F.when(reason.isNull(), F.col("points")).alias("points"))


def envelope(segments: DataFrame, keys: list[str], upper: bool = True, points: int = POINTS) -> DataFrame:
    """(keys, status) and y of each of `points` columns for the edges (x0, y0, x1, y1) of a filled outline, y downward.

    The upper envelope is 1 - least y, the lower one the greatest y.  More than two heights at a column, or
    a column without any, make the outline unsupported.  Edges are dealt by key before they become columns, so many to a task.
    """
    n = points - 1
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n), v.cast("int")))
    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")
    steep = F.abs(F.col("x1") - F.col("x0")) <= 1e-12
    cols = F.when(steep, F.array(clip(F.floor(lo * n)))).otherwise(F.sequence(clip(F.floor(lo * n)), clip(F.ceil(hi * n))))
    tasks = max(1, math.ceil(segments.count() / EDGES_A_TASK))
    d = segments.repartition(tasks, *keys).withColumn("i", F.explode(cols)).withColumn("f", F.when(steep, 0.0).otherwise((F.col("i") / n - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))))
    d = d.filter((F.col("f") >= -1e-9) & (F.col("f") <= 1 + 1e-9)).withColumn("y", F.when(steep, F.least("y0", "y1")).otherwise(F.col("y0") + F.col("f") * (F.col("y1") - F.col("y0"))))
    g = d.groupBy(*keys, "i").agg(F.min("y").alias("least"), F.max("y").alias("most"), F.count_distinct(F.round("y", 9)).alias("heights"))
    whole = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("heights").alias("heights"))
    status = F.when(F.col("heights") > 2, "several intervals").when(F.col("n") < points, "frame not covered").otherwise("supported")
    y = (1 - F.col("least")) if upper else F.col("most")
    return g.join(graph.dealt(whole.select(*keys, status.alias("status"))), keys).select(*keys, "i", (F.col("i") / n).alias("x"), y.alias("y"), "status")


def find_peaks(profile: DataFrame, keys: list[str], prominence: float = 0.08, distance: float = 0.06, smooth: int = 5) -> DataFrame:
    """(keys, x, prominence) of the peaks of resampled profiles (keys, i, x, y)."""
    s = series.moving_average(profile, keys, ["i"], "y", smooth)
    p = series.peaks(s.drop("y").withColumnRenamed("smooth", "y"), keys, ["i"], "y", REACH).filter(F.col("prominence") >= prominence - 1e-12)
    return series.suppress(p, keys, "x", distance)


def audit(sources: DataFrame, outputs: DataFrame, contract: DataFrame, prominence: float = 0.08, distance: float = 0.06) -> DataFrame:
    """(series, object, mae, n_peaks, rules) of output profiles (series, object, x, y) against source points (series, x, y).

    contract: series, max_mae, peak_tolerance, expected_peaks (array of x, or null for the source's own).
    Peaks are compared in order, if there are as many as expected.
    """
    a = series.resample(sources, ["series"], POINTS)
    b = series.resample(outputs, ["series", "object"], POINTS)
    mae = b.join(a.select("series", "i", F.col("y").alias("z")), ["series", "i"]).groupBy("series", "object").agg(F.avg(F.abs(F.col("y") - F.col("z"))).alias("mae"))
    own = find_peaks(a, ["series"], prominence, distance).groupBy("series").agg(F.sort_array(F.collect_list("x")).alias("own"))
    out = find_peaks(b, ["series", "object"], prominence, distance).groupBy("series", "object").agg(F.sort_array(F.collect_list("x")).alias("found"))
    none = F.array().cast("array<double>")
    j = mae.join(out, ["series", "object"], "left").join(contract, "series").join(own, "series", "left").withColumn("found", F.coalesce("found", none)).withColumn("want", F.sort_array(F.coalesce("expected_peaks", "own", none)))
    off = F.exists(F.arrays_zip(F.col("want").alias("want"), F.col("found").alias("found")), lambda s: F.abs(s["want"] - s["found"]) > F.col("peak_tolerance") + 1e-12)
    same = F.size("want") == F.size("found")
    rules = F.array_compact(F.array(F.when(F.col("mae") > F.col("max_mae") + 1e-12, "error too large"), F.when(~same, "wrong number of peaks"), F.when(same & off, "peak out of place")))
    return j.select("series", "object", "mae", F.size("found").alias("n_peaks"), rules.alias("rules"))


def assignment(paths: DataFrame, contract: DataFrame) -> DataFrame:
    """(rule, series, subject) of native paths (slide, shape, path_index, name) and contract (series, pattern, expected, path_index).

    Objects are counted before their paths are chosen; equal names aren't merged.
    """
    m = contract.join(P.matches(paths, contract), "pattern").join(paths.withColumnRenamed("path_index", "index_"), "name")
    n = m.groupBy("series", "slide", "shape").agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("index_") == F.col("path_index")).alias("chosen"), F.first("path_index").alias("path_index"))
    count = contract.join(n.groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series", "left").filter(F.coalesce("n", F.lit(0)) != F.coalesce("expected", F.lit(1)))
    who = F.concat_ws("/", "slide", "shape")
    use = m.filter("path_index is null or index_ = path_index").groupBy("slide", "shape", "index_").agg(F.count_distinct("series").alias("n"), F.min("series").alias("series"))
    return (
        count.select(F.lit("wrong number of objects").alias("rule"), "series", F.coalesce("n", F.lit(0)).cast("string").alias("subject"))
        .unionByName(n.filter("path_index is null and paths > 1").select(F.lit("several paths").alias("rule"), "series", who.alias("subject")))
        .unionByName(n.filter("path_index is not null and chosen <> 1").select(F.lit("path is missing").alias("rule"), "series", who.alias("subject")))
        .unionByName(use.filter("n > 1").select(F.lit("path of several series").alias("rule"), "series", F.concat_ws("/", "slide", "shape", "index_").alias("subject")))
    )


def column_trace(pixels: DataFrame, colours: list[tuple[int, int, int]], tolerance: float, mode: str) -> DataFrame:
    """(image_id, x, y): the curve's height in each column that has a pixel (y, x, r, g, b) within tolerance of a colour.

    mode: upper_envelope (least y), lower_envelope (greatest) or centerline (median).
    """
    square = F.least(F.lit(float("inf")), *(F.pow(F.col("r") - r, F.lit(2)) + F.pow(F.col("g") - g, F.lit(2)) + F.pow(F.col("b") - b, F.lit(2)) for r, g, b in colours))
    pick = {"upper_envelope": F.min, "lower_envelope": F.max, "centerline": F.median}[mode]
    return pixels.filter(F.sqrt(square) <= tolerance).groupBy("image_id", "x").agg(pick("y").cast("double").alias("y"))


def trace(pixels: DataFrame, sizes: DataFrame, colours: list[tuple[int, int, int]], tolerance: float = 60.0, mode: str = "upper_envelope", coverage: float = 0.90, gap: float = 0.05) -> DataFrame:
    """(image_id, status, coverage, longest, x, signal) of images of sizes (image_id, width, height); a failed one is one row without points.

    Columns without a pixel are interpolated, unless too many or too long a run of them, or an end, are missing.
    """
    seen = column_trace(pixels, colours, tolerance, mode)
    grid = sizes.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    d = grid.join(seen, ["image_id", "x"], "left")
    run = intervals.longest_missing(d.withColumn("seen", F.col("y").isNotNull()), ["image_id"], "x", "seen")
    q = d.groupBy("image_id", "width").agg((F.count("y") / F.count(F.lit(1))).alias("coverage"), F.bool_and(~F.col("x").isin(0) & (F.col("x") != F.col("width") - 1) | F.col("y").isNotNull()).alias("ends")).join(run, "image_id")
    ok = (F.col("coverage") >= coverage) & (F.col("longest") / F.col("width") <= gap) & F.col("ends")
    q = q.select("image_id", F.when(ok, "pass").otherwise("fail").alias("status"), "coverage", "longest")
    whole = series.interpolate(d, ["image_id"], "x", "y")
    base = F.col("height") - 1
    signal = {"upper_envelope": F.greatest(F.lit(0.0), base - F.col("y")) / base, "lower_envelope": F.greatest(F.lit(0.0), F.col("y") - base) / base, "centerline": 1 - F.col("y") / F.greatest(F.lit(1), base)}[mode]
    points = whole.select("image_id", (F.col("x") / F.greatest(F.lit(1), F.col("width") - 1)).alias("x"), signal.alias("signal"))
    return q.join(points.join(q.filter("status = 'pass'").select("image_id"), "image_id", "left_semi"), "image_id", "left")
