"""Colour fields of images: fills along a direction or around a centre, found for all candidates at once.

A fill is a line through a few even stops.  Between two stops a pixel has a share s, so alpha is linear in
s, colour times alpha is a square, and every sum that a least-squares fit or its error needs is one of
twenty sums of powers of s, alpha and colour over the pixels between two stops.  Spark adds these up for
every candidate (stop count and angle) in one pass, combined before the shuffle; fits are then solved from
them alone.  Directions are refined in rounds, and one last pass looks at every pixel.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.functions.numeric import linear_coordinate, radial_coordinate
from figmill.operators import graph
from figmill.operators.fits import in_box

STOPS = tuple(range(4, 17))
ROUNDS = ((10.0, 1.0), (1.0, 0.1))  # reach and step of angles around the best so far, after every 10 degrees
PLACES, CODES = 100_000, 255
TILE = 256  # side of the squares of pixels that are dealt to tasks
POWERS = np.add.outer(np.arange(3), np.arange(3))  # of s, in products of two polynomials
STOP = "array<struct<position: double, r: int, g: int, b: int, alpha: double>>"


def stop_at(k: Column, count: Column) -> Column:
    """Place of the stop k of `count` even ones between 0 and 1, to five places."""
    return F.when(count > 1, F.rint(k / (count - 1) * PLACES) / PLACES).otherwise(0.0)


def _between(d: DataFrame, t: Column) -> DataFrame:
    """d with the stop `k` at or before t and the share `s` of the way to the next; one stop alone has s = 0."""
    d = d.withColumn("t", t).withColumn("k", F.greatest(F.lit(0), F.least(F.floor(F.col("t") * (F.col("count") - 1)), F.col("count") - 2)).cast("int"))
    low, high = stop_at(F.col("k"), F.col("count")), stop_at(F.col("k") + 1, F.col("count"))
    d = d.withColumn("k", F.when((F.col("t") < low) & (F.col("k") > 0), F.col("k") - 1).when((F.col("t") >= high) & (F.col("k") < F.col("count") - 2), F.col("k") + 1).otherwise(F.col("k")))
    return d.withColumn("s", F.when(F.col("count") > 1, (F.col("t") - low) / (high - low)).otherwise(0.0))


def _place(model: Column) -> Column:
    x, y, box = F.col("x") + 0.5, F.col("y") + 0.5, [F.col(c) for c in ("bx", "by", "bw", "bh")]
    return F.when(model == "linear", linear_coordinate(x, y, *box, F.col("angle"))).when(model == "radial", radial_coordinate(x, y, *box)).otherwise(0.0)


def _observed(pixels: DataFrame, boxes: DataFrame, colour: bool = True, alpha: bool = True) -> DataFrame:
    """Pixels with their box, alpha `va` and colour times alpha; without colour or alpha, that part counts as full."""
    a = F.col("a") / 255 if alpha else F.lit(1.0)
    shade = [(F.col(c) / 255 if colour else F.lit(1.0)) * a for c in "rgb"]
    return pixels.select("image_id", "y", "x", a.alias("va"), *(v.alias(f"v{c}") for v, c in zip(shade, "rgb", strict=True))).join(graph.dealt(boxes.select("image_id", "bx", "by", "bw", "bh")), "image_id")


def _with_own(seen: DataFrame, own: DataFrame) -> DataFrame:
    """seen, a row for each entry of its image's array `c` in own (image_id, c).

    Pixels compress to so little that Spark would take them all to the driver; they are shuffled by image and tile, and a
    tile takes the array once.
    """
    pixels = seen.select("*", *(F.coalesce(F.floor(F.col(c) / TILE), F.lit(0)).alias(f"t{c}") for c in "yx"))
    at = ["image_id", "ty", "tx"]
    tiles = pixels.select(*at).distinct().join(graph.dealt(own), "image_id")
    return pixels.join(graph.dealt(tiles), at).select(*seen.columns, F.inline("c"))


def _sums(seen: DataFrame, candidates: DataFrame, model: str) -> DataFrame:
    """(image_id, count, angle, parts) of candidates (image_id, count, angle): the sums between each two stops, a row a candidate."""
    tried = candidates.groupBy("image_id").agg(F.collect_list(F.struct("count", "angle")).alias("c"))
    d = _between(_with_own(seen, tried), _place(F.lit(model)))
    s = F.col("s")
    power = lambda v, top: F.array(*(F.sum(reduce(mul, [s] * j, v)) for j in range(top + 1)))  # noqa: E731  pow() would take most of the time
    own = [power(F.lit(1.0), 4).alias("s"), power(F.col("va"), 1).alias("a"), F.sum(F.col("va") * F.col("va")).alias("aa")]
    own += [x for c in "rgb" for x in (power(F.col(f"v{c}"), 2).alias(c), F.sum(F.col(f"v{c}") * F.col(f"v{c}")).alias(2 * c))]
    per = d.groupBy("image_id", "count", "angle", "k").agg(*own)
    return per.groupBy("image_id", "count", "angle").agg(F.collect_list(F.struct("k", "s", "a", "aa", *(n for c in "rgb" for n in (c, 2 * c)))).alias("parts"))


def solved(count: int, parts: list) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(colours, alphas, mean squared error) of stops from their sums: alpha first, to five places, then colour weighted by it, to whole codes.

    Stops that no pixel is near take their neighbours' values.  None where the pixels don't determine the others.
    """
    ends = [np.array([1.0, -1.0]), np.array([0.0, 1.0])] if count > 1 else [np.array([1.0])]  # a stop's weight as a polynomial of s
    times = np.convolve  # of polynomials, lowest power first

    def system(weight, target):
        """Gram matrix and moments of the stops' weights times a polynomial a part; target(part): sums of what is fitted by powers of s."""
        gram, moment = np.zeros((count, count)), np.zeros(count)
        for p in parts:
            u = np.array([times(e, weight(p)) for e in ends])
            at, top, t = slice(p["k"], p["k"] + len(ends)), u.shape[1], np.asarray(target(p), float)[: u.shape[1]]
            moment[at] += u[:, : len(t)] @ t
            gram[at, at] += u @ np.asarray(p["s"], float)[POWERS[:top, :top]] @ u.T
        return gram, moment

    gram, moment = system(lambda p: [1.0], lambda p: p["a"])
    live = np.flatnonzero(np.diag(gram) > 1e-20)
    if not len(live) or np.linalg.matrix_rank(gram[np.ix_(live, live)], hermitian=True) < len(live):
        return None

    def fit(gram, moment):
        v, rest = in_box(gram[np.ix_(live, live)], moment[live])
        return v if rest else None

    wide = lambda v: np.interp(np.arange(count), live, v)
    alpha = fit(gram, moment)
    if alpha is None:
        return None
    alpha = wide(np.rint(alpha * PLACES) / PLACES)
    line = lambda v, p: np.array([v[p["k"]], v[p["k"] + 1] - v[p["k"]]]) if count > 1 else v[:1]
    square = lambda f, p: times(f, f) @ np.asarray(p["s"], float)[: 2 * len(f) - 1]
    error = sum(square(line(alpha, p), p) - 2 * (line(alpha, p) @ np.asarray(p["a"])[: len(ends)]) + p["aa"] for p in parts)
    colours = []
    for c in "rgb":
        own = fit(*system(lambda p: line(alpha, p), lambda p, c=c: p[c]))
        if own is None:
            return None
        colours.append(wide(np.rint(own * CODES) / CODES))
        for p in parts:
            shade = times(line(colours[-1], p), line(alpha, p))
            error += square(shade, p) - 2 * (shade @ np.asarray(p[c])[: len(shade)]) + p[2 * c]
    return np.column_stack(colours), alpha, float(error) / (4 * sum(p["s"][0] for p in parts))


def _fits(sums: DataFrame) -> DataFrame:
    """(image_id, count, angle, cost, r, g, b, alpha): the solved candidates; those that can't be are left out."""

    def solve(batches):
        for d in batches:
            rows = []
            for i, count, angle, parts in zip(d["image_id"], d["count"], d["angle"], d["parts"], strict=True):
                if (found := solved(count, list(parts))) is not None:
                    colour, alpha, cost = found
                    rows.append((i, count, angle, cost, *colour.T.tolist(), alpha.tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "count", "angle", "cost", *"rgb", "alpha"])

    kind = dict(sums.dtypes)["image_id"]
    return sums.mapInPandas(solve, f"image_id {kind}, count int, angle double, cost double, r array<double>, g array<double>, b array<double>, alpha array<double>")


def _slopes(seen: DataFrame) -> DataFrame:
    """(image_id, angle): the direction in which alpha and colour change most, by the slopes of a plane through each."""
    x, y, names = F.col("x") - F.col("bx"), F.col("y") - F.col("by"), ["va", "vr", "vg", "vb"]
    cov = seen.groupBy("image_id").agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), *(F.covar_pop(x, n).alias(f"x{n}") for n in names), *(F.covar_pop(y, n).alias(f"y{n}") for n in names))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    gx = [(F.col("yy") * F.col(f"x{n}") - F.col("xy") * F.col(f"y{n}")) / det for n in names]
    gy = [(F.col("xx") * F.col(f"y{n}") - F.col("xy") * F.col(f"x{n}")) / det for n in names]
    total = lambda u, v: sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0))
    # the main axis of the slopes' 2 by 2 moments
    return cov.select("image_id", F.round(F.pmod(F.degrees(F.atan2(2 * total(gx, gy), total(gx, gx) - total(gy, gy)) / 2), F.lit(180.0)), 6).alias("angle")).filter("angle IS NOT NULL")


def _best(seen: DataFrame, model: str, counts) -> DataFrame:
    """The fit of least error for each image and stop count."""
    number = F.explode(F.array(*map(F.lit, (1,) if model == "solid" else counts))).alias("count")
    images = seen.select("image_id").distinct()
    if model != "linear":
        return graph.cut(_fits(_sums(seen, images.select("image_id", number, F.lit(0.0).alias("angle")), model)))
    tens = images.select("image_id", F.explode(F.array(*(F.lit(10.0 * k) for k in range(18)))).alias("angle"))
    angles = tens.unionByName(_slopes(seen)).distinct()
    tried = angles.select("image_id", number, "angle")
    for reach, step in [*ROUNDS, (0, 0)]:
        found = _fits(_sums(seen, tried, model))
        best = graph.cut(found.groupBy("image_id", "count").agg(F.min(F.struct("cost", "angle", *"rgb", "alpha")).alias("m")).select("image_id", "count", "m.*"))
        if step:
            n = round(reach / step)
            near = F.array(*(F.round(F.pmod(F.col("angle") + k * step, F.lit(180.0)), 6) for k in range(-n, n + 1)))
            tried = best.select("image_id", "count", F.explode(F.array_distinct(near)).alias("angle"))
    return best


def _painted(seen: DataFrame, fits: DataFrame, model: str) -> DataFrame:
    """seen, a row for each fit of the image, with the fit's `fa` and `fr`, `fg`, `fb` (not times alpha) at the pixel."""
    own = fits.groupBy("image_id").agg(F.collect_list(F.struct("count", "angle", *(F.col(c).alias(f"{c}_") for c in (*"rgb", "alpha")))).alias("c"))
    d = _between(_with_own(seen, own), _place(F.lit(model)))
    at = lambda c: F.get(c, F.col("k")) + F.coalesce(F.get(c, F.col("k") + 1) - F.get(c, F.col("k")), F.lit(0.0)) * F.col("s")
    return d.select(*seen.columns, "count", at("alpha_").alias("fa"), *(at(f"{c}_").alias(f"f{c}") for c in "rgb"))


def _error(alpha: Column, shade: list[Column]) -> Column:
    return F.greatest(F.abs(alpha - F.col("va")), *(F.abs(s * alpha - F.col(f"v{c}")) for s, c in zip(shade, "rgb", strict=True)))


def _stops(count: Column, colour: list[Column], alpha: Column) -> Column:
    code = lambda c, k: F.rint(F.get(c, k) * CODES).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(stop_at(k, count).alias("position"), *(code(c, k).alias(n) for c, n in zip(colour, "rgb", strict=True)), F.get(alpha, k).alias("alpha")))


def field(pixels: DataFrame, boxes: DataFrame, model: str, counts=STOPS, max_error: float = 0.02) -> DataFrame:
    """(image_id, model, count, angle, error, fits, stops) of each image's pixels (image_id, y, x, r, g, b, a; centres at half) and box (image_id, bx, by, bw, bh).

    model: linear, radial or solid.  error is the greatest of a pixel, in alpha and in colour times alpha; the fewest stops
    that keep to max_error are taken, else the ones of least error.  An image that no count fits has nulls.
    """
    seen = graph.cut(_observed(pixels, boxes))
    best = _best(seen, model, counts)
    off = _painted(seen, best, model).groupBy("image_id", "count").agg(F.max(_error(F.col("fa"), [F.col(f"f{c}") for c in "rgb"])).alias("error"))
    order = F.struct(F.when(F.col("error") <= max_error, F.col("count")).otherwise(1 << 30).alias("n"), F.when(F.col("error") > max_error, F.col("error")).otherwise(0.0).alias("e"), "count", "angle", "error", *"rgb", "alpha")
    top = best.join(graph.dealt(off), ["image_id", "count"]).groupBy("image_id").agg(F.min(order).alias("m")).select("image_id", "m.*")
    j = seen.select("image_id").distinct().join(graph.dealt(top), "image_id", "left")
    return j.select("image_id", F.lit(model).alias("model"), "count", "angle", "error", F.coalesce(F.col("error") <= max_error, F.lit(False)).alias("fits"), _stops(F.col("count"), [F.col(c) for c in "rgb"], F.col("alpha")).cast(STOP).alias("stops"))


def independent(pixels: DataFrame, boxes: DataFrame, colour_model: str, alpha_model: str, counts=STOPS, max_error: float = 0.02) -> DataFrame:
    """(image_id, colour_count, alpha_count, error) of images whose colour and alpha follow fills of their own: the pair of least sum, then of fewest colour stops, that keeps to max_error; nulls if none does.

    Each profile is fitted once, and one pass looks at every pixel under every pair.
    """
    both = graph.cut(_observed(pixels, boxes))
    plain = lambda d: d.select("image_id", "y", "x", *(c for c in d.columns if c.startswith(("v", "b"))))
    shade, cover = _observed(pixels, boxes, alpha=False), _observed(pixels, boxes, colour=False)
    colour, alpha = (_best(graph.cut(plain(d)), m, counts) for d, m in ((shade, colour_model), (cover, alpha_model)))
    painted = _painted(both, colour, colour_model).withColumnRenamed("count", "colour_count").withColumnsRenamed({f"f{c}": f"c{c}" for c in "rgb"}).drop("fa")
    pair = _painted(painted, alpha, alpha_model).withColumnRenamed("count", "alpha_count")
    off = pair.groupBy("image_id", "colour_count", "alpha_count").agg(F.max(_error(F.col("fa"), [F.col(f"c{c}") for c in "rgb"])).alias("error"))
    top = off.filter(F.col("error") <= max_error).groupBy("image_id").agg(F.min(F.struct((F.col("colour_count") + F.col("alpha_count")).alias("n"), "colour_count", "alpha_count", "error")).alias("m"))
    return both.select("image_id").distinct().join(graph.dealt(top), "image_id", "left").select("image_id", "m.colour_count", "m.alpha_count", "m.error")
