"""Audit of a slide package: what is native, what is raster, and what went wrong in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import rotated_bounds
from figmill.operators import graph, patterns

TOLERANCE, AREA = 12700, 0.8
PIECE = 256  # objects of one box and outline that are held together


def bounds(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """struct(x, y, w, h): the upright box of a turned one; of one that isn't turned, itself."""
    turned = rotated_bounds(x, y, w, h, degrees)
    return F.when(F.pmod(degrees, F.lit(360.0)) != 0, F.struct(*(turned[c].cast("double").alias(c) for c in "xywh"))).otherwise(F.struct(*(v.cast("double").alias(c) for v, c in zip((x, y, w, h), "xywh", strict=True))))


def out_of_bounds(objects: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Objects (x_emu ... rotation_deg, width, height of the slide) that reach beyond the slide by more than the tolerance; a slide without a size has none."""
    b = objects.filter("width > 0 and height > 0").withColumn("b", bounds(F.col("x_emu"), F.col("y_emu"), F.col("w_emu"), F.col("h_emu"), F.col("rotation_deg")))
    return b.filter((F.col("b.x") < -tolerance) | (F.col("b.y") < -tolerance) | (F.col("b.x") + F.col("b.w") > F.col("width") + tolerance) | (F.col("b.y") + F.col("b.h") > F.col("height") + tolerance)).drop("b")


def duplicate_borders(objects: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, a, b): pairs with one outline (width and colour) whose four box values differ by at most the tolerance, in paint order.

    Equal boxes are compared once, in pieces of at most PIECE objects: two pieces meet in a cell of the left upper corner, twice the
    tolerance wide, and one side asks in the four that it may reach; pairs are written out only from pieces that are near.
    """
    wide = 2 * tolerance + 1
    same = [*keys, "line_width", "line_color", "b"]
    d = objects.filter("line_width is not null").select(*keys, "ord", "name", "line_width", "line_color", bounds(*(F.col(c) for c in ("x_emu", "y_emu", "w_emu", "h_emu", "rotation_deg"))).alias("b"))
    d = d.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy(*same).orderBy("ord")) - 1) / PIECE))
    d = graph.cut(d.groupBy(*same, "piece").agg(F.collect_list(F.struct("ord", "name")).alias("held")))
    at = lambda c, by: F.floor((F.col(f"b.{c}") + by) / wide)
    cells = F.array_distinct(F.array(*(F.struct(at("x", i).alias("cx"), at("y", j).alias("cy")) for i in (-tolerance, tolerance) for j in (-tolerance, tolerance))))
    l = d.select(*keys, "line_width", "line_color", F.col("held").alias("aheld"), F.col("b").alias("ab"), F.inline(cells))
    r = d.withColumn("cx", at("x", 0)).withColumn("cy", at("y", 0))
    near = [F.abs(F.col(f"ab.{c}") - F.col(f"b.{c}")) <= tolerance for c in "xywh"]
    met = l.join(graph.dealt(r), [*keys, "line_width", "line_color", "cx", "cy"]).filter(near[0] & near[1] & near[2] & near[3])
    one = met.select(*keys, F.explode("aheld").alias("l"), "held")
    return one.select(*keys, "l", F.explode("held").alias("r")).filter("l.ord < r.ord").select(*keys, F.col("l.name").alias("a"), F.col("r.name").alias("b"))


def text_findings(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, subject): distinct unfilled and wrongly decoded texts, and each East Asian run without a font of its own."""
    t = T.stripped("text")
    one = lambda test, rule: runs.filter(test).select(*keys, F.lit(rule).alias("rule"), t.alias("subject")).distinct()
    fontless = runs.filter(T.has_cjk(F.col("text")) & ~F.col("east_asian")).select(*keys, F.lit("no East Asian font").alias("rule"), F.col("text").alias("subject"))
    return one(T.placeholder(F.col("text")) & (t != ""), "placeholder").unionByName(one(T.mojibake(F.col("text")), "mojibake")).unionByName(fontless)


def _holding(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted (literal, ...) with the `text` of every object (text) that holds the literal, white space apart."""
    keyed = objects.withColumn("key_", T.match_key(F.col("text")))
    pairs = patterns.containing(keyed.select(F.col("key_").alias("text")), wanted).withColumnRenamed("text", "key_")
    return wanted.join(pairs, "literal").join(keyed, "key_").drop("key_", "literal")


def inventory(items: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, observed, required, valid) of declared texts (id, text, slide, name, shape_id, required; null: any) among objects (slide, name, shape_id, text).

    The optional keys give eight kinds of items; each kind is an equi-join on the keys that it has.  Items without any
    are looked up by their text without white space, which the object's must hold.  Equal items and equal objects are compared
    once, however many there are.
    """
    keys = ("slide", "name", "shape_id")
    declared = items.filter(T.stripped("text") != "")
    wanted = declared.select(F.col("text").alias("token"), *keys).distinct()
    held = objects.groupBy("text", *keys).agg(F.count(F.lit(1)).alias("n"))
    kinds = dict(items.dtypes)
    hits = None
    for mask in range(8):
        on = [k for n, k in enumerate(keys) if mask >> n & 1]
        kind = wanted
        for n, k in enumerate(keys):
            kind = kind.filter(F.col(k).isNotNull() if mask >> n & 1 else F.col(k).isNull())
        kind = kind.select("token", *on)
        said = held.groupBy("text", *on).agg(F.sum("n").alias("n"))
        found = kind.join(graph.dealt(said), on) if on else _holding(kind.withColumn("literal", T.match_key(F.col("token"))), said)
        n = found.groupBy("token", *on).agg(F.sum(T.token_count(F.col("text"), F.col("token")) * F.col("n")).alias("observed"))
        n = n.select(F.col("token").alias("token_"), *((F.col(k) if k in on else F.lit(None).cast(kinds[k])).alias(f"{k}_") for k in keys), "observed")
        hits = n if hits is None else hits.unionByName(n)
    same = F.col("text") == F.col("token_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    hits = declared.join(graph.dealt(hits), same).groupBy("id").agg(F.sum("observed").alias("observed"))
    required = F.coalesce("required", F.lit(1))
    return declared.join(graph.dealt(hits), "id", "left").select("id", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), required.alias("required"), ((required > 0) & (F.coalesce("observed", F.lit(0)) >= required)).alias("valid"))


def classify(raster: Column, pictures: Column, native: Column) -> Column:
    """What a slide is, given whether a picture covers it and how many pictures and native objects it has."""
    return F.when(raster, "raster-dominant-risk").when((pictures > 0) & (native == 0), "raster-only").when(pictures > 0, "mixed").when(native > 0, "native-only").otherwise("empty-or-unsupported")


def large_pictures(objects: DataFrame, area: float = AREA) -> DataFrame:
    """Top-level pictures with their share of the slide (to six places), and whether it is `area` or more."""
    share = F.round(F.col("w_emu") * F.col("h_emu") / F.nullif(F.col("width") * F.col("height"), F.lit(0)), 6)
    return objects.filter("kind = 'pic' and depth = 0").withColumn("share", share).withColumn("large", F.coalesce(F.col("share") >= area, F.lit(False)))


def inherited(counts: DataFrame, relations: DataFrame) -> DataFrame:
    """(package, part, above): the layouts of slides and the masters of those layouts."""
    r = relations.filter("lower(target_mode) <> 'external'")
    layout = r.filter("target like '%slideLayout%.xml'").select("package", F.col("source_part").alias("part"), F.col("target").alias("above"))
    master = r.filter("target like '%slideMaster%.xml'").select("package", F.col("source_part").alias("above"), F.col("target").alias("top"))
    both = layout.unionByName(layout.join(master, ["package", "above"]).select("package", "part", F.col("top").alias("above")))
    return both.join(counts.select("package", "part", "kind").filter("kind = 'slide'").drop("kind"), ["package", "part"], "left_semi").distinct()


def slides(listed: DataFrame, counts: DataFrame, objects: DataFrame, relations: DataFrame, area: float = AREA) -> DataFrame:
    """(package, slide, part, counts..., classification) of every slide.

    objects have the slide size.  A slide is raster-dominant if a top-level picture covers `area` of it, or it, its
    layout or its master has a picture as background.
    """
    large = large_pictures(objects, area).groupBy("package", "part").agg(F.count_if("large").alias("full_slide"), F.max("share").alias("max_share"))
    above = inherited(counts, relations).join(counts.select("package", F.col("part").alias("above"), F.size("backgrounds").alias("n"), F.col("pictures").alias("p")), ["package", "above"])
    above = above.groupBy("package", "part").agg(F.count_if(F.col("n") > 0).alias("inherited_risks"), F.sum("p").alias("inherited_pictures"))
    j = listed.select("package", "slide", "part").join(counts, ["package", "part"]).join(large, ["package", "part"], "left").join(above, ["package", "part"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    raster = (zero("full_slide") > 0) | (F.size("backgrounds") > 0) | (zero("inherited_risks") > 0)
    return j.select("package", "slide", "part", "native", "shapes", "text_shapes", "characters", "connectors", "groups", "frames", "charts", "tables", "pictures", F.size("backgrounds").alias("backgrounds"), zero("full_slide").alias("full_slide"), F.coalesce("max_share", F.lit(0.0)).alias("max_share"), zero("inherited_risks").alias("inherited_risks"), classify(raster, F.col("pictures"), F.col("native")).alias("classification"))


# Findings that don't block.
ADVICE = ("no East Asian font",)


def totals(slide_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(package, slides, native, pictures, raster_dominant, findings, blocking): sums of slides() and of findings (package, rule, subject)."""
    s = slide_rows.groupBy("package").agg(F.count(F.lit(1)).alias("slides"), F.sum("native").alias("native"), F.sum("pictures").alias("pictures"), F.count_if(F.col("classification").isin("raster-dominant-risk", "raster-only")).alias("raster_dominant"))
    f = findings.groupBy("package").agg(F.count(F.lit(1)).alias("findings"), F.count_if(~F.col("rule").isin(*ADVICE)).alias("blocks"))
    j = s.join(f, "package", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("package", *(zero(c).alias(c) for c in ("slides", "native", "pictures", "raster_dominant", "findings")), (zero("blocks") + zero("raster_dominant")).alias("blocking"))


def audit(files: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slides, findings (package, rule, subject), totals) of packages (package, content) and declared texts."""
    from figmill.sources import package as S

    listed, relations, counts = S.slides(files), S.relationships(files), S.part_counts(files)
    objects = S.objects(files).join(listed.select("package", "part", "width", "height"), ["package", "part"])
    top = objects.filter("depth = 0")
    rule = lambda d, name, subject: d.select("package", F.lit(name).alias("rule"), subject.alias("subject"))
    found = S.integrity(S.parts(files), relations)
    found = found.unionByName(rule(out_of_bounds(top), "out of bounds", F.col("name")))
    found = found.unionByName(rule(duplicate_borders(top.filter("kind = 'sp'"), ["package", "part"]), "duplicate border", F.concat_ws("/", "a", "b")))
    found = found.unionByName(text_findings(S.runs(files), ["package", "part"]).select("package", "rule", "subject"))
    if items is not None:
        missing = inventory(items, objects).filter("not valid").select("id")
        found = found.unionByName(listed.select("package").distinct().join(F.broadcast(missing)).select("package", F.lit("missing text").alias("rule"), F.col("id").alias("subject")))
    per = slides(listed, counts, objects, relations)
    return per, found, totals(per, found)


def placements(pictures: DataFrame, images: DataFrame, min_dpi: float, min_pixels: int, max_skew: float = 0.005) -> DataFrame:
    """(id, rules) of placed pictures (id, image, matrix in inches, crop) and images (image, width, height, visible box x0, y0, x1, y1; null if nothing is visible).

    Resolution and shape are those of the cropped source on the slide; a crop must not cut off visible pixels.
    """
    j = pictures.join(images, "image", "left")
    m = [F.get("matrix", F.lit(k)) for k in range(4)]
    l, t, r, b = (F.get("crop", F.lit(k)) for k in range(4))
    wide, tall = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    w, h = F.col("width"), F.col("height")
    c0, c1, c2, c3 = F.ceil(l * w), F.ceil(t * h), F.floor((1 - r) * w), F.floor((1 - b) * h)
    fits = F.forall("crop", lambda v: (v >= 0) & (v < 1)) & (l + r < 1) & (t + b < 1)
    cut = (F.col("x0") < c0) | (F.col("y0") < c1) | (F.col("x1") > c2) | (F.col("y1") > c3)
    seen = F.least(F.least(F.col("x1"), c2) - F.greatest(F.col("x0"), c0), F.least(F.col("y1"), c3) - F.greatest(F.col("y0"), c1))
    dpi = F.least((1 - l - r) * w / F.nullif(wide, F.lit(0.0)), (1 - t - b) * h / F.nullif(tall, F.lit(0.0)))
    skew = F.abs((wide / F.nullif(tall, F.lit(0.0))) / ((1 - l - r) * w / ((1 - t - b) * h)) - 1)
    stop = F.when(w.isNull(), "no image").when(~fits, "invalid crop").when(F.col("x0").isNull() | (seen <= 0), "nothing visible").when((wide <= 0) | (tall <= 0), "no extent")
    rules = F.array_compact(F.array(F.when(cut, "crop cuts visible pixels"), F.when(dpi < min_dpi, "resolution too low"), F.when(seen < min_pixels, "too few visible pixels"), F.when(skew > max_skew, "distorted")))
    return j.select("id", F.when(stop.isNotNull(), F.array(stop)).otherwise(rules).alias("rules"))


def missing_required(texts: DataFrame, objects: DataFrame) -> DataFrame:
    """Declared texts (ord, text), each once, that no object says."""
    wanted = T.first_by_key(texts, [], "text", "ord")
    asked = wanted.select("ord", F.col("text").alias("token"), T.match_key(F.col("text")).alias("literal"))
    hit = _holding(asked, objects.select("text")).filter(T.token_count(F.col("text"), F.col("token")) > 0)
    return wanted.join(hit.select("ord").distinct(), "ord", "left_anti").select("text")


