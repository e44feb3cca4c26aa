"""Evidence bound by hashes: receipts against files, application snapshots, layer bundles, and pictures read back from packages."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import angle_difference, finite, moved, same_points

INCH = 914400
# The files of a layer bundle, and those that a joint estimate adds.
LAYER_FILES = ("context_mask", "alpha", "rgba", "trimap", "occlusion_mask", "coverage_adjustment", "reconstructed_color")
JOINT_FILES = ("estimated_background", "recomposition_residual")
RENDERER, EXACT = "Microsoft PowerPoint ", "Microsoft PowerPoint 16."
SNAPSHOT = "schema_version int, status string, source_unchanged boolean, artifact_sha256 string, renderer string, slide_width_pt double, slide_height_pt double, slides array<struct<index:int,render_path:string,render_sha256:string,connectors:array<struct<name:string,shape_id:string,begin_connected:boolean,begin_shape_id:string,begin_name:string,begin_site:int,end_connected:boolean,end_shape_id:string,end_name:string,end_site:int>>,shapes:array<struct<shape_id:string,name:string,rotation:double,box_pt:array<double>,text:string>>>>"
BUNDLE = "source_sha256 string, source_bbox array<double>, plan struct<method:string,source_sha256:string,context_bbox:array<double>>, alpha_semantics string, rgb_semantics string, bundle_version int, foreground_estimation struct<kind:string,alpha_changed_pixels:long>, background_estimated boolean, outputs_sha256 map<string,string>"


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256, size) of the files under a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return d.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def bound(receipts: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule): receipts (keys, sha256) against files (keys, sha256), both ways: a missing, an extra and a changed file, and a key listed twice with different hashes."""
    r = receipts.groupBy(*keys).agg(F.collect_set("sha256").alias("said"))
    f = files.groupBy(*keys).agg(F.collect_set("sha256").alias("is"))
    j = r.join(f, keys, "full")
    rule = F.when(F.col("is").isNull(), "missing file").when(F.col("said").isNull(), "extra file").when(F.size("said") != 1, "receipts differ").when(F.col("is") != F.col("said"), "changed file")
    return j.select(*keys, rule.alias("rule")).filter("rule IS NOT NULL")


def beside(path: Column, name: Column) -> Column:
    """A file's path by its name in another one's folder; null if it would leave the folder."""
    name = F.replace(name, F.lit("\\"), F.lit("/"))
    out = name.rlike(r"^/|^[A-Za-z]+:|(^|/)\.\.(/|$)") | (T.stripped(name) == "")
    return F.when(~out, F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.regexp_replace(name, r"^(\./)+", "")))


def snapshots(docs: DataFrame) -> DataFrame:
    """(path, ...) of application snapshots (path, content as JSON): a row each, null fields where they aren't of their type."""
    return docs.select(F.col("path").cast("string").alias("path"), F.from_json("content", SNAPSHOT).alias("s")).select("path", "s.*")


def snapshot_issues(found: DataFrame, artifacts: DataFrame, slides: DataFrame, files: DataFrame) -> DataFrame:
    """(path, rule, subject) of snapshots(): of which artifact (sha256, width, height in EMU) they are, and whether renders (files: path, sha256) are those that were taken.

    slides: (sha256, slide) of the artifacts.  A snapshot without issues is bound; only then its measurements count.
    """
    eighths = F.col("renderer").startswith(EXACT)
    j = found.join(artifacts.select(F.col("sha256").alias("artifact_sha256"), "width", "height"), "artifact_sha256", "left")
    size = lambda c: F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    known = F.col("width").isNotNull()
    own = {
        "schema or artifact": F.coalesce(F.col("schema_version") != 1, F.lit(True)) | ~known, "not complete": F.coalesce((F.col("status") != "PASS") | ~F.col("source_unchanged"), F.lit(True)), "another renderer": ~F.coalesce(F.col("renderer").startswith(RENDERER), F.lit(False)),
        "slide size": ~(size("slide_width_pt") & size("slide_height_pt")), "size of another artifact": known & ~(F.coalesce(same_points(F.col("width"), F.col("slide_width_pt"), eighths), F.lit(False)) & F.coalesce(same_points(F.col("height"), F.col("slide_height_pt"), eighths), F.lit(False))), "no slides": F.coalesce(F.size("slides") < 1, F.lit(True)),
    }
    head = j.select("path", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in own.items())))).alias("rule"), F.lit("").alias("subject"))
    each = found.select("path", "artifact_sha256", F.explode("slides").alias("s")).select("path", "artifact_sha256", F.col("s.index").alias("index"), beside(F.col("path"), F.col("s.render_path")).alias("render"), F.col("s.render_sha256").alias("sha256"))
    at = F.coalesce(F.col("index").cast("string"), F.lit(""))
    wrong = each.filter(F.coalesce(F.col("index") < 1, F.lit(True))).select("path", F.lit("slide index").alias("rule"), at.alias("subject"))
    twice = each.groupBy("path", "index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("slide repeated").alias("rule"), at.alias("subject"))
    outside = each.filter("render IS NULL").select("path", F.lit("render outside the folder").alias("rule"), at.alias("subject"))
    taken = each.filter("render IS NOT NULL").join(files.select(F.col("path").alias("render"), F.col("sha256").alias("is")), "render", "left")
    changed = taken.filter("is IS NULL OR is <> coalesce(sha256, '')").select("path", F.when(F.col("is").isNull(), "render missing").otherwise("render changed").alias("rule"), at.alias("subject"))
    want = found.join(slides.select(F.col("sha256").alias("artifact_sha256"), F.col("slide").alias("index")), "artifact_sha256").select("path", "index")
    cover = want.withColumn("w", F.lit(True)).join(each.select("path", "index").distinct().join(want.select("path").distinct(), "path", "left_semi").withColumn("h", F.lit(True)), ["path", "index"], "full").filter("w IS NULL OR h IS NULL")
    return head.unionByName(wrong).unionByName(twice).unionByName(outside).unionByName(changed).unionByName(cover.select("path", F.when(F.col("h").isNull(), "slide without render").otherwise("render of no slide").alias("rule"), at.alias("subject")))


def connectors(found: DataFrame) -> DataFrame:
    """The connectors of bound snapshots, for connectors.readback(): slide, id, name, and begin_ and end_ connected, id, name and site."""
    c = found.select(F.explode("slides").alias("s")).select(F.col("s.index").alias("slide"), F.explode("s.connectors").alias("c"))
    ends = [F.col(f"c.{side}_{a}").alias(f"{side}_{b}") for side in ("begin", "end") for a, b in (("connected", "connected"), ("shape_id", "id"), ("name", "name"), ("site", "site"))]
    return c.select("slide", F.col("c.shape_id").alias("id"), F.col("c.name").alias("name"), *ends)


def bundle_issues(docs: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, rule, subject) of layer receipts (path, content as JSON) for crops (path, sha256, crop) of sources, and their PNG files (path, sha256) beside them."""
    b = docs.select(F.col("path").cast("string").alias("path"), F.from_json("content", BUNDLE).alias("b")).select("path", "b.*")
    j = b.join(sources.select("path", F.col("sha256").alias("want"), F.col("crop").alias("want_crop")), "path", "left")
    same = (F.col("source_sha256") == F.col("want")) & (F.col("plan.source_sha256") == F.col("want")) & (F.col("source_bbox") == F.col("want_crop")) & (F.col("plan.context_bbox") == F.col("want_crop"))
    joint = F.col("foreground_estimation").isNotNull()
    complete = joint & (F.col("bundle_version") == 3) & (F.col("foreground_estimation.kind") == "multilevel_joint_fb") & (F.col("foreground_estimation.alpha_changed_pixels") == 0) & F.col("background_estimated")
    own = {
        "another source or crop": ~F.coalesce(same, F.lit(False)), "another method": ~F.coalesce((F.col("plan.method") == "closed_form") & (F.col("alpha_semantics") == "continuous_estimated_coverage") & (F.col("rgb_semantics") == "estimated_straight_foreground"), F.lit(False)),
        "joint estimate and version": ~F.coalesce(complete | (~joint & F.col("bundle_version").isNull()), F.lit(False)),
    }
    head = j.select("path", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in own.items())))).alias("rule"), F.lit("").alias("subject"))
    wanted = F.when(joint, F.array(*map(F.lit, (*LAYER_FILES, *JOINT_FILES)))).otherwise(F.array(*map(F.lit, LAYER_FILES)))
    listed = F.coalesce(F.map_keys("outputs_sha256"), F.array().cast("array<string>"))
    lists = b.select("path", F.explode(F.concat(F.transform(F.array_except(wanted, listed), lambda n: F.struct(F.lit("output not listed").alias("rule"), n.alias("subject"))), F.transform(F.array_except(listed, wanted), lambda n: F.struct(F.lit("unknown output").alias("rule"), n.alias("subject"))))).alias("i")).select("path", "i.rule", "i.subject")
    out = b.select("path", F.explode("outputs_sha256").alias("name", "sha256")).withColumn("file", beside(F.col("path"), F.concat("name", F.lit(".png"))))
    off = out.join(files.select(F.col("path").alias("file"), F.col("sha256").alias("is")), "file", "left").filter("is IS NULL OR is <> sha256")
    return head.unionByName(lists).unionByName(off.select("path", F.when(F.col("is").isNull(), "output missing").otherwise("output changed").alias("rule"), F.col("name").alias("subject")))


def placed_box(matrix: Column) -> Column:
    """Array of four, in inches: the box of an object's unit square under its matrix, turned back about its centre."""
    m = [F.get(matrix, F.lit(k)) for k in range(6)]
    w, h = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    centre = moved(matrix, F.lit(0.5), F.lit(0.5))
    return F.array((centre["x"] - w / 2) / INCH, (centre["y"] - h / 2) / INCH, w / INCH, h / INCH)


def readback(instances: DataFrame, assets: DataFrame, objects: DataFrame, hashes: DataFrame, slide_size: tuple[float, float], items: DataFrame | None = None) -> DataFrame:
    """(rule, subject) of planned pictures against those of a package.

    instances: instance_id, asset_id, slide, output_name, bbox_inches, crop, rotation, placement_tolerance_inches, anchors;
    assets: asset_id, sha256, content_class; objects: slide, name, kind, matrix, crop, target (part), unsupported; hashes: part,
    sha256; slide_size in EMU; items: id, slide, output_name, required_count of native objects.  Each picture is planned once and
    each plan is one picture of the approved bytes, in its place.
    """
    pictures = objects.groupBy("slide", "name").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(f"o_{c}") for c in ("kind", "matrix", "crop", "target", "unsupported")))
    plan = instances.join(pictures, (instances["slide"] == pictures["slide"]) & (instances["output_name"] == pictures["name"]), "left").drop(pictures["slide"])
    plan = plan.join(assets.select("asset_id", F.col("sha256").alias("approved"), "content_class"), "asset_id", "left").join(hashes.select(F.col("part").alias("o_target"), F.col("sha256").alias("embedded")), "o_target", "left")
    one = F.coalesce((F.col("n") == 1) & (F.col("o_kind") == "pic"), F.lit(False))
    there = one & F.col("embedded").isNotNull()
    plain = there & F.col("o_unsupported").isNull() & F.col("o_matrix").isNotNull()
    at = placed_box(F.col("o_matrix"))
    plan = plan.withColumn("at", at)
    far = lambda a, b, by: F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > by), lambda v: F.coalesce(v, F.lit(True)))
    tolerance = F.col("placement_tolerance_inches") + 1e-6
    turn = F.degrees(F.atan2(F.get("o_matrix", F.lit(1)), F.get("o_matrix", F.lit(0))))
    corners = F.array(*(moved(F.col("o_matrix"), F.lit(x), F.lit(y)) for x in (0.0, 1.0) for y in (0.0, 1.0)))
    w, h = slide_size
    out = F.exists(corners, lambda p: (p["x"] < -1e-6 * INCH) | (p["y"] < -1e-6 * INCH) | (p["x"] > w + 1e-6 * INCH) | (p["y"] > h + 1e-6 * INCH))
    covers = F.get("at", F.lit(2)) * F.get("at", F.lit(3)) >= 0.8 * w * h / INCH**2
    rules = {
        "not one picture": ~one, "media missing": one & F.col("embedded").isNull(), "media differ": there & F.coalesce(F.col("embedded") != F.col("approved"), F.lit(True)), "not verified: form": there & F.col("o_unsupported").isNotNull(),
        "moved": plain & far(F.col("bbox_inches"), F.col("at"), tolerance), "cropped otherwise": plain & far(F.col("crop"), F.col("o_crop"), F.lit(1e-5)), "turned": plain & (F.abs(angle_difference(turn, F.col("rotation"))) > 0.001), "outside the slide": plain & out, "covers the slide": plain & covers & (F.col("content_class") != "evidence"),
    }
    found = plan.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"), F.col("instance_id").alias("subject"))
    l, t, r, b = (F.get("o_crop", F.lit(k)) for k in range(4))
    anchor = plan.filter(plain & (l + r < 1) & (t + b < 1)).select("*", l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"), F.explode("anchors").alias("a"))
    u, v = F.get("a.uv", F.lit(0)), F.get("a.uv", F.lit(1))
    p = moved(F.col("o_matrix"), (u - F.col("l")) / (1 - F.col("l") - F.col("r")), (v - F.col("t")) / (1 - F.col("t") - F.col("b")))
    off = F.hypot(p["x"] / INCH - F.get("a.expected_inches", F.lit(0)), p["y"] / INCH - F.get("a.expected_inches", F.lit(1))) > tolerance
    gone = ~(u.between(F.col("l"), 1 - F.col("r")) & v.between(F.col("t"), 1 - F.col("b")))
    anchor = anchor.select(F.array_compact(F.array(F.when(gone, "anchor cropped away"), F.when(off, "anchor moved"))).alias("rules"), F.concat_ws("/", "instance_id", F.col("a.id")).alias("subject"))
    found = found.unionByName(anchor.select(F.explode("rules").alias("rule"), "subject"))
    loose = objects.filter("kind = 'pic'").select("slide", "name").distinct().join(instances.select("slide", F.col("output_name").alias("name")), ["slide", "name"], "left_anti")
    found = found.unionByName(loose.select(F.lit("picture without a plan").alias("rule"), F.concat_ws("/", "slide", "name").alias("subject")))
    if items is not None:
        n = objects.groupBy("slide", F.col("name").alias("output_name")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "pic").alias("pic"))
        short = items.join(n, ["slide", "output_name"], "left").filter((F.coalesce("n", F.lit(0)) != F.coalesce("required_count", F.lit(1))) | F.coalesce("pic", F.lit(False)))
        found = found.unionByName(short.select(F.lit("native object missing").alias("rule"), F.col("id").alias("subject")))
    return found


def tiled(instances: DataFrame, assets: DataFrame, objects: DataFrame, slide_size: tuple[float, float], share: float = 0.8) -> DataFrame:
    """(slide, covered): slides that illustrations together cover to `share` or more, as a composition cut into tiles would."""
    from figmill.operators import intervals

    shown = instances.join(assets.filter("content_class <> 'evidence'").select("asset_id"), "asset_id", "left_semi").select("slide", F.col("output_name").alias("name"))
    box = objects.filter("kind = 'pic' AND matrix IS NOT NULL").join(shown, ["slide", "name"], "left_semi").select("slide", placed_box(F.col("matrix")).alias("b"))
    area = intervals.rectangle_union(box.select("slide", *(F.get("b", F.lit(k)).alias(c) for k, c in enumerate("xywh"))), ["slide"])
    return area.withColumn("covered", F.col("area") / (slide_size[0] * slide_size[1] / INCH**2)).filter(F.col("covered") >= share).select("slide", "covered")
