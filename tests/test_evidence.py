"""Evidence bound by hashes: each loss, surplus and change gives its rule."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from figmill.plans import connectors, evidence

sha = lambda b: hashlib.sha256(b).hexdigest()


def test_bound(spark, tmp_path):
    for name, data in {"same": b"1", "changed": b"2", "extra": b"3"}.items():
        (tmp_path / name).write_bytes(data)
    files = evidence.file_hashes(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    said = spark.createDataFrame([("same", sha(b"1")), ("same", sha(b"1")), ("changed", sha(b"x")), ("missing", sha(b"4")), ("twice", "a"), ("twice", "b")], "name string, sha256 string")
    got = {(r.name, r.rule) for r in evidence.bound(said, files.unionByName(spark.createDataFrame([("twice", "a")], "name string, sha256 string")), ["name"]).collect()}
    assert got == {("changed", "changed file"), ("missing", "missing file"), ("extra", "extra file"), ("twice", "receipts differ")}


def snapshot(**other):
    slide = lambda n, **o: {"index": n, "render_path": f"slide-{n}.png", "render_sha256": sha(b"%d" % n), "connectors": [{"name": "c", "shape_id": "5", "begin_connected": True, "begin_shape_id": "2", "begin_name": "A", "begin_site": 4, "end_connected": False}], **o}
    return {"schema_version": 1, "status": "PASS", "source_unchanged": True, "artifact_sha256": "deck", "renderer": "Microsoft PowerPoint 16.0", "slide_width_pt": 720.0, "slide_height_pt": 360.0, "slides": [slide(1), slide(2)]} | other


def test_snapshots(spark):
    one = snapshot()["slides"]
    cases = {
        "good": ({}, set()), "old": ({"schema_version": 2}, {"schema or artifact"}), "status": ({"status": "FAIL"}, {"not complete"}), "touched": ({"source_unchanged": False}, {"not complete"}), "renderer": ({"renderer": "Other 1"}, {"another renderer"}), "size": ({"slide_width_pt": -1.0}, {"slide size", "size of another artifact"}),
        "other size": ({"slide_width_pt": 700.0}, {"size of another artifact"}), "other deck": ({"artifact_sha256": "x"}, {"schema or artifact"}), "none": ({"slides": []}, {"no slides", "slide without render"}), "twice": ({"slides": [one[0], one[0], one[1]]}, {"slide repeated"}), "short": ({"slides": one[:1]}, {"slide without render"}), "more": ({"slides": [*one, one[0] | {"index": 3}]}, {"render of no slide"}),
        "zero": ({"slides": [*one, one[0] | {"index": 0}]}, {"slide index", "render of no slide"}), "away": ({"slides": [one[0] | {"render_path": "../slide-1.png"}, one[1]]}, {"render outside the folder"}), "lost": ({"slides": [one[0] | {"render_path": "nope.png"}, one[1]]}, {"render missing"}), "changed": ({"slides": [one[0] | {"render_sha256": "0"}, one[1]]}, {"render changed"}),
    }
    docs = spark.createDataFrame([(f"/e/{k}.json", json.dumps(snapshot(**c))) for k, (c, _) in cases.items()] + [("/e/broken.json", "{")], "path string, content string")
    artifacts = spark.createDataFrame([("deck", 9144000, 4572000)], "sha256 string, width long, height long")
    slides = spark.createDataFrame([("deck", 1), ("deck", 2)], "sha256 string, slide int")
    files = spark.createDataFrame([(f"/e/slide-{n}.png", sha(b"%d" % n)) for n in (1, 2)], "path string, sha256 string")
    found = evidence.snapshots(docs)
    got = {}
    for r in evidence.snapshot_issues(found, artifacts, slides, files).collect():
        got.setdefault(r.path[3:-5], set()).add(r.rule)
    assert {k: got.get(k, set()) for k in cases} == {k: rules for k, (_, rules) in cases.items()}
    assert {"schema or artifact", "not complete", "no slides"} <= got["broken"]
    package = spark.createDataFrame([(1, "5", "c", "2", "A", "3", None, None, None), (2, "5", "c", "2", "A", "1", None, None, None)], "slide int, id string, name string, source_id string, source_name string, source_port string, target_id string, target_name string, target_port string")
    read = evidence.connectors(found.filter("path = '/e/good.json'"))
    assert [(r.slide, r.side, r.rule) for r in connectors.readback(package, read).collect()] == [(2, "source", "site")]


def bundle(joint=False, **other):
    names = [*evidence.LAYER_FILES, *(evidence.JOINT_FILES if joint else ())]
    out = {"source_sha256": "s", "source_bbox": [1, 2, 3, 4], "plan": {"method": "closed_form", "source_sha256": "s", "context_bbox": [1, 2, 3, 4]}, "alpha_semantics": "continuous_estimated_coverage", "rgb_semantics": "estimated_straight_foreground", "outputs_sha256": {n: sha(n.encode()) for n in names}}
    return out | ({"bundle_version": 3, "background_estimated": True, "foreground_estimation": {"kind": "multilevel_joint_fb", "alpha_changed_pixels": 0}} if joint else {}) | other


def test_layer_bundles(spark):
    outputs = bundle()["outputs_sha256"]
    cases = {
        "plain": (bundle(), set()), "joint": (bundle(True), set()), "source": (bundle(source_sha256="t"), {"another source or crop"}), "crop": (bundle(source_bbox=[0, 0, 3, 4]), {"another source or crop"}), "method": (bundle(rgb_semantics="x"), {"another method"}), "version": (bundle(bundle_version=2), {"joint estimate and version"}), "half": (bundle(True, bundle_version=2), {"joint estimate and version"}),
        "short": (bundle(outputs_sha256={k: v for k, v in outputs.items() if k != "rgba"}), {"output not listed"}), "more": (bundle(outputs_sha256=outputs | {"estimated_background": sha(b"estimated_background")}), {"unknown output"}), "changed": (bundle(outputs_sha256=outputs | {"alpha": "0"}), {"output changed"}),
    }
    docs = spark.createDataFrame([(f"/b/{k}.json", json.dumps(v)) for k, (v, _) in cases.items()], "path string, content string")
    sources = docs.select("path", F.lit("s").alias("sha256"), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))).alias("crop"))
    files = spark.createDataFrame([(f"/b/{n}.png", sha(n.encode())) for n in (*evidence.LAYER_FILES, *evidence.JOINT_FILES)], "path string, sha256 string")
    got = {}
    for r in evidence.bundle_issues(docs, sources, files).collect():
        got.setdefault(r.path[3:-5], set()).add(r.rule)
    assert {k: got.get(k, set()) for k in cases} == {k: rules for k, (_, rules) in cases.items()}
    assert {r.rule for r in evidence.bundle_issues(docs.limit(1), sources, files.filter("path <> '/b/rgba.png'")).collect()} == {"output missing"}


INCH = evidence.INCH


def test_readback(spark):
    turned = [0.0, 2.0 * INCH, -1.0 * INCH, 0.0, 4.0 * INCH, 1.0 * INCH]  # 2 by 1 inches, a quarter turn
    upright = lambda x, y, w, h: [float(v) for v in (w * INCH, 0, 0, h * INCH, x * INCH, y * INCH)]
    o = "slide int, name string, kind string, matrix array<double>, crop array<double>, target string, unsupported string"
    none = [0.0] * 4
    objects = spark.createDataFrame([(1, "ok", "pic", upright(1, 1, 2, 1), [0.0, 0.0, 0.5, 0.0], "a.png", None), (1, "turned", "pic", turned, none, "a.png", None), (1, "moved", "pic", upright(2, 1, 2, 1), none, "a.png", None), (1, "media", "pic", upright(1, 1, 2, 1), none, "b.png", None), (1, "lost", "pic", upright(1, 1, 2, 1), none, "c.png", None), (1, "shape", "sp", upright(1, 1, 2, 1), none, None, None), (1, "twice", "pic", upright(1, 1, 2, 1), none, "a.png", None), (1, "twice", "pic", upright(1, 1, 2, 1), none, "a.png", None), (1, "skew", "pic", None, none, "a.png", "not orthogonal"), (1, "loose", "pic", upright(1, 1, 2, 1), none, "a.png", None), (2, "big", "pic", upright(0, 0, 10, 5), none, "a.png", None), (2, "out", "pic", upright(9.5, 0, 2, 1), none, "a.png", None), (2, "native", "sp", upright(0, 0, 1, 1), none, None, None)], o)
    i = "instance_id string, asset_id string, slide int, output_name string, bbox_inches array<double>, crop array<double>, rotation double, placement_tolerance_inches double, anchors array<struct<id: string, uv: array<double>, expected_inches: array<double>>>"
    plan = lambda n, slide=1, box=(1.0, 1.0, 2.0, 1.0), crop=none, turn=0.0, anchors=(): (n, "A", slide, n, list(box), list(crop), turn, 0.01, [{"id": k, "uv": list(uv), "expected_inches": list(at)} for k, uv, at in anchors])
    instances = spark.createDataFrame([plan("ok", crop=(0.0, 0.0, 0.5, 0.0), anchors=[("in", (0.25, 0.5), (2.0, 1.5)), ("gone", (0.75, 0.5), (4.0, 1.5)), ("off", (0.0, 0.0), (0.0, 0.0))]), plan("turned", box=(2.5, 1.5, 2.0, 1.0), turn=90.0), plan("moved"), plan("media"), plan("lost"), plan("shape"), plan("twice"), plan("skew"), plan("absent"), plan("big", 2, (0.0, 0.0, 10.0, 5.0)), plan("out", 2, (9.5, 0.0, 2.0, 1.0), turn=45.0, crop=(0.1, 0.0, 0.0, 0.0))], i)
    assets = spark.createDataFrame([("A", "right", "illustration")], "asset_id string, sha256 string, content_class string")
    hashes = spark.createDataFrame([("a.png", "right"), ("b.png", "wrong")], "part string, sha256 string")
    items = spark.createDataFrame([("n", 2, "native", 1), ("m", 2, "nowhere", 1), ("p", 2, "big", 1)], "id string, slide int, output_name string, required_count int")
    size = (10.0 * INCH, 5.0 * INCH)
    got = {(r.rule, r.subject) for r in evidence.readback(instances, assets, objects, hashes, size, items).collect()}
    assert got == {
        ("anchor cropped away", "ok/gone"), ("anchor moved", "ok/off"), ("moved", "moved"), ("media differ", "media"), ("media missing", "lost"), ("not one picture", "shape"), ("not one picture", "twice"), ("not one picture", "absent"), ("not verified: form", "skew"), ("picture without a plan", "1/loose"),
        ("covers the slide", "big"), ("outside the slide", "out"), ("turned", "out"), ("cropped otherwise", "out"), ("native object missing", "m"), ("native object missing", "p"),
    }
    tiles = evidence.tiled(instances, assets, objects, size).collect()
    assert [(r.slide, round(r.covered, 6)) for r in tiles] == [(2, round((50 + 1.5) / 50, 6))] and math.isfinite(tiles[0].covered)


def test_paths_beside(spark):
    d = spark.createDataFrame([("a.png",), ("./a.png",), ("sub/a.png",), ("../a.png",), ("/a.png",), ("c:\\a.png",), ("sub\\..\\..\\a",), ("",)], "n string")
    assert [r.p for r in d.select(evidence.beside(F.lit("/e/x.json"), F.col("n")).alias("p")).collect()] == ["/e/a.png", "/e/a.png", "/e/sub/a.png", None, None, None, None, None]


@pytest.mark.parametrize("path", ["x.json", "dir/x.json"])
def test_relative_documents(spark, path):
    assert spark.range(1).select(evidence.beside(F.lit(path), F.lit("a")).alias("p")).first().p == path.replace("x.json", "a")


def test_part_names(spark):
    from figmill.sources import package

    cases = [("ppt/slides/a.xml", "../media/b.png", "ppt/media/b.png"), ("ppt/slides/a.xml", "/ppt/./x/../y.xml", "ppt/y.xml"), ("a.xml", "b//c.xml", "b/c.xml"), ("a.xml", "../../b", "../../b"), ("", "ppt/a.xml", "ppt/a.xml"), ("p/a.xml", "/../b", "b")]
    d = spark.createDataFrame(cases, "source string, target string, want string")
    assert [r.got for r in d.select(package.resolved(F.col("source"), F.col("target")).alias("got")).collect()] == [w for _, _, w in cases]
