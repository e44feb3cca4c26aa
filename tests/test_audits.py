"""Audits on small inputs whose results are known."""

import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.functions import numeric
from figmill.operators import fields, fits, flood, histogram, series
from figmill.plans import connectors, curves, documents, editability, grammar, images, manifest, structure, texts
from figmill.sources import layout, package, vectors

ELEMENT = "name string, geometry string, bbox array<double>, endpoints array<array<double>>, source_name string, target_name string"


def test_grammar_evidence(spark):
    box = lambda name, x: (name, "rect", [x, 0.0, 4.0, 2.0], None, None, None)
    leg = lambda name, ends: (name, "line", None, ends, None, None)
    rows = [box("a", 0.0), box("b", 10.0), box("twice", 0.0), box("twice", 0.0), ("round", "ellipse", [0.0, 0.0, 1.0, 1.0], None, None, None)]
    rows += [leg("r1", [[4.0, 1.0], [7.0, 1.0]]), leg("r2", [[7.0, 1.0], [10.0, 1.0]]), leg("s1", [[4.0, 1.0], [7.0, 1.0]]), leg("s2", [[7.5, 1.0], [10.0, 1.0]]), leg("t1", None), leg("m1", [[4.5, 1.0], [10.0, 1.0]])]
    rows += [("n1", "line", None, None, "a", "b"), ("w1", "line", None, None, "b", "a")]
    roles = [("ok", "^r", "a", "b", ["r1", "r2"]), ("gap", "^s", "a", "b", ["s1", "s2"]), ("bound", "^n", "a", "b", None), ("swapped", "^w", "a", "b", None), ("blind", "^t", "a", "b", ["t1"]), ("miss", "^m", "a", "b", ["m1"]), ("lost", "^r", "a", "nobody", ["r1", "r2"]), ("ambiguous", "^r", "twice", "b", ["r1", "r2"]), ("unsaid", "^r", None, None, None), ("partly", "^r", "a", "b", ["r1"]), ("oval", "^r", "round", "b", ["r1", "r2"])]
    got = {r.edge: r.state for r in grammar.evidence(spark.createDataFrame(rows, ELEMENT), spark.createDataFrame(roles, "edge string, pattern string, source string, target string, ordered array<string>")).collect()}
    assert got == {"ok": "PASS", "gap": "FAIL", "bound": "PASS", "swapped": "FAIL", "blind": "NOT_VERIFIED", "miss": "FAIL", "lost": "FAIL", "ambiguous": "FAIL", "unsaid": "NOT_VERIFIED", "partly": "FAIL", "oval": "NOT_VERIFIED"}
    outputs = spark.createDataFrame([("n", "a", ["rect"]), ("n", "round", ["rect"]), ("n", "no", ["rect"]), ("n", "twice", ["rect"])], "role string, name string, allowed array<string>")
    issues = {(r.rule, r.subject) for r in grammar.nodes(spark.createDataFrame(rows, ELEMENT), outputs).collect()}
    assert issues == {("geometry not allowed", "n/round"), ("missing object", "n/no"), ("object is not unique", "n/twice")}


def smooth(anchors):
    xs, ys = zip(*anchors)
    return [(i / 200, float(np.interp(i / 200, xs, ys))) for i in range(201)]


TWO = [(0, 0), (0.18, 0.12), (0.32, 1), (0.5, 0.18), (0.7, 0.9), (0.84, 0.15), (1, 0)]
ONE = [(0, 0), (0.3, 0.18), (0.55, 1), (0.78, 0.2), (1, 0)]


def test_curves(spark):
    source = spark.createDataFrame([("s", *p) for p in smooth(TWO)], "series string, x double, y double")
    outputs = spark.createDataFrame([("s", "same", *p) for p in smooth(TWO)] + [("s", "one", *p) for p in smooth(ONE)], "series string, object string, x double, y double")
    contract = spark.createDataFrame([("s", 0.08, 0.06, None)], "series string, max_mae double, peak_tolerance double, expected_peaks array<double>")
    got = {r.object: (r.n_peaks, r.rules) for r in curves.audit(source, outputs, contract).collect()}
    assert got["same"] == (2, []) and got["one"] == (1, ["error too large", "wrong number of peaks"])
    moved = spark.createDataFrame([("s", 0.5, 0.06, [0.32, 0.8])], contract.schema)
    assert {r.object: r.rules for r in curves.audit(source, outputs, moved).collect()}["same"] == ["peak out of place"]
    commands = [("p", 0, "moveTo", [(0.0, 0.0)], 10.0, 10.0), ("p", 1, "lnTo", [(10.0, 0.0)], 10.0, 10.0), ("p", 2, "quadBezTo", [(10.0, 10.0), (0.0, 10.0)], 10.0, 10.0), ("p", 3, "close", [], 10.0, 10.0), ("q", 0, "lnTo", [(0.0, 0.0)], 1.0, 1.0), ("z", 0, "moveTo", [(0.0, 0.0)], 0.0, 1.0)]
    decoded = {r.path: r for r in curves.decode(spark.createDataFrame(commands, "path string, ord int, kind string, points array<struct<x:double,y:double>>, w double, h double")).collect()}
    p = [(q.x, q.y) for q in decoded["p"].points]
    assert decoded["p"].closed and p[0] == (0, 0) and p[1] == (1, 0) and p[-2] == pytest.approx((0, 1)) and p[-1] == (0, 0) and len(p) == 19 and p[9] == pytest.approx((0.75, 0.75))
    assert (decoded["q"].status, decoded["q"].reason, decoded["z"].reason) == ("unsupported", "unsupported command", "no width or height")
    paths = spark.createDataFrame([("1", "5", 0, "curve a"), ("1", "6", 0, "curve a"), ("1", "6", 1, "curve a")], "slide string, shape string, path_index int, name string")
    wrong = curves.assignment(paths, spark.createDataFrame([("x", "^curve", 2, None), ("y", "^curve", 1, 0)], "series string, pattern string, expected int, path_index int"))
    assert {(r.rule, r.series, r.subject) for r in wrong.collect()} == {("several paths", "x", "1/6"), ("wrong number of objects", "y", "2"), ("path of several series", "x", "1/5/0"), ("path of several series", "x", "1/6/0")}


def test_curve_trace(spark):
    size = spark.createDataFrame([("i", 40, 20), ("gap", 40, 20)], "image_id string, width int, height int")
    px = [("i", 10 + x % 5, x, 255, 0, 0) for x in range(40)] + [("gap", 5, x, 255, 0, 0) for x in range(40) if not 10 <= x < 20] + [("i", 3, 7, 0, 0, 255)]
    pixels = spark.createDataFrame(px, "image_id string, y int, x int, r int, g int, b int")
    got = curves.trace(pixels, size, [(255, 0, 0)]).collect()
    assert [(r.status, r.longest, r.signal) for r in got if r.image_id == "gap"] == [("fail", 10, None)]
    line = sorted((r.x, r.signal) for r in got if r.image_id == "i")
    assert len(line) == 40 and line[3] == pytest.approx((3 / 39, (19 - 13) / 19))


def test_connectors(spark):
    kind = "slide int, id string, name string, source_id string, source_port string, target_id string, target_port string, start_arrow string, end_arrow string, x int, y int, w int, h int, flip_h boolean, flip_v boolean, plain boolean"
    rows = [(1, "10", "good", "1", "3", "2", "1", "none", "triangle", 100, 50, 100, 0, False, False, True), (1, "11", "off", "1", "3", "2", "1", "none", "none", 100, 9000000, 100, 0, False, False, True), (1, "12", "gone", "9", "0", None, None, "none", "none", 0, 0, 0, 0, False, False, False), (1, "13", "off", None, None, "2", "0", "none", "none", 0, 0, 0, 0, False, False, False)]
    shapes = spark.createDataFrame([(1, "1", "A", 0, 0, 100, 100, True), (1, "2", "B", 200, 0, 100, 100, True)], "slide int, id string, name string, x int, y int, w int, h int, plain boolean")
    want = spark.createDataFrame([(1, "good", "A", "A", None, "triangle"), (1, "never", "A", "B", None, None)], "slide int, name string, source string, target string, start_arrow string, end_arrow string")
    got = {(r.rule, r.name, r.detail) for r in connectors.audit(spark.createDataFrame(rows, kind), shapes, want, require_bound=True).collect()}
    assert got == {("duplicate connector name", "off", "2"), ("end off its port", "off", "source"), ("end off its port", "off", "target"), ("dangling end", "gone", "source:9"), ("unbound end", "gone", "target"), ("unbound end", "off", "source"), ("connection differs", "good", "target:B"), ("missing connector", "never", "never")}
    p = spark.createDataFrame([(1, "10", "c", "1", "A", "3", None, None, None)], "slide int, id string, name string, source_id string, source_name string, source_port string, target_id string, target_name string, target_port string")
    for values, rule in (((True, "1", "A", 4, False), None), ((True, "1", "A", 3, False), "site"), ((True, "2", "A", 4, False), "endpoint"), ((False, None, None, None, False), "binding")):
        app = spark.createDataFrame([(1, "10", "c", *values, None, None, None)], "slide int, id string, name string, begin_connected boolean, begin_id string, begin_name string, begin_site int, end_connected boolean, end_id string, end_name string, end_site int")
        assert [r.rule for r in connectors.readback(p, app).collect()] == ([rule] if rule else [])
    s = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    e = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = spark.range(1).select(*(connectors.link_issue(s, e(x, y), F.lit(a), F.lit(b)).alias(f"c{k}") for k, (x, y, a, b) in enumerate([(5.0, 0.0, "right", "left"), (5.0, 1.0, "right", "left"), (5.0, 0.0, "left", "left"), (1.0, 0.0, "right", "left")]))).first()
    assert list(r) == [None, "not aligned", "runs through a box", "no length"]


def drawn(drop=(), add=()):
    on = {(y, x) for y in range(10, 43) for x in range(10, 46)} - {(y, x) for y in range(20, 30) for x in range(20, 29)} | {(y, x) for y in range(40, 56) for x in range(34, 36)}
    return sorted(on - set(drop) | set(add))


def test_structure(spark):
    mask = lambda cells: spark.createDataFrame([("i", y, x) for y, x in cells], "image_id string, y int, x int")
    a = mask(drawn())
    same = structure.compare(a, a, 60, 60, 0.99, 0.5, 0.5).first()
    assert same.passed and same.iou == 1 and same.boundary_max == 0 and (same.a_parts, same.a_holes) == (1, 1)
    filled = structure.compare(a, mask(drawn(add=[(y, x) for y in range(20, 30) for x in range(20, 29)])), 60, 60, 0.5, 50, 50).first()
    assert not filled.passed and not filled.topology_equal
    events = structure.coverage_changes(a, mask(drawn(add=[(y, x) for y in range(20, 30) for x in range(20, 29)], drop=[(12, 12)])), 60, 60).collect()
    assert {(r.event, r.area, r.changed) for r in events} == {("introduced hole", 1, 1), ("filled hole", 90, 90)}
    box = structure.differing_boxes(a, mask(drawn(drop=[(12, 12), (13, 14)], add=[(0, 5)]))).first()
    assert tuple(box.missing_box) == (12, 12, 15, 14) and tuple(box.extra_box) == (5, 0, 6, 1)
    rnd = random.Random(7)
    p, q = ({(y, x) for y in range(12) for x in range(12) if rnd.random() < 0.3} for _ in range(2))
    near = {(r.y, r.x): r.distance for r in structure.nearest(mask(p), mask(q), cell=2).collect()}
    assert near == {c: min(math.dist(c, d) for d in q) for c in p}
    points = lambda *rows: spark.createDataFrame(rows, "image_id string, y int, x int")
    far = structure.nearest(points(("i", 0, 0), ("i", -3, 7), ("i", None, 1), ("other", 1, 1)), points(("i", 90000, 120000), ("i", 2, None)), cell=40000).collect()
    assert {(r.image_id, r.y, r.x): r.distance for r in far} == {("i", 0, 0): 150000.0, ("i", -3, 7): math.dist((-3, 7), (90000, 120000))}
    shifted = structure.distances(a, mask([(y, x + 4) for y, x in drawn()])).first()
    assert shifted.boundary_max == 4 and shifted.boundary_p95 <= 4
    seeds = lambda cells: structure.owned(a, mask(cells)).first()
    assert [seeds(c).status for c in ([(11, 11)], [(11, 11), (11, 11)], [(0, 0)], [(11, 11), (50, 34)])] == ["owned", "repeated seed", "seed off the support", "owned"]
    bad = structure.selector_issues(spark.createDataFrame([("ok", [[0, 9]] * 3, [[0, 1, -5, 5]], "seen"), ("low", [[9, 0]] * 3, [], "seen"), ("same", [[0, 9]] * 3, [[1, 1, 0, 1]], " ")], "id string, rgb array<array<int>>, differences array<array<int>>, observation string"))
    assert {(r.rule, r.subject) for r in bad.collect()} == {("rgb ranges", "low"), ("channel differences", "same"), ("no observation", "same")}


A, P, R = ("http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships")


def sp(number, name, x, y, w, h, text="", rot=0, line=True):
    outline = '<a:ln w="12700"><a:solidFill><a:srgbClr val="FF0000"/></a:solidFill></a:ln>' if line else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/></p:nvSpPr><p:spPr><a:xfrm rot="{rot}"><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>{outline}</p:spPr><p:txBody><a:bodyPr><a:normAutofit fontScale="50000"/></a:bodyPr><a:lstStyle><a:lvl1pPr><a:defRPr sz="4000"/></a:lvl1pPr></a:lstStyle><a:p><a:r><a:rPr baseline="30000"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def pptx(*slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId r:id="r{n}"/>' for n in reversed(range(len(slides))))
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldSz cx="1000000" cy="500000"/><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{n}" Type="x/slide" Target="slides/slide{n + 1}.xml"/>' for n in range(len(slides))) + "</Relationships>")
        for n, body in enumerate(slides):
            z.writestr(f"ppt/slides/slide{n + 1}.xml", f'<p:sld xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{R}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>' if body is not None else "<broken")
            z.writestr(f"ppt/slides/_rels/slide{n + 1}.xml.rels", '<Relationships><Relationship Id="l" Type="x/slideLayout" Target="../slideLayouts/slideLayout1.xml"/></Relationships>')
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'<p:sldLayout xmlns:p="{P}"><p:cSld><p:spTree/></p:cSld></p:sldLayout>')
        z.writestr("ppt/media/empty.png", b"")
    return out.getvalue()


def test_packages(spark, tmp_path):
    one = sp(2, "N", 0, 0, 1000, 1000, "cohort  N =\n55") + sp(3, "M", 5, 5, 1000, 1000, "TODO: x") + sp(4, "out", 990000, 0, 100000, 10, "Ã© 漢", line=False) + sp(5, "tall", 450000, 240000, 100000, 800000, "ok", 16200000, line=False)
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="100" y="200"/><a:ext cx="400" cy="200"/><a:chOff x="0" y="0"/><a:chExt cx="200" cy="100"/></a:xfrm></p:grpSpPr>{sp(7, "inner", 10, 20, 30, 40, "in")}</p:grpSp>'
    path = '<p:sp><p:nvSpPr><p:cNvPr id="9" name="curve"/></p:nvSpPr><p:spPr><a:custGeom><a:pathLst><a:path w="10" h="10"><a:moveTo><a:pt x="0" y="0"/></a:moveTo><a:lnTo><a:pt x="10" y="5"/></a:lnTo></a:path></a:pathLst></a:custGeom></p:spPr></p:sp>'
    link = '<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="11" name="c"/><p:cNvCxnSpPr><a:stCxn id="7" idx="3"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr><a:ln><a:tailEnd type="triangle"/></a:ln></p:spPr></p:cxnSp>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="8" name="pic"/></p:nvPicPr><p:blipFill><a:blip r:embed="i"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="900000" cy="490000"/></a:xfrm></p:spPr></p:pic>'
    (tmp_path / "a.pptx").write_bytes(pptx(one, group + path + link + picture))
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    (tmp_path / "half.pptx").write_bytes(pptx(None, one))
    f = package.files(spark, str(tmp_path))
    assert {r.package.rsplit("/", 1)[1] for r in package.parts(f).filter("error <> ''").collect()} == {"bad.pptx", "half.pptx"}
    a = f.filter(F.col("package").endswith("/a.pptx"))
    assert [(r.slide, r.part[-10:], r.width) for r in package.slides(a).orderBy("slide").collect()] == [(1, "slide2.xml", 1000000), (2, "slide1.xml", 1000000)]
    o = {r["name"]: r for r in package.objects(a).collect()}
    assert o["inner"].depth == 1 and o["inner"].matrix == pytest.approx([60, 0, 0, 80, 120, 240]) and o["inner"].line_width == 12700 and o["pic"].target_id == "i" and o["pic"].unsupported is None
    r = package.runs(a).filter("name = 'N'").first()
    assert (r.size, r.baseline, r.east_asian) == (20.0, 30000.0, False)
    assert [(c.kind, len(c.points)) for c in package.path_commands(a).orderBy("ord").collect()] == [("moveTo", 1), ("lnTo", 1)]
    c = package.bound_connectors(a).first()
    assert (c.source_id, c.source_port, c.target_id, c.end_arrow) == ("7", "3", None, "triangle")
    items = spark.createDataFrame([("found", "N=55", None, "N", None, 1), ("lost", "N=5", None, None, None, 1), ("slide", "in", 1, None, "7", 1)], "id string, text string, slide int, name string, shape_id string, required int")
    slides, found, totals = editability.audit(a, items)
    assert {r.slide: r.classification for r in slides.collect()} == {1: "raster-dominant-risk", 2: "native-only"}
    got = {(r.rule, r.subject) for r in found.collect()}
    assert got == {("empty media", "ppt/media/empty.png"), ("out of bounds", "out"), ("duplicate border", "N/M"), ("placeholder", "TODO: x"), ("mojibake", "Ã© 漢"), ("no East Asian font", "Ã© 漢"), ("missing text", "lost"), ("out of bounds", "tall")}
    assert totals.first().blocking == 1 + len(got) - 1  # the raster slide, and all findings but the font


def test_documents(spark, tmp_path):
    texts_ = {
        "a.svg": '<svg viewBox="0 0 10 10" xmlns:xlink="http://www.w3.org/1999/xlink"><image width="10" height="9" xlink:href="http://x/y"/><rect/><g><text/></g></svg>', "b.svg": "<svg><image/></svg>", "c.svg": "<svg", "d.svg": "<html/>",
        "e.drawio": '<mxfile><diagram><mxGraphModel><root><mxCell id="1" vertex="1" style="shape=rect"/><mxCell id="2" edge="1" source="1" target="9"><mxGeometry relative="1"/></mxCell><mxCell id="1" vertex="1" style="x;image=http://e"/></root></mxGraphModel></diagram></mxfile>', "f.drawio": "<mxfile><diagram>zzz</diagram></mxfile>",
        "g.excalidraw": json.dumps({"elements": [{"id": "a", "type": "text"}, {"id": "a", "type": "arrow", "startBinding": {"elementId": "zz"}, "boundElements": [{"id": "a"}]}, {"id": "gone", "isDeleted": True}], "files": {"x": {"dataURL": "https://e"}}}),
        "h.mmd": "%% graph\nflowchart TD\n a", "i.dot": "digraph g { a -> b; /* } */ }", "j.html": "<script>var a='<div>'</script><img src='//e'><p>x", "k.txt": "x",
    }
    for name, text in texts_.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.audit(layout.read_documents(spark, str(tmp_path))).collect()}
    assert len(got) == len(texts_)
    assert got["a.svg"].risks == ["image covers the canvas", "external assets"] and got["a.svg"].stats["native_drawables"] == 2 and not got["a.svg"].errors
    assert got["b.svg"].risks == ["images only"] and got["b.svg"].warnings == ["no viewBox"] and got["c.svg"].errors == ["not XML"] and got["d.svg"].errors == ["root is not svg"]
    assert got["e.drawio"].errors == ["page 1: dangling target", "duplicate ids"] and got["e.drawio"].risks == ["images only", "external assets"] and got["f.drawio"].risks == ["compressed diagram"]
    assert got["g.excalidraw"].errors == ["duplicate ids", "dangling startBinding"] and got["g.excalidraw"].risks == ["external assets"]
    assert got["h.mmd"].warnings == ["no edges"] and not got["h.mmd"].errors and got["i.dot"].errors == [] and got["i.dot"].stats["edge_tokens"] == 1
    assert got["j.html"].errors == ["no structure"] and got["j.html"].stats["scripts"] == 1 and got["j.html"].stats["structural_elements"] == 0 and got["k.txt"].errors == ["unknown format"]


def test_text_measurement(spark):
    size = spark.createDataFrame([("t", 60, 40, "one\ntwo"), ("flat", 60, 40, "x")], "image_id string, width int, height int, text string")
    on = {(y, x) for top in (6, 24) for y in range(top, top + 8) for x in range(10, 40) if (x // 3) % 2}
    px = [("t", y, x, 20 if (y, x) in on else 230) for y in range(40) for x in range(60)] + [("flat", y, x, 200) for y in range(40) for x in range(60)]
    got = {r.image_id: r for r in texts.measure(spark.createDataFrame(px, "image_id string, y int, x int, v int"), size).collect()}
    t = got["t"]
    assert (t.status, t.polarity, t.pixels, t.lines, t.separation) == ("INK_MEASURED", "dark", len(on), 2, 210.0)
    assert set(got["flat"].uncertain) == {"no_detectable_ink", "low_luminance_contrast", "line_count_disagrees_with_transcription"}
    items = spark.createDataFrame([("a", "text", "x", [0.0, 0.0, 5.0, 5.0]), ("b", "text", "x", [0.0, 0.0, 50.0, 5.0]), ("c", "icon", None, None)], "id string, role string, text string, bbox array<double>")
    assert {(r.id, r.rule) for r in texts.chosen(items, None, 10.0, 10.0).collect()} == {("a", None), ("b", "invalid box")}


def test_manifest_rules(spark):
    kind = "id string, available boolean, provider string, authorization string, attempt int, correction_reason string, prompt string, subject string, style string, invariants array<string>, references array<struct<role:string,path:string,authorization:string,scope:string,sha256:string>>"
    good = ("ok", True, "builtin_imagegen", "yes", 1, None, "p", "s", "t", ["i"], [])
    rows = [good, ("again", *good[1:4], 2, None, *good[6:]), ("none", *good[1:10], None), ("ref", *good[1:10], [("mood", "p", "a", "s", "x")])]
    got = {r.id: r.rules for r in manifest.preflight(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"ok": [], "again": ["no correction reason"], "none": ["references not listed"], "ref": ["reference role unknown", "reference without hash or scope"]}
    inv = spark.createDataFrame([("a", "text", "x"), ("b", "icon", "y")], "id string, role string, text string")
    change = lambda *rows: manifest.revise(inv, spark.createDataFrame(list(rows), "id string, before string, after string"))
    new, wrong = change(("a", "x", "z"))
    assert {r.text for r in new.collect()} == {"z", "y"} and wrong.count() == 0
    new, wrong = change(("a", "old", "z"), ("b", "y", "z"))
    assert {r.text for r in new.collect()} == {"x", "y"} and {r.rule for r in wrong.collect()} == {"text has changed since", "unknown item"}
    effects = spark.createDataFrame([("ok", 0.5, "solid", [("ffffff", 0.5)]), ("dark", 1.0, "solid", [("000000", 0.5)]), ("unsaid", 1.0, "linear", [("ffffff", None)]), ("none", 2.0, None, None)], "id string, opacity double, kind string, stops array<struct<color:string,alpha:double>>")
    assert {(r.id, r.rule) for r in manifest.mask_issues(effects).collect()} == {("dark", "not white"), ("unsaid", "alpha not said"), ("none", "invalid opacity")}


def test_surfaces(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    paths = spark.createDataFrame([("host", 0, "1", square(0.0, 10.0)), ("in", 1, "1", square(2.0, 4.0)), ("out", 2, "1", square(8.0, 12.0)), ("front", 3, "1", square(1.0, 2.0))], "name string, ord int, slide string, points array<struct<x:double,y:double>>")
    mark = [("host", 0.0, 5.0), ("detail", 2.0, 3.0)]
    rows = [("ok", "host", "in", ["front"], 0.1, 0.1, mark), ("escapes", "host", "out", [], 9.0, 0.5, mark), ("behind", "in", "host", [], 9.0, 99.0, []), ("order", "host", "out", ["in"], 9.0, 99.0, []), ("lost", "host", "none", [], 1.0, 1.0, [])]
    r = spark.createDataFrame(rows, "id string, host string, detail string, occluders array<string>, max_landmark double, max_escape double, landmarks array<struct<side:string,x:double,y:double>>")
    got = {x.id: x.rules for x in images.surfaces(r, paths).collect()}
    assert got == {"ok": [], "escapes": ["detail leaves host"], "behind": ["detail painted before host"], "order": ["wrong foreground order"], "lost": ["not one object"]}


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(rows):
        raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
        part = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)], [(250, 0, 9), (7, 7, 7)]]))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = sorted((r.y, r.x, r.r, r.g, r.b, r.a) for r in images.read(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 255), (1, 0, 250, 0, 9, 255), (1, 1, 7, 7, 7, 255)]


def test_fields(spark):
    boxes = spark.createDataFrame([("l", 0.0, 0.0, 24.0, 16.0), ("s", 0.0, 0.0, 24.0, 16.0)], "image_id string, bx double, by double, bw double, bh double")
    px = [("l", y, x, int(round(255 * (x + 0.5) / 24)), 40, 90, 255) for y in range(16) for x in range(24)] + [("s", y, x, 10, 20, 30, 255) for y in range(16) for x in range(24)]
    pixels = spark.createDataFrame(px, "image_id string, y int, x int, r int, g int, b int, a int")
    r = {x.image_id: x for x in fields.field(pixels, boxes, "linear").collect()}["l"]
    assert r.fits and r["count"] == 4 and min(r.angle % 180, 180 - r.angle % 180) < 0.6 and r.error < 0.02
    s = {x.image_id: x for x in fields.field(pixels, boxes, "solid").collect()}
    assert s["s"].fits and tuple(s["s"].stops[0]) == (0.0, 10, 20, 30, 1.0) and not s["l"].fits
    fade = [("f", y, x, 51, 102, 153, int(round(255 * (1 - math.hypot(x - 5.5, y - 5.5) / math.hypot(6, 6))))) for y in range(12) for x in range(12)]
    pair = fields.independent(spark.createDataFrame(fade, pixels.schema), spark.createDataFrame([("f", 0.0, 0.0, 12.0, 12.0)], boxes.schema), "solid", "radial", (4, 5)).first()
    assert (pair.colour_count, pair.alpha_count) == (1, 4) and pair.error < 0.02
    values = spark.createDataFrame([("m", i + 0.5, float(v)) for i, v in enumerate(np.interp(np.arange(20) + 0.5, [0, 10, 20], [0.2, 1.0, 0.4]))], "k string, at double, v double")
    assert fits.axis_gradient(values, ["k"], 20.0, 3).first()["values"] == pytest.approx([0.2, 1.0, 0.4], abs=1e-6)
    patch = [("f", k, float(x), float(y), 3 + 2.0 * x - y) for k, (a, b) in enumerate([(0, 0), (8, 0), (0, 8), (8, 8)]) for x in (a, a + 1) for y in (b, b + 1)]
    samples = spark.createDataFrame(patch, "k string, patch long, x double, y double, v double")
    f = fits.affine_fits(samples, ["k"])
    whole = f.filter("fold = -1").first()
    assert (whole.c0, whole.cx, whole.cy) == pytest.approx((3, 2, -1)) and whole["rank"] == 3
    assert all(max(r.fit_error, r.held_out_error) < 1e-9 for r in fits.held_out(samples, f, ["k"]).collect())
    flat = samples.filter("patch < 2")
    assert {r["rank"] for r in fits.affine_fits(flat, ["k"]).filter("fold = -1").collect()} == {2}


def test_hull(spark):
    corners = spark.createDataFrame([("a", float(x), float(y)) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]] + [("line", float(k), 2.0 * k) for k in range(4)], "k string, x double, y double")
    points = [("a", 1.0, 1.0), ("a", 4.0, 4.0), ("a", 4.0, 1.0), ("a", 5.0, 1.0), ("a", -0.001, 2.0), ("line", 1.0, 2.0), ("none", 0.0, 0.0)]
    got = {(r.k, r.px, r.py): r.inside for r in fits.in_hull(spark.createDataFrame(points, "k string, px double, py double"), corners, ["k"]).collect()}
    assert [got[p] for p in points] == [True, True, True, False, False, False, False]


def test_colour_functions(spark):
    stops = F.array(F.struct(F.lit(0.0).alias("position"), F.lit("FF0000").alias("color"), F.lit(1.0).alias("alpha")), F.struct(F.lit(1.0).alias("position"), F.lit("0000FF").alias("color"), F.lit(0.5).alias("alpha")))
    angle, focus, whole = F.lit(90.0), F.array(F.lit(0.5), F.lit(0.25)), F.lit(1.0)
    xml = lambda kind, opacity=whole: numeric.paint_xml(F.lit(kind), F.lit("00FF00"), F.lit(0.5), angle, focus, stops, opacity)
    r = spark.range(1).select(xml("none").alias("a"), xml("group").alias("b"), xml("linear").alias("c"), xml("path").alias("d"), numeric.compositing_xml(F.lit(0.25), F.lit(None).cast("string")).alias("e"), numeric.compositing_xml(whole, F.lit("<m/>")).alias("f"), numeric.radial_stops(stops, F.lit(2.5), F.lit(6.0), F.lit(8.0)).alias("g")).first()
    assert (r.a, r.b) == ("<a:noFill/>", "<a:grpFill/>") and '<a:lin ang="5400000" scaled="0"/>' in r.c and '<a:gs pos="100000"><a:srgbClr val="0000FF"><a:alpha val="50000"/>' in r.c and 'l="50000" t="25000" r="50000" b="75000"' in r.d
    assert r.e == '<a:effectDag><a:alphaModFix amt="25000"/></a:effectDag>' and r.f == "<a:effectDag><a:alphaMod><a:cont><a:fill><m/></a:fill></a:cont></a:alphaMod></a:effectDag>"
    assert [(s.position, s.color) for s in r.g] == [(0.0, "FF0000"), (0.5, "0000FF"), (1.0, "0000FF")]
    q = spark.range(1).select(numeric.same_points(F.lit(12700 * 3), F.lit(3.0), F.lit(False)).alias("a"), numeric.same_points(F.lit(12800), F.lit(1.0), F.lit(True)).alias("b"), numeric.same_points(F.lit(12800), F.lit(1.0), F.lit(False)).alias("c")).first()
    assert (q.a, q.b, q.c) == (True, True, False)


def test_percentiles_and_ranged_averages(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([1.0, 2.0, 2.5, 100.0 * rnd.random()])) for k in "ab" for i in range(200)] + [("c", 0, 5.0), ("c", 1, None)]
    d = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.k: (r.p0, r.p1) for r in histogram.percentiles(d, ["k"], "v", [0.1, 0.95], bins=8).collect()}
    for k in "abc":
        v = [x for q, _, x in rows if q == k and x is not None]
        assert got[k] == pytest.approx((np.percentile(v, 10), np.percentile(v, 95)))
    plain = {(r.k, r.i): r.smooth for r in series.moving_average(d, ["k"], ["i"], "v", 5).collect()}
    wide = {(r.k, r.i): r.smooth for r in series.moving_average_wide(d, ["k"], ["i"], F.floor(F.col("i") / 7), "v", 5, size=10).collect()}
    assert wide == pytest.approx(plain)


def test_json_sink(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0)], "a int, b double")
    layout.write_json(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().b == 2.0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        layout.write_json(d, str(tmp_path / "out"))
    with pytest.raises(Exception, match="not finite"):
        layout.write_json(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "nan"))


def test_marker_issues(spark):
    pixels = spark.createDataFrame([("i", 0, x, 0, 0, 0) for x in (0, 1, 2, 5)], "image_id string, y int, x int, r int, g int, b int")
    seeds = spark.createDataFrame([("i", 0, "a", 0, 0), ("i", 1, "b", 0, 0), ("i", 2, "c", 9, 9)], "image_id string, ord int, owner string, y int, x int")
    got = {(r.rule, r.n) for r in flood.issues(pixels, seeds, "image_id").collect()}
    assert got == {("repeated seed", 1), ("seed off the support", 1), ("pixels without owner", 1)}


def test_strict_svg(spark):
    head = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10 10">'
    good = {
        "a": head + '<title>t</title><g transform="translate(3,1) rotate(90) scale(2)" stroke="currentColor" color="navy"><path id="p" d="M1 0l1 0 h1V2z"/></g><line x2="4" style="stroke: #abc"/></svg>',
        "b": '<svg width="10px" height="4"><circle cx="5" cy="5" r="2" fill="none"/><rect width="4" height="2" rx="9"/><polyline points="0,0 1,1 2,0"/><ellipse rx="2" ry="1"/></svg>',
        "deep": head + "<g>" * 1900 + '<path d="M0 0Q5 5 10 0T20 0C1 1 2 2 3 3S4 4 5 5m1 1 1 1"/>' + "</g>" * 1900 + "</svg>",
    }
    inside = lambda x: head + x + "</svg>"
    bad = {
        "no content": None,
        "too many bytes": " " * 2_000_001,
        "not XML": "",
        "root is not svg": "<html/>",
        "DTD and entities are not allowed": "<!doctype svg>" + head + "</svg>",
        "no view box of any size": '<svg><path d="M0 0"/></svg>',
        "nothing drawn": inside("<g/>"),
        "too many elements": inside("<g/>" * 2000),
        "unsupported element or attribute": inside("<text/>"),
        "an id occurs twice": inside('<path id="a" d="M0 0"/><path id="a" d="M0 0"/>'),
        "unsupported inline style": inside('<path d="M0 0" style="filter:x"/>'),
        "even-odd fill": inside('<path d="M0 0" fill-rule="evenodd"/>'),
        "a transform isn't a move, turn or uniform scale": inside('<path d="M0 0" transform="scale(1 2)"/>'),
        "a primitive has elements inside": inside('<path d="M0 0"><g/></path>'),
        "a path is empty or too long": inside("<path/>"),
        "a path has too few numbers": inside('<path d="M0"/>'),
        "a path has an unknown step or no start": inside('<path d="L0 0"/>'),
        "a path has numbers without a step": inside('<path d="M0 0Z 1 1"/>'),
        "a circle or ellipse has no size": inside("<circle/>"),
        "a rectangle has no size": inside('<rect width="1"/>'),
        "a polygon or polyline lacks points": inside('<polygon points="0 0 1 1"/>'),
        "a list has more than numbers": inside('<polygon points="0 0 a"/>'),
        "a length is no number in range": inside('<line x1="2em"/>'),
        "a point is out of range": inside('<path d="M1e9 0" transform="scale(2)"/>'),
        "a paint is no solid colour": inside('<path d="M0 0" fill="url(#a)"/>'),
        "unsupported stroke or opacity": inside('<path d="M0 0" fill-opacity="2"/>'),
    }
    docs = spark.createDataFrame([(k, v) for k, v in (good | bad).items()], "path string, content string")
    got = vectors.parts(docs).orderBy("path", "ord").collect()
    assert {r.path: r.rule for r in got if r.path in bad} == {k: k for k in bad}
    p, line, circle, rect, poly, ellipse, deep = (r for r in got if r.path in good)
    assert p.id == "p" and p.stroke == "000080" and p.fill == "000000" and p.stroke_width == 2 and [c.op for c in p.commands] == ["M", "L", "L", "L", "Z"]
    assert np.allclose([c.xy for c in p.commands[:4]], [[3, 3], [3, 5], [3, 7], [-1, 7]])
    assert (line.id, line.fill, line.stroke, line.view_box) == ("part-0002", None, "AABBCC", [0, 0, 10, 10])
    assert circle.fill is None and circle.view_box == [0, 0, 10, 4] and [c.op for c in circle.commands] == ["M", "C", "C", "C", "C", "Z"]
    points = [np.array(c.xy[-2:]) for c in circle.commands[:-1]]
    assert all(abs(np.hypot(*(q - 5)) - 2) < 1e-9 for q in points)
    ends = [c.xy[-2:] for c in rect.commands if c.xy]
    assert np.allclose([np.min(ends, 0), np.max(ends, 0)], [[0, 0], [4, 2]]) and poly.id == "part-0003" and len(ellipse.commands) == 6
    assert [c.op for c in deep.commands] == ["M", "C", "C", "C", "C", "M", "L"] and np.allclose(deep.commands[2].xy, [40 / 3, -10 / 3, 50 / 3, -10 / 3, 20, 0])
    assert deep.commands[-1].xy == [7, 7]
    # Only large arcs need more than two curves; a sweep of growing angles passes right of the chord; ends lie on one circle once the ellipse is one.
    for large, sweep in ((a, b) for a in (False, True) for b in (False, True)):
        curves = vectors.arc(1 + 1j, 5, 3, 30, large, sweep, 4 + 3j)
        assert curves[-1][2] == 4 + 3j and (len(curves) > 2) == large
        middle = curves[len(curves) // 2][0] - (1 + 1j)
        assert ((middle / (3 + 2j)).imag < 0) == sweep
        spun = [z / np.exp(1j * np.pi / 6) for z in [1 + 1j] + [c[2] for c in curves]]
        x, y = np.array([z.real / 5 for z in spun]), np.array([z.imag / 3 for z in spun])
        if len(spun) > 2:
            cx, cy, k = np.linalg.lstsq(np.c_[2 * x, 2 * y, np.ones(len(x))], x**2 + y**2, rcond=None)[0]
            assert abs(k + cx**2 + cy**2 - 1) < 1e-9
    assert vectors.parts(docs.limit(0)).count() == 0


def test_traced_svg(spark):
    ns = 'xmlns="http://www.w3.org/2000/svg"'
    rows = [("a", f'<svg {ns} desc="x"><path d="M0 0L1 1Z" opacity="0.5"/><path d="m0 0"/></svg>'), ("b", f"<svg {ns}><g/></svg>"), ("c", None), ("d", "<")]
    a, b, c, d = vectors.name_traced(spark.createDataFrame(rows, "path string, content string"), "smooth").orderBy("path").collect()
    assert 'id="color-region-0001"' in a.svg and 'stroke-opacity="0.5"' in a.svg and "desc" not in a.svg and " opacity" not in a.svg
    assert (a.svg_paths, a.xml_elements, a.max_path_chars, a.commands, a.svg_bytes) == (2, 3, 9, 4, len(a.svg.encode()))
    assert (b.rule, c.rule, d.rule) == ("an element is no path", "no content", "not XML")
