"""Steps whose work or memory must not grow faster than the input."""

import random

import pytest
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.operators import fits, grid, intervals, scenes
from figmill.plans import clearance, contracts, curves, editability, images, structure
from figmill.sources import vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_items_and_objects_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda text, token: (seen.add(1), 0 if text is None else text.count(token))[1], "int")
    monkeypatch.setattr(editability.T, "token_count", count)
    kind = "slide int, name string, shape_id string, text string"
    items = spark.createDataFrame([(k, [None, 1, 2][k % 3], "n" if k % 2 else None, None, "tok", 1) for k in range(120)], f"id int, {kind}, required int")
    objects = spark.createDataFrame([(k % 3, "n" if k % 5 else None, "s", "a tok tok") for k in range(150)] + [(1, "n", None, None)], kind)
    slides = {None: [0, 1, 2], 1: [1], 2: [2]}
    want = {k: 2 * sum(m % 3 in slides[[None, 1, 2][k % 3]] and (not k % 2 or m % 5 > 0) for m in range(150)) for k in range(120)}
    assert {r.id: r.observed for r in editability.inventory(items, objects).collect()} == want
    assert seen.value <= 100


def test_band_pairs(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("pq"), k, rnd.choice([rnd.uniform(-9, 9), float(rnd.randint(-5, 5))])) for k in range(300)] + [("p", 300, float("nan")), ("p", 301, None), ("p", 302, float("inf")), ("p", 303, float("inf")), ("p", None, 1.0), ("p", 7, 1.0)]
    d = spark.createDataFrame(rows, "g string, k int, v double")
    found = intervals.band_pairs(d, ["g"], "k", "v", 0.5)
    assert "Broadcast" not in plan(found)
    whole = [r for r in rows if r[1] is not None and r[2] is not None and abs(r[2]) < 99]
    want = sorted((a[1], b[1], abs(a[2] - b[2])) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 0.5)
    assert sorted(tuple(r) for r in found.collect()) == want


@pytest.mark.parametrize("piece", [7, 512])
def test_band_pairs_compare_equal_values_once(spark, monkeypatch, piece):
    """Only pieces of equal values are joined; their pairs are written out after that."""
    monkeypatch.setattr(intervals, "SAME", piece, raising=False)
    rows = [("p", k % 60, [0.0, -0.0, 1.0, 1.125, 2.0][k % 5]) for k in range(100)]
    found = intervals.band_pairs(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v", 0.5)
    want = sorted((min(a[1], b[1]), max(a[1], b[1]), abs(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i] if a[1] != b[1] and abs(a[2] - b[2]) <= 0.5)
    assert sorted(tuple(r) for r in found.collect()) == want
    above, below = plan(found).split("SortMergeJoin", 1)
    assert above.count("Generate explode") >= 2 and "collect_list" in below


def test_points_of_small_polygons_need_no_cells(spark, monkeypatch):
    monkeypatch.setattr(grid, "edge_distances", lambda *_: pytest.fail("cells"))
    p = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 1.0), (1, 2.0, 1.0), (2, 0.0, 0.0), (1, float("nan"), 1.0)], "id int, px double, py double")
    g = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)])], "id int, points array<struct<x: double, y: double>>")
    assert sorted(tuple(r) for r in images.to_polygon(p, g).collect()) == [(1, 1.0, 1.0, 1.0, True), (1, 2.0, 1.0, 0.0, True), (1, 5.0, 1.0, 3.0, False)]


def test_contracts_bring_no_table_to_the_driver(spark):
    d = spark.createDataFrame([("a", '{"schema_version": 1}'), ("b", "no json")], "path string, content string")
    found = contracts.violations(d)
    assert "Broadcast" not in plan(found)
    assert {tuple(r) for r in found.filter("path = 'b'").collect()} == {("b", "not a manifest", "")}


def test_fits_of_many_keys_at_once(spark):
    rnd = random.Random(14)
    rows = [(k, n, rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(0, 9)) for k in range(40) for n in range(k % 7 + 1)] + [(99, n, float(n), 0.0, 1.0) for n in range(5)]
    d = spark.createDataFrame(rows, "k int, patch long, x double, y double, v double")
    got = fits.affine_fits(d, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(got)
    import numpy as np

    for r in got.collect():
        own = [q for q in rows if q[0] == r.k and q[1] != r.fold]
        x = np.array([(1, q[2], q[3]) for q in own]).reshape(-1, 3)
        assert r.rank == (np.linalg.matrix_rank(x) if own else 0)
        if r.rank == 3:
            assert (r.c0, r.cx, r.cy) == pytest.approx(tuple(np.linalg.lstsq(x, np.array([q[4] for q in own]), rcond=None)[0]), rel=1e-6, abs=1e-8)
            assert r.condition == pytest.approx(np.linalg.cond(x))
        else:
            assert r.c0 is None and r.cx is None and r.cy is None and r.condition is None
    assert got.count() == sum(k % 7 + 2 for k in range(40)) + 6


def test_envelopes_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(curves, "EDGES_A_TASK", 10)
    e = spark.range(100).selectExpr("id AS k", "0d AS x0", "0.5d AS y0", "1d AS x1", "0.25d AS y1")
    found = curves.envelope(e, ["k"])
    assert ", 10), REPARTITION_BY_NUM" in plan(found)
    assert found.count() == 100 * curves.POINTS


def test_boundaries_meet_within_two_pixels_first(spark, monkeypatch):
    asked, plain = [], structure.nearest
    monkeypatch.setattr(structure, "nearest", lambda a, b, cell=16: (asked.append(cell), plain(a, b, cell))[1])
    m = lambda at: spark.createDataFrame([("i", y, x) for y in range(at, at + 9) for x in range(at, at + 9)], "image_id string, y int, x int")
    r = structure.distances(m(0), m(40)).first()
    assert asked == [2, 2] and r.boundary_max == pytest.approx(40 * 2**0.5) and (r.direction, r.worst_y, r.worst_x) == ("a to b", 0, 0)


def test_only_texts_that_may_change_go_through_python(spark):
    import re
    import unicodedata

    inside = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), T.UNSTABLE.replace(r"\p{M}", "").replace(r"\p{Cn}", "")) + "]")
    for c in map(chr, range(0x110000)):
        if unicodedata.category(c)[0] != "M" and unicodedata.category(c) not in ("Cn", "Cs") and not inside.match(c):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)
            d = unicodedata.decomposition(c).split()
            if len(d) == 2 and not d[0].startswith("<"):
                second = chr(int(d[1], 16))
                assert unicodedata.category(second)[0] == "M" or inside.match(second)
    texts = ["plain", "caf\u00e9 \u2019x", "cafe\u0301", "\u212b", "\u1100\u1161", "q\u0323\u0307 q\u0307\u0323", None, "\uac00\u11a8", "x\U0002f800"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.match_key(F.col("t")).alias("k")).collect()
    assert all(r.k == re.sub(r"\s+", "", unicodedata.normalize("NFC", r.t or "")) for r in d)
    assert spark.createDataFrame([(t,) for t in texts], "t string").filter(T.may_change(F.col("t"))).count() == 6


def test_neighbours_are_added_up_within_tiles(spark):
    d = spark.range(40_000).selectExpr("1 AS image_id", "int(id / 200) AS y", "int(id % 200) AS x", "int(id * 7919 % 256) AS v").repartition(40)
    for found in (images.edges(d, 200, 200), images.worst_window(d, 4)):
        assert "REPARTITION_BY_COL" in plan(found)


@pytest.mark.parametrize("piece", [3, 512])
def test_boxes_meet_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(grid, "PIECE", piece)
    monkeypatch.setattr(grid, "FOUND", 50)
    rnd = random.Random(6)
    rows = [(rnd.choice("pq"), k, f"n{k % 9}", rnd.uniform(0, 30), rnd.uniform(0, 90), rnd.choice([0.0, 1.0, 9.0]), rnd.uniform(0, 4)) for k in range(200)] + [("p", None, "n", 0.0, 0.0, 99.0, 99.0), ("p", 300, None, 0.0, 0.0, 50.0, 2.0)]
    found = clearance.box_pairs(spark.createDataFrame(rows, "slide string, ord int, name string, x double, y double, w double, h double"), 0.5)
    assert "Broadcast" not in plan(found)
    over = lambda a, b, k: min(a[k] + a[k + 2] + 0.5, b[k] + b[k + 2] + 0.5) > max(a[k], b[k]) + clearance.EPS
    whole = [r for r in rows if r[1] is not None]
    want = [(a[0], a[2], b[2]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and over(a, b, 3) and over(a, b, 4)]
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame(want, "slide string, a string, b string").collect()) and len(want) > 100


@pytest.mark.parametrize("piece", [2, 256])
def test_equal_borders_are_compared_once(spark, monkeypatch, piece):
    monkeypatch.setattr(editability, "PIECE", piece)
    rows = [("s", k, f"n{k}", 100 * (k % 4), 0, 10, 10 + k % 2, 0.0, 1, "c") for k in range(80)]
    d = spark.createDataFrame([*rows, ("s", None, "x", 0, 0, 10, 10, 0.0, 1, "c")], "slide string, ord int, name string, x_emu long, y_emu long, w_emu long, h_emu long, rotation_deg double, line_width int, line_color string")
    found = editability.duplicate_borders(d, ["slide"], 5)
    assert "Broadcast" not in plan(found) and "explode(aheld" in plan(found)
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[1] < b[1] and all(abs(a[k] - b[k]) <= 5 for k in (3, 4, 5, 6)))
    assert sorted((r.a, r.b) for r in found.collect()) == want and len(want) == 4 * 190


def test_equal_drawings_are_read_once(spark, monkeypatch):
    seen, plain = [], vectors.nodes.xml
    monkeypatch.setattr(vectors.nodes, "xml", lambda docs, *rest: (seen.append(docs.count()), plain(docs, *rest))[1])
    svg = lambda w: f'<svg viewBox="0 0 9 9"><rect width="{w}" height="3"/></svg>'
    d = spark.createDataFrame([(f"p{k}", svg(k % 3)) for k in range(30)] + [("none", None), ("none2", None), ("bad", "<svg"), ("p1", svg(1))], "path string, content string")
    got = [(r.path, r.rule, r.commands is None, r.sha256 is None) for r in vectors.parts(d).collect()]
    assert seen == [4]
    want = [(f"p{k}", None if k % 3 else "a rectangle has no size", k % 3 == 0, False) for k in [*range(30), 1]] + [("none", "no content", True, True), ("none2", "no content", True, True), ("bad", "not XML", True, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_groups_are_dealt_by_the_number_of_members(spark, monkeypatch):
    monkeypatch.setattr(scenes, "MEMBERS_A_TASK", 10)
    monkeypatch.setattr(scenes, "PLACES", 7)
    rnd = random.Random(24)
    ids = [(k, i) for k in "pq" for i in range(60)]
    place = {a: a[1] + (a[1] > 50) for a in ids} | {("q", 7): 8, ("q", 9): None}
    members = [(k, i // 10 if k == "p" else rnd.randrange(40), i) for k, i in ids] + [("p", 2, 25), ("q", 99, 5), ("q", 99, 5), ("p", 98, 777), (None, 1, 1), ("p", None, 3)]
    known = spark.createDataFrame([(*a, p) for a, p in place.items()] + [("p", 59, 61)], "k string, id int, position long")
    found = scenes.contiguous(spark.createDataFrame(members * 2, "k string, group int, id int").distinct().unionByName(spark.createDataFrame([("q", 99, 5)], "k string, group int, id int")), known, "k")
    assert plan(found).count(", 13), REPARTITION_BY_NUM") >= 4  # 125 members, 10 to a task
    places = {**{a: [p] for a, p in place.items()}, ("p", 59): [60, 61]}
    want = {}
    for k, group, i in [*set(members), ("q", 99, 5)]:
        want.setdefault((k, group), []).extend(places.get((k, i), [None]))
    for at, own in want.items():
        real = [p for p in own if p is not None]
        want[at] = (len(own), min(real, default=None), len(set(real)) == len(own) == max(real) - min(real) + 1 if real else False)
    assert {(r.k, r.group): (r.members, r["first"], r.contiguous) for r in found.collect()} == want
    assert {c for *_, c in want.values()} == {True, False}
