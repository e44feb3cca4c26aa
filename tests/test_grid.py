"""Spatial joins against comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from figmill.functions.numeric import crosses, point_segment, segment_hits_box
from figmill.operators import grid
from figmill.plans import clearance, editability, images


def boxes(spark, rows):
    return spark.createDataFrame([(s, k, f"n{k}", *map(float, b)) for k, (s, *b) in enumerate(rows)], "slide string, ord int, name string, x double, y double, w double, h double")


def random_boxes(rnd, n, scale, spread):
    return [(rnd.choice("pq"), rnd.uniform(-1, 1) * scale, rnd.uniform(-1, 1) * scale, *(scale * 10 ** -rnd.uniform(*spread) for _ in "wh")) for _ in range(n)]


@pytest.mark.parametrize("scale", [1e-3, 100.0, 9144000.0])
@pytest.mark.parametrize("gap", [0.0, 0.02])
def test_box_pairs(spark, scale, gap):
    rnd = random.Random(3)
    rows = random_boxes(rnd, 150, scale, (0, 3)) + [("p", 0, 0, 0, 0), ("p", 0, 0, 0, scale), ("q", -scale, -scale, 2 * scale, 2 * scale), ("q", float("nan"), 0, 1, 1), ("q", 0, 0, float("inf"), 1)]
    g, eps = gap * scale, clearance.EPS
    over = lambda a, b, k: min(a[k] + a[k + 2] + g, b[k] + b[k + 2] + g) > max(a[k], b[k]) + eps
    want = {(a[0], f"n{i}", f"n{j}") for i, a in enumerate(rows[:-2]) for j, b in enumerate(rows[:-2]) if i < j and a[0] == b[0] and over(a, b, 1) and over(a, b, 2)}
    got = clearance.box_pairs(boxes(spark, rows), g).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def random_paths(rnd, n, scale):
    return [(rnd.choice("pq"), f"t{k}", rnd.random() < 0.5, [(rnd.uniform(-1, 1) * scale, rnd.uniform(-1, 1) * scale * rnd.choice([1, 0])) for _ in range(rnd.randint(2, 6))], rnd.choice([None, 0.0, 0.05 * scale])) for k in range(n)] + [("p", "upright", False, [(0.0, -scale), (0.0, scale)], None), ("p", "steep", False, [(0.0, -scale), (scale * 1e-12, scale)], None), ("q", "dot", True, [(0.0, 0.0)] * 3, None)]


@pytest.mark.parametrize("scale", [0.01, 9144000.0])
def test_path_hits(spark, scale):
    rnd = random.Random(4)
    b = boxes(spark, random_boxes(rnd, 120, scale, (0.3, 3)))
    p = spark.createDataFrame(random_paths(rnd, 25, scale), "slide string, name string, closed boolean, points array<struct<x: double, y: double>>, width double")
    pad = 0.01 * scale
    got = {tuple(r) for r in clearance.path_hits(b, p, pad).collect()}
    every = b.crossJoin(clearance.edges(p).withColumnRenamed("slide", "s2")).filter("slide = s2")
    hit = segment_hits_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "x", "y", "w", "h")), pad + F.col("width") / 2)
    centre = crosses(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    want = every.groupBy("slide", "name", "path").agg(F.bool_or(hit).alias("hit"), F.sum(F.when(F.col("closed"), centre).otherwise(0)).alias("n")).filter("hit or n % 2 = 1")
    assert got == {(r.slide, r.name, r.path) for r in want.collect()} and len(got) > 100


def test_to_polygon(spark):
    rnd = random.Random(5)
    polygons = [(k, [(rnd.uniform(-1, 1) * 10**k, rnd.uniform(-1, 1) * 10**k) for _ in range(rnd.randint(3, 40))]) for k in range(5)] + [(7, [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)])]
    points = [(k, rnd.uniform(-3, 3) * 10**k, rnd.uniform(-3, 3) * 10**k, n) for k in range(5) for n in range(60)] + [(7, 0.0, 1.0, 0), (7, 1.0, 2.0, 1), (7, 2.0, 2.0, 2), (7, 1.0, 1.0, 3), (7, 1.0, 1.0, 3), (7, 900.0, -5000.0, 4), (8, 0.0, 0.0, 5), (7, float("nan"), 0.0, 6)]
    p = spark.createDataFrame(points, "id int, px double, py double, n int")
    g = spark.createDataFrame(polygons, "id int, points array<struct<x: double, y: double>>")
    got = sorted((r.id, r.px, r.py, r.n, round(r.distance, 6), r.inside) for r in images.to_polygon(p, g).collect())
    at = [F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")]
    every = p.filter("not isnan(px)").withColumn("k", F.monotonically_increasing_id()).join(images.polygon_edges(g), "id").groupBy("id", "px", "py", "n", "k").agg(F.min(point_segment(*at)).alias("d"), F.sum(crosses(*at)).alias("c"))
    assert got == sorted((r.id, r.px, r.py, r.n, round(r.d, 6), r.d < 1e-7 or r.c % 2 == 1) for r in every.collect())


def test_duplicate_borders(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("pq"), k, f"n{k}", *(rnd.randint(0, 60) for _ in range(2)), *(rnd.randint(50, 56) for _ in range(2)), 0.0, rnd.choice([1, 2]), "c") for k in range(300)]
    d = spark.createDataFrame(rows, "slide string, ord int, name string, x_emu int, y_emu int, w_emu int, h_emu int, rotation_deg double, line_width int, line_color string")
    want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[8] == b[8] and all(abs(a[i] - b[i]) <= 5 for i in range(3, 7))}
    got = editability.duplicate_borders(d, ["slide"], 5).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty(spark):
    none = boxes(spark, [])
    paths = spark.createDataFrame([], "slide string, name string, closed boolean, points array<struct<x: double, y: double>>")
    assert clearance.box_pairs(none).collect() == [] == clearance.path_hits(none, paths).collect()


def test_a_large_slide(spark):
    """100,000 boxes and 10,000 segments on one slide, in units of which a box has thousands."""
    b = spark.range(100_000).select(F.lit("s").alias("slide"), F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("name"), ((F.col("id") % 400) * 22860.0).alias("x"), (F.floor(F.col("id") / 400) * 27432.0).alias("y"), F.lit(20000.0).alias("w"), F.lit(20000.0).alias("h"))
    p = spark.range(10_000).select(F.lit("s").alias("slide"), F.concat(F.lit("t"), "id").alias("name"), F.lit(False).alias("closed"), F.array(*(F.struct(((F.col("id") * 7919 + k * 3) % 400 * 22860.0 + 10000).alias("x"), (F.floor(F.col("id") / 40) * 27432.0 + 10000).alias("y")) for k in (0, 1))).alias("points"))
    assert clearance.box_pairs(b).count() == 0
    assert clearance.path_hits(b, p).count() >= 20_000


def test_joins_over_cells_bring_no_table_to_the_driver(spark, tmp_path):
    spark.range(200).selectExpr("1 AS slide", "double(id) AS x", "0d AS y", "0.5d AS w", "1d AS h", "double(id) AS px", "0.5d AS py").write.parquet(f"{tmp_path}/boxes")
    spark.range(200).selectExpr("1 AS slide", "id AS edge", "id + 0.25d AS x0", "-1d AS y0", "id + 0.25d AS x1", "2d AS y1").write.parquet(f"{tmp_path}/edges")
    boxes, edges = spark.read.parquet(f"{tmp_path}/boxes"), spark.read.parquet(f"{tmp_path}/edges")
    near = grid.near_segments(boxes.drop("px", "py"), edges, ["slide"], F.lit(0.1))
    over = grid.crossings(boxes.select("slide", "px", "py"), edges, ["slide"], F.col("x0") == F.col("px") + 0.25)
    assert near.filter("x0 > x AND x0 < x + w").select("edge").distinct().count() == 200
    assert over.select("edge").distinct().count() == 200
    for found in (near, over):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
