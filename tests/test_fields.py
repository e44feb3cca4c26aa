"""Fields fitted from sums against fits of every pixel in NumPy."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from figmill.operators import fields, fits


def design(t, count):
    at = np.rint(np.arange(count) / max(1, count - 1) * 1e5) / 1e5
    return np.column_stack([np.interp(t, at, row) for row in np.eye(count)])


def sums(t, rgba, count):
    at = np.rint(np.arange(count) / max(1, count - 1) * 1e5) / 1e5
    parts = {}
    for v, (r, g, b, a) in zip(t, rgba):
        k = max(0, min(count - 2, int(np.searchsorted(at, v, side="right")) - 1))
        s = (v - at[k]) / (at[k + 1] - at[k]) if count > 1 else 0.0
        p = parts.setdefault(k, {"k": k, "s": np.zeros(5), "a": np.zeros(2), "aa": 0.0, **{c: np.zeros(3) for c in "rgb"}, **{2 * c: 0.0 for c in "rgb"}})
        powers = s ** np.arange(5)
        p["s"], p["a"], p["aa"] = p["s"] + powers, p["a"] + a * powers[:2], p["aa"] + a * a
        for c, x in zip("rgb", (r, g, b)):
            p[c], p[2 * c] = p[c] + x * a * powers[:3], p[2 * c] + (x * a) ** 2
    return list(parts.values())


@pytest.mark.parametrize("count", [1, 2, 4, 7])
def test_sums_give_the_fit_of_all_pixels(count):
    rnd = np.random.default_rng(count)
    t, rgba = rnd.random(400), rnd.random((400, 4))
    rgba[:, 0] = 0.2 + 0.6 * t
    colour, alpha, cost = fields.solved(count, sums(t, rgba, count))
    h = design(t, count)
    want = np.rint(fits.in_box(h.T @ h, h.T @ rgba[:, 3])[0] * 1e5) / 1e5
    assert np.abs(alpha - want).max() <= 1.1e-5
    cover = h @ alpha
    wide = h * cover[:, None]
    for c in range(3):
        own = np.rint(fits.in_box(wide.T @ wide, wide.T @ (rgba[:, c] * rgba[:, 3]))[0] * 255) / 255
        assert np.abs(colour[:, c] - own).max() < 1.1 / 255
    off = np.column_stack((h @ colour * cover[:, None] - rgba[:, :3] * rgba[:, 3:], cover - rgba[:, 3]))
    assert abs(cost - (off**2).mean()) < 1e-9


def test_stops_that_no_pixel_is_near():
    t = np.array([0.0, 0.01, 0.02, 1.0, 0.99])
    rgba = np.column_stack([np.full((5, 3), 0.4), [1.0, 1.0, 1.0, 0.5, 0.5]])
    colour, alpha, _ = fields.solved(5, sums(t, rgba, 5))
    assert np.all(np.diff(alpha) <= 1e-9) and abs(alpha[2] - 0.75) < 0.01 and np.abs(colour - 0.4).max() < 1e-9
    assert fields.solved(4, sums(np.array([0.5]), np.full((1, 4), 0.5), 4)) is None


@pytest.mark.parametrize("angle", [0.0, 37.3, 90.0, 151.2])
def test_linear_field_at_an_angle(spark, angle):
    d = np.array([math.cos(math.radians(angle)), math.sin(math.radians(angle))])
    ends = [px * d[0] + py * d[1] for px in (0, 40) for py in (0, 30)]
    rows = []
    for y in range(30):
        for x in range(40):
            t = ((x + 0.5) * d[0] + (y + 0.5) * d[1] - min(ends)) / (max(ends) - min(ends))
            rows.append(("i", y, x, round(255 * np.interp(t, [0, 1 / 3, 2 / 3, 1], [0.1, 0.8, 0.3, 0.9])), round(255 * np.interp(t, [0, 1 / 3, 2 / 3, 1], [0.9, 0.2, 0.6, 0.1])), 128, round(255 * np.interp(t, [0, 1], [1.0, 0.6]))))
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, r int, g int, b int, a int").repartition(3)
    boxes = spark.createDataFrame([("i", 0.0, 0.0, 40.0, 30.0)], "image_id string, bx double, by double, bw double, bh double")
    r = fields.field(pixels, boxes, "linear", counts=(2, 4)).first()
    assert r.fits and r["count"] == 4 and abs((r.angle - angle + 90) % 180 - 90) < 0.3 and [s.position for s in r.stops] == [0.0, 0.33333, 0.66667, 1.0]
    assert np.abs(np.array([s.r for s in r.stops]) / 255 - [0.1, 0.8, 0.3, 0.9]).max() < 0.02 and np.abs(np.array([s.alpha for s in r.stops]) - [1, 0.8667, 0.7333, 0.6]).max() < 0.02


def test_no_pixels(spark):
    none = spark.createDataFrame([], "image_id string, y int, x int, r int, g int, b int, a int")
    boxes = spark.createDataFrame([("i", 0.0, 0.0, 4.0, 3.0)], "image_id string, bx double, by double, bw double, bh double")
    assert fields.field(none, boxes, "linear").collect() == [] == fields.independent(none, boxes, "solid", "linear").collect()


def test_least_squares_in_a_box():
    """The conditions of a least value in [0, 1] hold, on regular and nearly dependent designs."""
    rnd = np.random.default_rng(21)
    for n in range(300):
        k = rnd.integers(1, 9)
        a = rnd.normal(size=(30, k)) + (rnd.normal(size=(30, 1)) * 50 if n % 3 == 0 else 0)
        y = a @ rnd.uniform(-0.6, 1.6, k) + rnd.normal(size=30) * (n % 2)
        gram, moment = a.T @ a, a.T @ y
        v, found = fits.in_box(gram, moment)
        assert found and v.min() >= 0 and v.max() <= 1
        slope, slack = moment - gram @ v, 1e-6 * np.abs(moment).max()
        assert (np.abs(slope[(v > 0) & (v < 1)]) <= slack).all() and (slope[v == 0] <= slack).all() and (slope[v == 1] >= -slack).all()


def test_sums_take_no_powers(spark):
    """Powers of the share are products of it, and a fit's systems come from few products of small matrices."""
    d = spark.createDataFrame([("i", 0, x, 0.5, 0.25, 0.25, 0.25, 0.0, 0.0, 4.0, 1.0) for x in range(4)], "image_id string, y int, x int, va double, vr double, vg double, vb double, bx double, by double, bw double, bh double")
    found = fields._sums(d, spark.createDataFrame([("i", 2, 0.0)], "image_id string, count int, angle double"), "linear")
    assert "POWER(" not in found._jdf.queryExecution().executedPlan().toString().upper()
    s = (np.arange(4) + 0.5) / 4
    assert found.first().parts[0].s == pytest.approx([(s**j).sum() for j in range(5)]) and found.first().parts[0].a == pytest.approx([2.0, s.sum() / 2])


def test_fields_bring_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    """Not when they find the stops, nor when they look at every pixel; an image of several tiles is one image."""
    monkeypatch.setattr(fields, "TILE", 8, raising=False)
    spark.range(3 * 400).selectExpr("id % 3 AS image_id", "int(id / 3) % 20 AS y", "int(id / 60) AS x", "int(id / 60) * 8 + 20 AS r", "7 AS g", "100 AS b", "255 AS a").write.parquet(f"{tmp_path}/pixels")
    pixels = spark.read.parquet(f"{tmp_path}/pixels")
    boxes = pixels.groupBy("image_id").agg(*(F.lit(v).alias(n) for n, v in (("bx", 0.0), ("by", 0.0), ("bw", 20.0), ("bh", 20.0))))
    ran, cut = [], fields.graph.cut
    monkeypatch.setattr(fields.graph, "cut", lambda d: (ran.append(d._jdf.queryExecution().executedPlan().toString()), cut(d))[1])
    found = fields.field(pixels, boxes, "linear", counts=(2,))
    ran.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(ran) == 5 and all("Broadcast" not in p for p in ran)
    assert sorted((r.image_id, r["count"], r.fits, sorted(s.r for s in r.stops)) for r in found.collect()) == [(k, 2, True, [16, 176]) for k in range(3)]
