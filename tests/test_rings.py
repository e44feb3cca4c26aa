"""Rings of masks against walking their outlines."""

import random

import pytest

from figmill.operators import rings


def walked(cells):
    """The outlines as sets of starts in order, by a plain walk: right turns first."""
    ways = {}
    for y, x in cells:
        for k, ((ay, ax, by, bx), (oy, ox)) in enumerate(zip(rings.SIDES, rings.BESIDE)):
            if (y + oy, x + ox) not in cells:
                ways[y + ay, x + ax, k] = (y + by, x + bx)
    out, seen = [], set()
    for at in sorted(ways):
        if at not in seen:
            ring, here = [], at
            while here not in seen:
                seen.add(here)
                ring.append(here)
                y, x = ways[here]
                here = next((y, x, (here[2] + t) % 4) for t in (1, 0, 3) if (y, x, (here[2] + t) % 4) in ways)
            out.append([(y, x) for y, x, _ in ring])
    return sorted(out)


SHAPES = {
    "dot": {(0, 0)},
    "ring": {(y, x) for y in range(5) for x in range(5)} - {(2, 2), (2, 3)},
    "touching": {(0, 0), (1, 1), (2, 0)},
    "bar": {(3, x) for x in range(-40, 60)},
    "random": {(y, x) for y in range(20) for x in range(20) if random.Random(100 * y + x).random() < 0.55},
}


@pytest.mark.parametrize("keys", [["k"], ["k", "label"]])
def test_rings(spark, keys):
    rows = [(k, 7, y, x) for k, cells in SHAPES.items() for y, x in cells]
    d = spark.createDataFrame(rows + rows[:3], "k string, label int, y int, x int").repartition(3)
    found = rings.rings(d, keys)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault((r.k, r.ring), []).append((r.y, r.x, r.corner))
    for k, cells in SHAPES.items():
        mine = sorted([(y, x) for y, x, _ in v] for (n, _), v in got.items() if n == k)
        assert mine == walked(cells)
    for v in got.values():
        way = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(v, v[1:] + v[:1])]
        assert [c for _, _, c in v] == [way[i] != way[i - 1] for i in range(len(v))]
    total = {}
    for r in rings.areas(found, keys).collect():
        total[r.k] = total.get(r.k, 0) + r.area
    assert total == {k: len(c) for k, c in SHAPES.items()}


def test_nothing(spark):
    assert rings.rings(spark.createDataFrame([], "k string, y int, x int"), ["k"]).collect() == []


def test_rings_within_tiles_need_no_rounds(spark, monkeypatch):
    """Rings of one tile are whole at once; those over tiles, with rows below zero, are ranked by chains."""
    seen, plain = [], rings._ranked
    monkeypatch.setattr(rings, "_ranked", lambda on: (seen.append(on.count()), plain(on))[1])
    rnd = random.Random(4)
    cells = {(y, x) for y in range(-70, 70) for x in range(-5, 140) if rnd.random() < 0.6}
    for shape, rounds in (({(y, x) for y, x in cells if 0 <= y < 60 and 0 <= x < 60}, False), (cells, True)):
        seen.clear()
        got = {}
        for r in sorted(rings.rings(spark.createDataFrame([("i", *c) for c in shape], "k string, y int, x int"), ["k"]).collect(), key=lambda r: r.place):
            got.setdefault(r.ring, []).append((r.y, r.x, r.y1, r.x1, r.corner))
        assert sorted([v[:2] for v in ring] for ring in got.values()) == walked(shape)
        for v in got.values():
            assert all(a[2:4] == b[:2] for a, b in zip(v, v[1:] + v[:1]))
            way = [(a[2] - a[0], a[3] - a[1]) for a in v]
            assert [a[4] for a in v] == [way[i] != way[i - 1] for i in range(len(v))]
        assert bool(seen) == rounds and (not rounds or seen[0] < sum(map(len, got.values())) / 4)
