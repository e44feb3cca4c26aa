import random

import numpy as np

from figmill.operators import fits, flood, scenes


def test_paint_order(spark):
    nodes = [("s", "a", 5, 0), ("s", "b", 1, 1), ("s", "c", 1, 2), ("s", "d", 0, 3), ("t", "a", 0, 0), ("t", "b", 0, 1), ("u", "a", 0, 0)]
    edges = [("s", "a", "b"), ("s", "a", "b"), ("t", "a", "b"), ("t", "b", "a"), ("u", "a", "z"), ("v", "a", "b")]
    n, e = spark.createDataFrame(nodes, "k string, id string, z int, rank int"), spark.createDataFrame(edges, "k string, below string, above string")
    got = scenes.paint_order(n, e, "k")
    rows = {(r.k, r.id): (r.position, r.reason) for r in got.collect()}
    assert [rows["s", i][0] for i in "dcab"] == [0, 1, 2, 3]
    assert rows["t", "a"] == (None, "circle") and rows["u", "a"] == (None, "unknown node") and len(rows) == 7
    m = spark.createDataFrame([("s", "g", "c"), ("s", "g", "a"), ("s", "h", "d"), ("s", "h", "a"), ("s", "i", "nope")], "k string, group string, id string")
    assert {r.group: (r.members, r.first, r.contiguous) for r in scenes.contiguous(m, got, "k").collect()} == {"g": (2, 1, True), "h": (2, 0, False), "i": (1, None, False)}
    assert scenes.paint_order(n.limit(0), e.limit(0), "k").count() == 0


def test_runs_of_groups(spark):
    d = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a")], "k string, position int, g string")
    assert sorted((r.g, r["first"], r["last"]) for r in scenes.group_runs(d, "k", "g").collect()) == [("a", 0, 1), ("a", 3, 3), ("b", 2, 2)]


def test_enclosing_scopes(spark):
    r = random.Random(3)
    rows = [(d, i, r.randrange(5), r.random() < 0.5) for d in "xy" for i in range(60)]
    got = {(x.k, x.ord): x.parent for x in scenes.enclosing(spark.createDataFrame(rows, "k string, ord int, level int, opens boolean"), "k").collect()}
    for d, i, level, _ in rows:
        own = [x for x in rows if x[0] == d and x[1] < i]
        open_ = [x[1] for x in own if x[3] and x[2] < level and all(y[2] > x[2] for y in own if y[1] > x[1])]
        assert got[d, i] == max(open_, default=None)


def test_partition_has_the_least_barrier(spark):
    r = random.Random(5)
    cells = {(y, x): r.randrange(4) * 20 for y in range(7) for x in range(7) if r.random() < 0.85}
    start = {**{k: i for i, k in enumerate(sorted(cells)[::13])}}
    seeds = [("i", i, f"o{i}", y, x) for (y, x), i in start.items()] + [("i", 99, "out", 50, 50)]
    p = spark.createDataFrame([("i", y, x, v, 0, 0) for (y, x), v in cells.items()], "k string, y int, x int, r int, g int, b int")
    got = {(x.y, x.x): x.owner for x in flood.partition(p, spark.createDataFrame(seeds, "k string, ord int, owner string, y int, x int"), "k").collect()}
    assert got.keys() == cells.keys()
    reach = {k: {} for k in cells}  # barrier and length of each seed's best way, by relaxation
    for k, i in start.items():
        best = {k: (0, 0)}
        for _ in range(200):
            for (y, x), (h, n) in list(best.items()):
                for to in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                    if to in cells:
                        best[to] = min(best.get(to, (999, 0)), (max(h, abs(cells[to] - cells[y, x])), n + 1))
        for to, (h, _) in best.items():
            reach[to][f"o{i}"] = h
    for k, owner in got.items():
        assert (owner is None) == (not reach[k]) and (owner is None or reach[k][owner] == min(reach[k].values()))


def test_bounded_least_squares(spark):
    rng = np.random.default_rng(2)
    a = rng.random((200, 3))
    want = {"in": np.array([0.2, 0.9, 0.5]), "edge": np.array([1.5, -0.4, 0.3])}
    rows = [(g, *map(float, x), float(x @ w)) for g, w in want.items() for x in a] + [("none", None, 1.0, 1.0, 1.0), ("in", 1.0, 1.0, 1.0, None)]
    got = {r.g: r for r in fits.bounded(spark.createDataFrame(rows, "g string, a double, b double, c double, y double"), ["g"], ["a", "b", "c"], "y").collect()}
    assert np.allclose(got["in"]["values"], want["in"]) and got["in"].n == 200 and got["in"].converged
    assert got["none"]["values"] is None
    v, grid = np.array(got["edge"]["values"]), np.linspace(0, 1, 21)
    loss = lambda w: ((a @ (np.array(w) - want["edge"])) ** 2).sum()
    assert loss(v) <= min(loss((x, y, z)) for x in grid for y in grid for z in grid) + 1e-9 and v.min() >= 0 and v.max() <= 1
