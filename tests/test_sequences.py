"""Enclosing scopes, peak suppression and circles against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from figmill.operators import graph, scenes, series


def scopes_by_hand(rows):
    out, stack = {}, {}
    for k, at, level, opens in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        s = stack.setdefault(k, [])
        while s and s[-1][0] >= level:
            s.pop()
        out[k, at] = s[-1][1] if s else None
        if opens:
            s.append((level, at))
    return out


@pytest.mark.parametrize("depth,opening", [(3, 0.9), (40, 0.3), (2000, 0.05)])
def test_scopes(spark, depth, opening):
    rnd = random.Random(depth)
    rows = [(k, 3 * i - 50, rnd.randrange(depth), rnd.random() < opening) for k, n in (("x", 9000), (None, 70), ("y", 1), ("z", 64)) for i in range(n)]
    rows += [("falling", i, 400 - i, i == 0) for i in range(300)] + [("rising", i, i, i % 50 == 0) for i in range(5000)]
    rnd.shuffle(rows)
    d = scenes.enclosing(spark.createDataFrame(rows, "k string, ord int, level int, opens boolean").repartition(5), "k")
    got = d.collect()
    assert len(got) == len(rows) and {(r.k, r.ord): r.parent for r in got} == scopes_by_hand(rows)
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()


def test_no_scopes(spark):
    assert scenes.enclosing(spark.createDataFrame([], "k string, ord int, level int, opens boolean"), "k").collect() == []


@pytest.mark.parametrize("apart", [0.0, 0.5, 7.0])
def test_suppression_is_greedy(spark, apart):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([float(rnd.randrange(60)), rnd.uniform(0, 60)]), float(rnd.randrange(6))) for k in "ab" for _ in range(120)]
    rows += [("ramp", 0.3 * i, float(i)) for i in range(20)] + [("c", None, 1.0), ("c", 1.0, None)]
    got = {}
    for r in series.suppress(spark.createDataFrame(rows, "k string, x double, prominence double"), ["k"], "x", apart).collect():
        assert (r.k, r.x) not in got
        got[r.k, r.x] = r.prominence
    want = {}
    for k in ("a", "b", "ramp"):
        for _, x, p in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if all(abs(x - y) >= apart for c, y in want if c == k) and (k, x) not in want:
                want[k, x] = p
    assert got == want


def test_circles(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(100, 101), (101, 102), (102, 100), (102, 110), (110, 111), (111, 110), (120, 120), (130, 131)]
    got = {r.id: r.circle for r in graph.on_circles(spark.createDataFrame([*edges, (None, 1)], "a int, b int")).collect()}
    reach = {n: {n} for e in edges for n in e}
    step = {n: {b for a, b in edges if a == n} for n in reach}
    for n in reach:
        todo, seen = list(step[n]), set()
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += step[m]
        reach[n] = seen
    want = {n: max(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}
    assert got == want and {100, 110, 120} <= set(got)
    assert graph.on_circles(spark.createDataFrame([], "a int, b int")).collect() == []
