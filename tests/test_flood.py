"""The partition's highest steps and owners against a plain search."""

import heapq
import random

import pytest

from figmill.operators import flood


def barriers(cells, start):
    """The least highest step from a place to every cell."""
    best, heap = {start: 0}, [(0, start)]
    while heap:
        high, (y, x) = heapq.heappop(heap)
        if high > best[y, x]:
            continue
        for to in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if to in cells:
                h = max(high, *(abs(a - b) for a, b in zip(cells[to], cells[y, x])))
                if h < best.get(to, 1 << 30):
                    best[to] = h
                    heapq.heappush(heap, (h, to))
    return best


@pytest.mark.parametrize("colours,hole", [(1, 0.0), (3, 0.2), (256, 0.1)])
def test_steps_and_owners(spark, colours, hole):
    rnd = random.Random(colours)
    images, seeds = {}, []
    for image in ("a", "b", "c"):
        images[image] = {(y, x): tuple(rnd.randrange(colours) * 3 for _ in range(3)) for y in range(11) for x in range(13) if rnd.random() >= hole}
        own = rnd.sample(sorted(images[image]), 5) if image != "c" else []
        own += [(y, x + 1) for y, x in own[:1]]  # neighbours, and perhaps off the support
        seeds += [(image, k, f"{image}{k}", y, x) for k, (y, x) in enumerate(own)] + [(image, 99, "late", *c) for c in own[:1]]
    pixels = spark.createDataFrame([(i, y, x, *c) for i, cells in images.items() for (y, x), c in cells.items()] + [(None, 0, 0, 1, 1, 1)], "k string, y int, x int, r int, g int, b int").repartition(3)
    got = {(r.k, r.y, r.x): (r.owner, r.step) for r in flood.partition(pixels, spark.createDataFrame(seeds, "k string, ord int, owner string, y int, x int"), "k").collect()}
    assert got.keys() == {(i, *c) for i, cells in images.items() for c in cells}
    for image, cells in images.items():
        reach = {}
        for k, _, owner, y, x in seeds:
            if k == image and (y, x) in cells and owner != "late":
                for to, high in barriers(cells, (y, x)).items():
                    reach.setdefault(to, {})[owner] = high
        for c in cells:
            owner, step = got[image, *c]
            if c not in reach:
                assert (owner, step) == (None, None)
            else:
                least = min(reach[c].values())
                assert step == least and reach[c][owner] == least


@pytest.mark.parametrize("tile,colours", [(4, 10**6), (4, 3), (5, 1)])
def test_tiles_leave_no_trace(spark, monkeypatch, tile, colours):
    monkeypatch.setattr(flood, "TILE", tile)
    monkeypatch.setattr(flood, "PIXELS_A_TASK", 30)
    rnd = random.Random(25)
    cells = {(y, x): tuple(rnd.choice([rnd.randrange(colours), None]) if c else rnd.randrange(colours) for c in range(3)) for y in range(-6, 13) for x in range(-9, 9) if rnd.random() < 0.85}
    cells[0, 0] = (None, None, None)
    own = rnd.sample(sorted(cells), 6)
    seeds = [("i", "abcfed"[k], k if k else None, *c) for k, c in enumerate(own)] + [("i", "zz", 99, *own[0]), ("i", "0", 98, 99, 99), (None, "0", 97, *own[1])]
    rows = [("i", y, x, *c) for (y, x), c in cells.items()]
    even = [("even", y, x, 1, 1, 1) for y, x in ((0, 0), (0, 1), (0, 2), (5, 3), (5, 4), (5, 5))]  # the first seed of two has the pixel between, over a tile's end or not
    seeds += [("even", "b", 1, 0, 0), ("even", "a", 2, 0, 2), ("even", "d", 3, 5, 5), ("even", "c", 4, 5, 3)]
    pixels = spark.createDataFrame(rows + rows[:40] + even + [("empty", 1, 1, 1, 1, 1)], "k string, y int, x long, r int, g int, b int").repartition(3)
    found = flood.partition(pixels, spark.createDataFrame(seeds, "k string, ord string, owner long, y int, x long"), "k")
    assert dict(found.dtypes) == {"k": "string", "y": "int", "x": "bigint", "owner": "bigint", "step": "bigint"}
    got = {(r.k, r.y, r.x): (r.owner, r.step) for r in found.collect()}
    assert got.pop(("empty", 1, 1)) == (None, None) and [got.pop(e[:3]) for e in even] == [(1, 0), (2, 0), (2, 0), (4, 0), (4, 0), (3, 0)] and got.keys() == {("i", *c) for c in cells} and found.count() == len(cells) + 7

    def steps(start):
        best, heap = {start: 0}, [(0, start)]
        while heap:
            high, (y, x) = heapq.heappop(heap)
            for to in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                if to in cells:
                    h = max([high, *(abs(a - b) for a, b in zip(cells[to], cells[y, x]) if a is not None and b is not None)])
                    if h < best.get(to, 1 << 30):
                        best[to] = h
                        heapq.heappush(heap, (h, to))
        return best

    reach = {k if k else None: steps(c) for k, c in enumerate(own)}
    for c in cells:
        owner, step = got["i", *c]
        high = [best[c] for best in reach.values() if c in best]
        assert step == min(high, default=None) and (not high or reach[owner][c] == step)


def test_regions_join_in_tiles_before_rounds(spark, monkeypatch):
    seen, picks = [], flood._picks
    monkeypatch.setattr(flood, "_picks", lambda edges, owners: (seen.append(edges.count()), picks(edges, owners))[1])
    rnd = random.Random(3)
    row = [("i", 0, x, rnd.randrange(10**6), 0, 0) for x in range(3000)]
    seeds = spark.createDataFrame([("i", x, f"o{x}", 0, x) for x in range(5, 3000, 37)], "k string, ord int, owner string, y int, x int")
    found = flood.partition(spark.createDataFrame(row, "k string, y int, x int, r int, g int, b int"), seeds, "k")
    assert found.filter("owner IS NULL").count() == 0
    assert sum(seen) < 200  # of 2999 steps
