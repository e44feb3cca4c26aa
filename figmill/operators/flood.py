"""Marker-controlled partition of a pixel support by a bottleneck spanning forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.operators import graph

TILE = 256
PIXELS_A_TASK = 300_000  # up to 60 million pixels are 200 tasks at most, for which Spark writes the shuffle without a sort
PIXEL, INSIDE, ACROSS = 0, 1, 2  # rows of tiles: pixels with their regions, steps between regions, steps that leave the tile


def _mixed(y, x, down: int):
    """A number for the step from a pixel to the right or down, without order, the same in all tiles."""
    v = (y.astype(np.uint64) << np.uint64(33)) ^ ((x & 0xFFFFFFFF).astype(np.uint64) << np.uint64(1)) ^ np.uint64(down)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return v.view(np.int64)


def _joined(a, b, w, h, rank, leaving):
    """(region, bound, a, b, w, h) of pixels after rounds of picks over the steps (a, b, w, h), and the steps that stay.

    `rank` is a seed's place among seeds, or -1; `leaving` is the least step of a pixel out of its tile.  A region whose
    lowest step may lie across the border stays as it is.
    """
    n = len(rank)
    held, leaving = rank >= 0, leaving.copy()
    region, bound = np.arange(n), np.zeros(n, np.int64)
    while True:
        a, b = region[a], region[b]
        stays = (a != b) & ~(held[a] & held[b])
        a, b, w, h = a[stays], b[stays], w[stays], h[stays]
        c, d, wide, mix = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)), np.concatenate((h, h))
        may = np.flatnonzero(~held[c] & (wide < leaving[c]))
        if not len(may):
            return region, bound, a, b, w, h
        c, d, wide, mix = c[may], d[may], wide[may], mix[may]
        by = np.lexsort((mix, np.where(held[d], rank[d], 0), ~held[d], wide, c))
        by = by[np.flatnonzero(np.diff(c[by], prepend=-1))]
        c, d, wide = c[by], d[by], wide[by]
        to, step = np.arange(n), np.zeros(n, np.int64)
        to[c] = d
        ends = (to[d] == c) & (c < d)
        to[c[ends]] = c[ends]
        step[c[~ends]] = wide[~ends]
        bound = np.maximum(bound, step[region])
        while (to != (on := to[to])).any():
            to = on
        np.minimum.at(leaving, to[c], leaving[c])
        region = to[region]


def _tiles(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, y, x, down, ry, rx, w, h, held, ord, owner) of a task's tiles, from pixels and seeds (key, ty, tx, y, x, r, g, b, seed, ord, owner)."""
    batches = list(batches)
    t = pa.Table.from_batches(batches) if batches else None
    if not t:
        return
    col = {c: t.column(c).combine_chunks() for c in t.column_names}
    ranks = pc.rank(col["ord"], sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    seed = col["seed"].to_numpy(zero_copy_only=False)
    lowest = np.iinfo(np.int64).min
    colours = [pc.fill_null(col[c], lowest).to_numpy() for c in "rgb"]
    ty, tx, y, x = (col[c].to_numpy() for c in ("ty", "tx", "y", "x"))
    k = col[key].dictionary_encode().indices.to_numpy()
    row = np.lexsort((*reversed(colours), seed, x, y, tx, ty, k))  # a place's pixels, then its seed
    k, ty, tx, y, x, seed = (v[row] for v in (k, ty, tx, y, x, seed))
    tile = np.cumsum((np.diff(k, prepend=k[0]) != 0) | (np.diff(ty, prepend=ty[0]) != 0) | (np.diff(tx, prepend=tx[0]) != 0))
    wide = size + 3  # a tile with the pixels around it, and a free place between rows
    iy, ix = y - ty * size + size // 2 + 1, x - tx * size + size // 2 + 1
    place = (tile * wide + iy) * wide + ix
    one = np.flatnonzero(~seed & (np.diff(place, prepend=-1) != 0))
    at, n = place[one], len(one)
    if not n:
        return
    first = np.searchsorted(at, place[seed])
    on = at[np.minimum(first, n - 1)] == place[seed]
    source, rank = np.full(n, -1), np.full(n, -1)
    source[first[on]] = row[seed][on]
    rank[first[on]] = ranks[row[seed][on]]
    y, x, iy, ix, source_row = y[one], x[one], iy[one], ix[one], row[one]
    own = (iy > 0) & (iy <= size) & (ix > 0) & (ix <= size)
    steps = []
    for down, ahead in enumerate((1, wide)):
        j = np.minimum(np.searchsorted(at, at + ahead), n - 1)
        i = np.flatnonzero((at[j] == at + ahead) & (own | own[j]))
        j, w = j[i], np.full(len(i), -1)  # -1: no channel in common, which comes before any difference
        for c in colours:
            p, q = c[source_row[i]], c[source_row[j]]
            w = np.where((p != lowest) & (q != lowest), np.maximum(w, np.abs(p - q)), w)
        steps.append((i, j, w, _mixed(y[i], x[i], down), np.full(len(i), down)))
    i, j, w, h, down = (np.concatenate(v) for v in zip(*steps, strict=True))
    across = own[i] != own[j]
    leaving = np.full(n, np.iinfo(np.int64).max)
    mine = np.where(own[i], i, j)[across]
    np.minimum.at(leaving, mine, w[across])
    region, bound, a, b, low, mix = _joined(i[~across], j[~across], w[~across], h[~across], rank, leaving)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((mix, low, hi, lo))
    by = by[(np.diff(lo[by], prepend=-1) != 0) | (np.diff(hi[by], prepend=-1) != 0)]
    names = [key, "kind", "y", "x", "down", "ry", "rx", "w", "h", "held", "ord", "owner"]
    pixel, seedless = np.flatnonzero(own), lambda v: pa.array(source[v], mask=source[v] < 0)
    for kind, p, to, width, mark, way in ((PIXEL, pixel, region[pixel], bound[pixel], None, None), (INSIDE, lo[by], hi[by], low[by], mix[by], None), (ACROSS, i[across], region[mine], w[across], h[across], down[across])):
        m = len(p)
        zero = np.zeros(m, np.int64)
        said = seedless(to) if kind == PIXEL else pa.nulls(m, pa.int64())
        numbers = [np.full(m, kind), y[p], x[p], zero if way is None else way, y[to], x[to], width, zero if mark is None else mark]
        yield pa.RecordBatch.from_arrays([col[key].take(pa.array(source_row[p])), *map(pa.array, numbers), pa.array(rank[to] >= 0), col["ord"].take(said), col["owner"].take(said)], names)


def _picks(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(c, d, w): the step that each region without an owner takes, to region d."""
    both = edges.select(F.col("a").alias("c"), F.col("b").alias("d"), "w", "h").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("d"), "w", "h"))
    free = both.join(owners.select(F.col("id").alias("c")), "c", "left_anti").join(owners.select(F.col("id").alias("d"), "ord", F.lit(0).alias("held")), "d", "left")
    order = F.struct("w", F.col("held").isNull().alias("free"), "ord", "h", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"))
    return free.groupBy("c").agg(F.min(F.struct(order.alias("o"), "d")).alias("m")).select("c", "m.d", F.col("m.o.w").alias("w"))


def _roots(picks: DataFrame) -> DataFrame:
    """(c, root, w): where the chain of each region's picks ends, by pointers of doubling length.

    Along a chain the steps never rise, so only two regions can pick each other; the smaller of them is a root.
    """
    back = picks.select(F.col("c").alias("d"), F.col("d").alias("back"))
    chain = graph.cut(picks.join(back, "d", "left").filter(~F.coalesce((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.lit(False))).select("c", F.col("d").alias("root"), "w"))
    while True:
        for _ in range(2):
            on = chain.select(F.col("c").alias("root"), F.col("root").alias("next"))
            chain = chain.join(on, "root", "left").select("c", F.coalesce("next", "root").alias("root"), "w", F.col("next").isNotNull().alias("moved"))
        chain = graph.cut(chain)
        if chain.filter("moved").isEmpty():
            return chain.drop("moved")
        chain = chain.drop("moved")


def partition(pixels: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, y, x, owner, step) of every support pixel (key, y, x, r, g, b), from seeds (key, ord, owner, y, x).

    A pixel goes to a seed that reaches it over 4-neighbours with the least highest colour step (the largest
    channel difference), which is `step`.  Where several seeds do, regions decide: one without a seed joins over
    its lowest step, and among equal ones to an owned region before others, of those the one of the first seed
    (`ord`), else over the edge of the least hash.  Pixels that no seed reaches have a null owner and step; a seed
    outside the support or on an earlier one is ignored, and of repeated pixels one counts.  Rows with a null key or
    place are left out.

    Regions join within tiles of TILE by TILE first, as long as their lowest step is inside; tiles are dealt by the number
    of pixels.  What is left of all images joins at once, in rounds: a step that a region must take to leave is a bound for
    its pixels, and the picked steps reach it.  Regions and edges shrink by half a round at least.
    """
    at, kind = [key, "y", "x"], {f.name: f.dataType.simpleString() for f in (*seeds.schema, *pixels.schema)}
    places, none = [F.col(c).cast("long").alias(c) for c in ("y", "x")], lambda c: F.lit(None).cast(kind[c]).alias(c)
    p = pixels.dropna(subset=at).select(key, *places, *(F.col(c).cast("long").alias(c) for c in "rgb"), F.lit(False).alias("seed"), none("ord"), none("owner"))
    first = seeds.dropna(subset=at).groupBy(*at).agg(F.min(F.struct("ord", "owner")).alias("s")).select(F.col(key).cast(kind[key]).alias(key), *places, *(F.lit(None).cast("long").alias(c) for c in "rgb"), F.lit(True).alias("seed"), "s.ord", "s.owner")
    tile, within = (lambda c: F.floor((F.col(c) + TILE // 2) / TILE)), (lambda c: F.pmod(F.col(c) + TILE // 2, F.lit(TILE)))  # an image that begins at 0 ends no tile there
    beside = lambda dy, dx: F.struct((tile("y") + dy).alias("ty"), (tile("x") + dx).alias("tx"))
    around = [F.when(within(c) == edge, beside(*way)) for c, edge, way in (("y", 0, (-1, 0)), ("y", TILE - 1, (1, 0)), ("x", 0, (0, -1)), ("x", TILE - 1, (0, 1)))]
    both = p.withColumn("t", F.explode(F.array_compact(F.array(beside(0, 0), *around)))).unionByName(first.withColumn("t", beside(0, 0)))
    n, size = graph.tasks(pixels.count(), PIXELS_A_TASK), TILE
    schema = f"`{key}` {kind[key]}, kind long, y long, x long, down long, ry long, rx long, w long, h long, held boolean, ord {kind['ord']}, owner {kind['owner']}"
    dealt = both.select(key, "t.ty", "t.tx", "y", "x", *"rgb", "seed", "ord", "owner").repartition(n, key, "ty", "tx").dropDuplicates()  # repeats leave before they are held together
    tiles = graph.cut(dealt.mapInArrow(lambda batches: _tiles(batches, key, size), schema))
    spot = lambda y, x: F.struct(F.col(key).alias("key"), F.col(y).alias("y"), F.col(x).alias("x"))
    inside = tiles.filter(F.col("kind") == INSIDE).select(spot("y", "x").alias("a"), spot("ry", "rx").alias("b"), "w", "h")
    across = tiles.filter(F.col("kind") == ACROSS).groupBy(*at, "down").agg(*(f(spot("ry", "rx")).alias(c) for c, f in (("a", F.min), ("b", F.max))), F.min("w").alias("w"), F.min("h").alias("h"), F.bool_and("held").alias("held")).filter("NOT held").drop("held")
    edges, rounds = graph.cut(inside.unionByName(across.select("a", "b", "w", "h")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "h")), []
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    owned = tiles.filter((F.col("kind") == PIXEL) & F.col("held") & (F.col("y") == F.col("ry")) & (F.col("x") == F.col("rx"))).select(spot("y", "x").alias("id"), "ord", "owner")
    owners = graph.cut(owned.join(graph.dealt(ends), "id", "left_semi"))
    while not edges.isEmpty():
        roots = _roots(_picks(edges, owners))
        rounds.append(roots)
        for end in ("a", "b"):
            edges = edges.join(roots.select(F.col("c").alias(end), F.col("root").alias(f"{end}_")), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        open_ = edges.filter("a <> b").join(owners.select(F.col("id").alias("a"), F.lit(1).alias("ha")), "a", "left").join(owners.select(F.col("id").alias("b"), F.lit(1).alias("hb")), "b", "left").filter("ha IS NULL OR hb IS NULL")
        joined = open_.select(lo.alias("a"), hi.alias("b"), "w", "h").groupBy("a", "b").agg(F.min(F.struct("w", "h")).alias("m")).select("a", "b", "m.w", "m.h")
        edges = graph.cut(joined)
    found = owners.select("id", "owner", F.lit(0).cast("long").alias("step"))
    for roots in reversed(rounds):
        more = roots.join(found.withColumnRenamed("id", "root"), "root").select(F.col("c").alias("id"), "owner", F.greatest("w", "step").alias("step"))
        found = graph.cut(found.unionByName(more))
    rows = tiles.filter(F.col("kind") == PIXEL)
    rest = rows.filter("NOT held").select(*at, "w", spot("ry", "rx").alias("id")).repartition(n, "id").join(graph.dealt(found.repartition(n, "id")), "id", "left")
    out = rows.filter("held").select(*at, "owner", F.col("w").alias("step")).unionByName(rest.select(*at, "owner", F.when(F.col("step").isNotNull(), F.greatest("w", "step")).alias("step")))
    return out.select(key, *(F.col(c).cast(kind[c]).alias(c) for c in ("y", "x")), "owner", "step")


def issues(pixels: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, rule, n): seeds that lie on another one or off the support, and pixels that no seed reaches."""
    at = [key, "y", "x"]
    twice = seeds.groupBy(*at).agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0").groupBy(key).agg(F.sum("n").alias("n"))
    off = seeds.join(pixels.select(*at).distinct(), at, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    alone = partition(pixels, seeds, key).filter("owner is null").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    row = lambda d, rule: d.select(key, F.lit(rule).alias("rule"), "n")
    return row(twice, "repeated seed").unionByName(row(off, "seed off the support")).unionByName(row(alone, "pixels without owner"))
