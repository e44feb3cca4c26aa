"""Outlines of labelled pixels as closed rings of edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.operators import graph

# The four sides of a pixel run with it on their right: along the top to the right, down, back along the bottom, and up.
SIDES = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))  # where a side begins and ends: y, x, y, x
BESIDE = ((-1, 0), (0, 1), (1, 0), (0, -1))  # the pixel on the other side of each
TILE = 64
WIDE = TILE + 2  # a tile with the pixels around it


def _chained(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (kept, k, least, at, size, end, closed, edges, bends) of tiles' chains of edges, from tiles with the `cells` of their pixels and those around.

    An edge is known by 4 * cell + way, with the cell of its pixel among WIDE by WIDE.  A chain is closed, or ends where the next edge, `end`, is
    that of a pixel around; `k` is its first edge, and `least` its edge of least (y, x, way), `at` steps from the first.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            b = batch.slice(start, 256)
            lists = b.column("cells")
            n, room = len(b), WIDE * WIDE
            held = np.zeros(n * room, bool)
            held[np.repeat(np.arange(n) * room, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
            cell = np.flatnonzero(held)
            y, x = cell % room // WIDE, cell % WIDE
            cell = cell[(y > 0) & (y <= TILE) & (x > 0) & (x <= TILE)]
            ids, nexts, bends = [], [], []
            for way in range(4):  # to the right if the pixel ahead is missing, else straight on, else to the left
                out, ahead = BESIDE[way], BESIDE[(way + 1) % 4]
                out, ahead = out[0] * WIDE + out[1], ahead[0] * WIDE + ahead[1]
                open_ = cell[~held[cell + out]]
                right, left = ~held[open_ + ahead], held[open_ + ahead + out]
                ids.append(4 * open_ + way)
                nexts.append(np.where(right, 4 * open_ + (way + 1) % 4, np.where(left, 4 * (open_ + ahead + out) + (way + 3) % 4, 4 * (open_ + ahead) + way)))
                bends.append(~held[open_ - ahead] | held[open_ - ahead + out])  # where the edge before it has another way
            ids, nexts, bends = (np.concatenate(v) for v in (ids, nexts, bends))
            order = np.argsort(ids)
            ids, nexts, bends = ids[order], nexts[order], bends[order]
            if not len(ids):
                continue
            m = len(ids)
            spot = np.full(4 * n * room, m)
            spot[ids] = np.arange(m)
            to = np.append(spot[nexts], m)  # m: out of the tile
            # the least edge of each, in the order of (y, x, way) of starts
            row, col, way = ids // 4 % room // WIDE, ids // 4 % WIDE, ids % 4
            begins = np.array(SIDES)[:, :2]
            value = np.append((((ids // 4 // room * (WIDE + 1) + row + begins[way, 0]) * (WIDE + 1) + col + begins[way, 1]) * 4 + way), np.iinfo(np.int64).max)
            least, step = value.copy(), to.copy()
            for _ in range(max(1, math.ceil(math.log2(m + 1)))):
                least = np.minimum(least, least[step])
                step = step[step]
                if (step == m).all():
                    break
            loop = step[:m] != m
            # rings are cut before their least edge; then steps to the end by pointers of doubling length
            on = np.where(loop, np.where(value[to[:m]] == least[:m], m, to[:m]), to[:m])
            left_, far = np.append((on != m).astype(np.int64), 0), np.append(on, m)
            while (far[:m] != m).any():
                left_ += left_[far]
                far = far[far]
            tail = np.append(np.arange(m), m)
            jump = np.append(on, m)
            while (jump[:m] != m).any():
                tail[:m] = np.where(jump[:m] != m, tail[jump[:m]], tail[:m])
                jump = jump[jump]
            by = np.lexsort((-left_[:m], tail[:m]))
            heads = np.flatnonzero(np.diff(tail[:m][by], prepend=-1))
            sizes = np.diff(heads, append=m)
            first = by[heads]
            least_of = np.minimum.reduceat(value[by], heads)
            at = np.flatnonzero(value[by] == np.repeat(least_of, sizes)) - heads
            which = by[heads + at]
            local = lambda e: (e % (4 * room)).astype(np.int32)
            offsets = pa.array(np.append(heads, m).astype(np.int32))
            tile = pa.array(ids[first] // 4 // room)
            listed = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v))
            columns = {"k_": pa.array(local(ids[first])), "least_": pa.array(local(ids[which])), "at_": pa.array(at.astype(np.int64)), "size_": pa.array(sizes.astype(np.int64)), "end_": pa.array(local(nexts[by[heads + sizes - 1]])), "closed_": pa.array(loop[first]), "edges_": listed(local(ids[by])), "bends_": listed(bends[by])}
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(tile) for c in kept), *columns.values()], [*kept, *columns])


def _edge(e) -> dict:
    """Pixel, way and start of an edge of a tile (ty, tx)."""
    cell, way = F.floor(e / 4), e % 4
    y, x = F.col("ty") * TILE + F.floor(cell / WIDE) - 1, F.col("tx") * TILE + cell % WIDE - 1
    return {"py": y, "px": x, "way": way, "y": y + way.isin(2, 3).cast("int"), "x": x + way.isin(1, 2).cast("int")}


def rings(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, place, y, x, corner, y1, x1) of the outlines of pixels (keys, y, x): their edges in order, each by its start, and its end.

    Every key's pixels are one support, whose parts touch by sides only: where two meet at a point, each outline
    keeps to its own.  Outer rings run with the support on their right, so that the shoelace sum of x*y' - x'*y, halved, is
    their area, and holes run the other way and count against it; over all rings of a key it is the number of pixels.
    place counts from the ring's edge of least (y, x, way); `corner` tells where the way changes.  Edges are joined to chains
    within tiles of TILE by TILE first, whatever an image's size; only chains that leave their tile are ranked, by pointers of
    doubling length, so a ring is never one task.
    """
    p = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    tile = lambda c: F.floor(c / TILE)
    span = lambda c: F.sequence(tile(F.col(c) - 1), tile(F.col(c) + 1))
    over = F.flatten(F.transform(span("y"), lambda ty: F.transform(span("x"), lambda tx: F.struct(ty.alias("ty"), tx.alias("tx")))))
    inner = F.pmod("y", F.lit(TILE)).between(1, TILE - 2) & F.pmod("x", F.lit(TILE)).between(1, TILE - 2)
    own = F.array(F.struct(tile(F.col("y")).alias("ty"), tile(F.col("x")).alias("tx")))
    dealt = p.select(*keys, "y", "x", F.inline(F.when(inner, own).otherwise(over)))
    cell = ((F.col("y") - F.col("ty") * TILE + 1) * WIDE + F.col("x") - F.col("tx") * TILE + 1).cast("int")
    tiles = dealt.groupBy(*keys, "ty", "tx").agg(F.collect_set(cell).alias("cells"))
    kinds, kept = dict(tiles.dtypes), [*keys, "ty", "tx"]
    made = ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), "k_ int, least_ int, at_ long, size_ long, end_ int, closed_ boolean, edges_ array<int>, bends_ array<boolean>"])
    t = graph.cut(tiles.mapInArrow(lambda b: _chained(b, kept), made).withColumn("chain_", F.monotonically_increasing_id()))
    start = lambda c: F.struct(*(v.cast("long").alias(n) for n, v in _edge(F.col(c)).items() if n in ("y", "x", "way")))
    name = lambda c: [v.cast("long").alias(n) for n, v in _edge(F.col(c)).items() if n in ("py", "px", "way")]
    loose = t.filter("NOT closed_")
    heads = loose.select(*keys, *name("k_"), F.col("chain_").alias("next_"))
    ends = loose.select(*keys, *name("end_"), F.col("chain_").alias("id_"), start("least_").alias("l_"), "at_", "size_")
    on = graph.cut(ends.join(graph.dealt(heads), [*keys, "py", "px", "way"]).select(F.col("id_").alias("id"), F.col("next_").alias("next"), F.struct("l_.y", "l_.x", "l_.way", F.col("id_").alias("id")).alias("least"), F.col("at_").alias("at"), F.col("size_").alias("size")))
    placed = t.filter("closed_").select("chain_", F.col("chain_").alias("ring"), F.lit(0).cast("long").alias("begin_"), F.col("size_").alias("whole_"))
    if not on.isEmpty():
        placed = placed.unionByName(_ranked(on))
    out = t.join(graph.dealt(placed), "chain_").select(*keys, "ring", "begin_", "whole_", "ty", "tx", F.posexplode(F.arrays_zip("edges_", "bends_")).alias("k_", "e_"))
    e = _edge(F.col("e_.edges_"))
    to = {"y1": e["py"] + F.col("way_").isin(1, 2).cast("int"), "x1": e["px"] + F.col("way_").isin(0, 1).cast("int")}
    same = dict(pixels.dtypes)
    return out.withColumn("way_", e["way"]).select(*keys, "ring", F.pmod(F.col("begin_") + F.col("k_"), F.col("whole_")).alias("place"), *(e[c].cast(same[c]).alias(c) for c in "yx"), F.col("e_.bends_").alias("corner"), *(v.cast(same[c[0]]).alias(c) for c, v in to.items()))


def _ranked(on: DataFrame) -> DataFrame:
    """(chain_, ring, begin_, whole_) of chains (id, next, least, at, size) that make rings: the place of a chain's first edge, counted from the ring's least one, and the ring's edges."""
    seek = on.select("id", F.col("next").alias("to"), "least")
    while True:
        far = seek.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        new = graph.cut(seek.join(graph.dealt(far), "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")))
        moved = not new.filter("moved").isEmpty()
        seek = new.drop("moved")
        if not moved:
            break
    d = graph.cut(on.drop("least").join(graph.dealt(seek.select("id", F.col("least.id").alias("ring"))), "id"))
    # edges from each chain's first to the ring's end, which is before the first edge of the chain with the least one
    rank = d.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.col("size").alias("left"))
    while not rank.filter("`to` IS NOT NULL").isEmpty():
        far = rank.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        rank = graph.cut(rank.join(graph.dealt(far), "to", "left").select("id", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    size = d.groupBy("ring").agg(F.sum("size").alias("whole"), F.max(F.when(F.col("id") == F.col("ring"), F.col("at"))).alias("least_at"))
    return d.join(graph.dealt(rank.select("id", "left")), "id").join(graph.dealt(size), "ring").select(F.col("id").alias("chain_"), "ring", (F.col("whole") - F.col("left") - F.col("least_at")).alias("begin_"), F.col("whole").alias("whole_"))


def areas(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, edges, corners, area) of rings(): an outer ring's area is that of what it surrounds, a hole's the same below zero."""
    return found.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("edges"), F.count_if("corner").alias("corners"), (F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2).alias("area"))
