"""Sparse pixel masks (image_id, y, x): selection, set measures, boundaries, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.operators import graph

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))
SPAN = 1 << 31
TILE = 64


def select(pixels: DataFrame, ranges: dict[str, tuple[int, int]], differences: list[tuple[str, str, int, int]] = ()) -> DataFrame:
    """Pixels whose channels, over white, are inside inclusive ranges, as are the signed differences (a, b, least, most)."""
    if len(differences) > 6:
        raise ValueError("at most six differences")
    over = {c: F.bround((F.col(c) * F.col("a") + 255 * (255 - F.col("a"))) / 255).cast("int") for c in "rgb"}
    test = F.lit(True)
    for c, (lo, hi) in ranges.items():
        test &= over[c].between(lo, hi)
    for p, q, lo, hi in differences:
        test &= (over[p] - over[q]).between(lo, hi)
    return pixels.filter(test).select("image_id", "y", "x")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per image: both, either, iou, missing (in a only), extra (in b only) pixels."""
    keys = ["image_id", "y", "x"]
    j = a.select(*keys, F.lit(1).alias("a_")).join(b.select(*keys, F.lit(1).alias("b_")), keys, "full")
    g = j.groupBy("image_id").agg(F.count_if(F.col("a_").isNotNull() & F.col("b_").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"), F.count_if(F.col("b_").isNull()).alias("missing"), F.count_if(F.col("a_").isNull()).alias("extra"))
    return g.withColumn("iou", F.col("both") / F.col("either"))


def set_iou(df: DataFrame, kind: str, member: str) -> DataFrame:
    """(a, b, n_both, n_either, iou) of the member sets of each two kinds.  Counts meet; members don't multiply beyond the kinds they have."""
    s = df.select(F.col(kind).alias("k"), F.col(member).alias("m")).filter("k is not null").distinct()
    n = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    i = s.select(F.col("k").alias("a"), "m").join(s.select(F.col("k").alias("b"), "m"), "m").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = n.select(F.col("k").alias("a"), F.col("n").alias("na")).join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = F.coalesce("n_both", F.lit(0))
    return pairs.join(i, ["a", "b"], "left").select("a", "b", both.alias("n_both"), (F.col("na") + F.col("nb") - both).alias("n_either"), (both / (F.col("na") + F.col("nb") - both)).alias("iou"))


def boundary(mask: DataFrame) -> DataFrame:
    """Pixels that lack one of their four neighbours."""
    around = mask.select("image_id", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in FOUR))).alias("p")).select("image_id", "p.*")
    full = around.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).filter("n = 4")
    return mask.select("image_id", "y", "x").join(full, ["image_id", "y", "x"], "left_anti")


def _linked(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Tiles with `part`, each cell's number among the connected parts within its tile, and `heads`, the first cell of each part; cells come in row order."""
    wide = TILE + 2
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            lists = b.column("cells")
            n, sizes, v = len(b), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            code = np.sort(np.repeat(np.arange(n) * wide * wide, sizes) + (v // TILE + 1) * wide + v % TILE + 1)
            spot = np.full(n * wide * wide, -1)
            spot[code] = np.arange(len(code))
            ends = [(np.flatnonzero(far >= 0), far[far >= 0]) for far in (spot[code + dy * wide + dx] for dy, dx in steps)]
            p, q = (np.concatenate(e) for e in zip(*ends, strict=True))
            root = np.arange(len(code))
            while True:  # the larger root goes under the smaller one, so a part's root is its first cell
                lo, hi = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
                open_ = lo < hi
                if not open_.any():
                    break
                p, q = p[open_], q[open_]
                root[hi[open_]] = lo[open_]
                while not np.array_equal(up := root[root], root):
                    root = up
            tile, rest = code // (wide * wide), code % (wide * wide)
            cell = ((rest // wide - 1) * TILE + rest % wide - 1).astype(np.int32)
            heads = np.flatnonzero(root == np.arange(len(code)))
            first = np.searchsorted(heads, np.concatenate([[0], np.cumsum(sizes)]))  # where each tile's heads begin
            part = (np.searchsorted(heads, root) - first[tile]).astype(np.int32)
            whole = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_id", "ty", "tx")), listed(whole, cell), listed(whole, part), listed(first, cell[heads])], ["image_id", "ty", "tx", "cells", "part", "heads"])


def regions(mask: DataFrame, eight: bool = False) -> DataFrame:
    """(image_id, y, x, label): connected parts, numbered from 1 in the row-major order of their first pixels.  Rows with a null place are left out.

    Pixels are joined within tiles of TILE by TILE first, whatever an image's size; only parts of neighbouring tiles that touch
    across their edge go on to the graph.
    """
    steps = [s for s in (EIGHT if eight else FOUR) if s > (0, 0)]
    tile, within = lambda c: F.floor(F.col(c) / TILE), lambda c: F.pmod(F.col(c), F.lit(TILE))
    tiles = mask.dropna(subset=["y", "x"]).groupBy("image_id", tile("y").alias("ty"), tile("x").alias("tx")).agg(F.collect_set((within("y") * TILE + within("x")).cast("int")).alias("cells"))
    kind = dict(tiles.dtypes)["image_id"]
    t = graph.cut(tiles.mapInArrow(lambda b: _linked(b, steps), f"image_id {kind}, ty long, tx long, cells array<int>, part array<int>, heads array<int>"))
    y, x = (lambda c: F.col("ty") * TILE + F.floor(c / TILE)), (lambda c: F.col("tx") * TILE + c % TILE)
    place = lambda c: F.struct("image_id", (y(c) * SPAN + x(c)).alias("p"))
    # pixels at the edges of tiles, and those of the next tile that they touch
    last = TILE - 1
    rim = t.select("image_id", "ty", "tx", "heads", F.inline(F.filter(F.arrays_zip("cells", "part"), lambda c: (c["cells"] % TILE).isin(0, last) | F.floor(c["cells"] / TILE).isin(0, last))))
    rim = rim.select("image_id", y(F.col("cells")).alias("y"), x(F.col("cells")).alias("x"), place(F.get("heads", F.col("part"))).alias("id"))
    over = F.filter(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps)), lambda p: (F.floor(p["y"] / TILE) != tile("y")) | (F.floor(p["x"] / TILE) != tile("x")))
    asked = rim.select("image_id", F.col("id").alias("a"), F.inline(over))
    edges = asked.join(graph.dealt(rim.withColumnRenamed("id", "b")), ["image_id", "y", "x"]).select("a", "b").distinct()
    found = graph.components(edges)
    from pyspark.sql import Window

    roots = t.select("image_id", "ty", "tx", F.posexplode("heads").alias("k", "head")).withColumn("id", place(F.col("head")))
    roots = roots.join(graph.dealt(found), "id", "left").withColumn("label", F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.coalesce("component.p", "id.p"))))
    labels = roots.groupBy(F.col("image_id").alias("image"), F.col("ty").alias("ty_"), F.col("tx").alias("tx_")).agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("labels"))
    same = F.col("image_id").eqNullSafe(F.col("image")) & (F.col("ty") == F.col("ty_")) & (F.col("tx") == F.col("tx_"))
    out = t.join(graph.dealt(labels), same).select("image_id", "ty", "tx", "labels", F.inline(F.arrays_zip("cells", "part")))
    kinds = dict(mask.dtypes)
    return out.select("image_id", y(F.col("cells")).cast(kinds["y"]).alias("y"), x(F.col("cells")).cast(kinds["x"]).alias("x"), F.get("labels", F.col("part"))["label"].alias("label"))


def region_stats(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Area, box and whether the edge of the image is touched."""
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    return labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.bool_or(edge).alias("touches_border"))


def largest(stats: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n rows (keys, label, area, ...) of greatest area of each key, the smaller label first on ties."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "label"))
    return stats.withColumn("place", place).filter(F.col("place") <= n)


def complement(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels of each image's frame that its mask lacks, row by row."""
    rows = mask.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    held = mask.groupBy("image_id", "y").agg(F.collect_set(F.col("x").cast("int")).alias("held"))
    every = F.sequence(F.lit(0), F.lit(width - 1))
    return rows.join(graph.dealt(held), ["image_id", "y"], "left").select("image_id", "y", F.explode(F.array_except(every, F.coalesce("held", F.array().cast("array<int>")))).alias("x"))


def topology(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Per image: eight-connected parts, and four-connected holes that don't touch the border."""
    mask = graph.cut(mask.select("image_id", "y", "x"))
    parts = regions(mask, eight=True).groupBy("image_id").agg(F.max("label").cast("long").alias("parts"))
    holes = region_stats(regions(complement(mask, height, width)), height, width).filter("not touches_border").groupBy("image_id").agg(F.count(F.lit(1)).alias("holes"))
    return parts.join(holes, "image_id", "left").select("image_id", "parts", F.coalesce("holes", F.lit(0)).alias("holes"))
