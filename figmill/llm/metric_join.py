"""Embedding near-dedup: an exact metric range join.

Vectors are scaled to length one, where cosine >= t means distance <= r.  Each group of vectors
that may link (equal label and dimension) that is too large for a task is partitioned by pivots of its own: a vector's home is
the cell of its nearest pivot.  A vector also goes to every cell in which it can have a partner:
by the triangle inequality, if x lies at home in cell p, and y within r of x, then
d(y, p) <= d(y, q) + 2r for all pivots q.  (Sharper, and used as well: y is at most r beyond the
plane half-way between p and its own pivot.)  Cells that are still large are partitioned again by
pivots of their own home vectors.  Vectors without any pattern can't be parted so, as each would go to half of the cells:
where some of a cell's rows show that, it stays whole.  Cells join independently, in tiles, and a vector finds all its
partners in its home cell.  In a tile, pivots again and the triangle inequality leave out what can't be near.
Rows carry vectors as the bytes of the input's own type, so a copy is no larger than in the input.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, trimmed
from .components import components

CELL, PIVOTS, TILE, DEAL = 65_536, 256, 65_536, 20_000
SLACK = 1e-6  # distances near zero are off by about 1e-8, taken as they are from squares
GROUP = ["label", "dim", "cell"]
SAME = ["label", "dim", "twin", "twin2"]
ROW = "label long, dim int, cell string, home boolean, id long, weight long, v binary"
_ROW = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.string()), ("home", pa.bool_()), ("id", pa.int64()), ("weight", pa.int64()), ("v", pa.binary())])
_PLAN = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.string()), ("pivot", pa.int32()), ("home", pa.int64()), ("all", pa.int64())])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, as doubles."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _raw(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Vectors of one length, straight from Arrow's buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], kind, len(column) * dim, int(offsets[0])).reshape(len(column), dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * step, step, dtype=np.int32)), pa.py_buffer(x)])


def _scanned(rows: DataFrame, kind: str, with_vector: bool) -> DataFrame:
    """(id, label, dim, twin, twin2[, v]) of rows (id, label, v array): two hashes of the scaled vector, and its bytes; null where a row links with nothing."""
    fields = [("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("twin", pa.int64()), ("twin2", pa.int64())] + [("v", pa.binary())] * with_vector
    schema = pa.schema(fields)

    def run(parts):
        for whole in parts:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n, column = batch.num_rows, batch.column(2)
                lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = column.flatten()
                if values.null_count:
                    values = values.fill_null(float("nan"))
                x = values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # no -0.0
                starts = np.cumsum(lens) - lens
                some = np.flatnonzero(lens > 0)
                fine = np.zeros(n, bool)
                if len(some):
                    fine[some] = np.logical_and.reduceat(np.isfinite(x), starts[some]) & np.logical_or.reduceat(x != 0, starts[some])
                fine &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
                hashes, raw = np.zeros((n, 2), np.int64), [None] * n
                for dim in np.unique(lens[fine]).tolist():
                    mine = np.flatnonzero(fine & (lens == dim))
                    own = x[starts[mine][:, None] + np.arange(dim)]
                    for r, u, o in zip(mine.tolist(), _unit(own), own, strict=True):
                        hashes[r] = np.frombuffer(hashlib.blake2b(u.data, digest_size=16).digest(), np.int64)
                        raw[r] = o.tobytes() if with_vector else None
                out = [batch.column(0), batch.column(1), pa.array(lens.astype(np.int32)), *(pa.array(hashes[:, k], mask=~fine) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * with_vector, schema=schema)

    return rows.mapInArrow(trimmed(run), "id long, label long, dim int, twin long, twin2 long" + ", v binary" * with_vector)


def _runs(batch: pa.RecordBatch, n: int):
    """(key, slice) of the runs of rows with equal first n columns."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in range(n):
        v = batch.column(c).dictionary_encode().indices.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = [*np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        yield tuple(batch.column(c)[a].as_py() for c in range(n)), batch.slice(a, b - a)


def _pivots(rows: DataFrame, big: DataFrame) -> DataFrame:
    """(label, dim, cell, s, k, p) of the big cells: p has `k` vectors at home, those with the smallest hashes.

    At most 2 * PIVOTS candidates, the least of each range of hashes, are collected for a cell.
    """
    h = F.xxhash64("id", "cell")
    bucket = F.pmod(F.shiftrightunsigned(h, 20), F.lit(2 * PIVOTS))
    low = rows.filter("home").join(big.select(*GROUP), GROUP).groupBy(*GROUP, bucket.alias("bucket")).agg(F.min_by("v", h).alias("v"), F.min(h).alias("h"))
    ranked = low.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("h", "v"))).alias("p"))
    return ranked.join(big, GROUP).select(*GROUP, "s", F.col("k"), F.slice(F.col("p.v"), F.lit(1), F.col("k")).alias("p"))


def _placed(rows: DataFrame, big: DataFrame, radius: float, kind: str, plan: bool = False) -> DataFrame:
    """The rows of big cells in the cells of their pivots: at home, and wherever the bounds let them have a partner.

    A cell's rows are dealt to `s` tasks, each of which gets the pivots, one by one, before the rows.  With `plan` only
    the numbers of rows by cell and pivot come, at home and in all.
    """
    null = lambda kind: F.lit(None).cast(kind)
    p = _pivots(rows, big).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(*GROUP, "deal", F.lit(0).alias("kind"), null("boolean").alias("home"), null("long").alias("weight"), F.posexplode("p").alias("id", "v"))
    p = p.select(*GROUP, "deal", "kind", "home", F.col("id").cast("long").alias("id"), "weight", "v")
    r = rows.join(big, GROUP).select(*GROUP, F.pmod(F.xxhash64("id"), "s").cast("int").alias("deal"), F.lit(1).alias("kind"), "home", "id", "weight", "v")

    def run(parts):
        now, held, pivots, apart = None, [], None, None
        for batch in parts:
            for (label, dim, cell, deal, which), own in _runs(batch, 5):
                if not which:
                    if (label, dim, cell, deal) != now:
                        now, held = (label, dim, cell, deal), []
                    held.append(_unit(_raw(own.column(8), dim, kind)))
                    pivots = None
                    continue
                if pivots is None:
                    pivots = np.concatenate(held)
                    apart = np.sqrt(np.maximum(0, ((pivots * pivots).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * pivots @ pivots.T)))
                step = max(1, min(2048, (1 << 25) // (dim * len(pivots))))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    raw = _raw(part.column(8), dim, kind)
                    x = _unit(raw)
                    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))
                    home = d.argmin(1)
                    near = d[np.arange(len(x)), home][:, None]
                    goes = d <= near + 2 * radius + SLACK
                    between = apart[home]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        goes &= np.where(between > SLACK, (d**2 - near**2) / (2 * between), 0) <= radius + SLACK / np.maximum(between, SLACK)
                    goes[np.arange(len(x)), home] = True
                    i, c = np.nonzero(goes)
                    first = part.column(5).to_numpy(zero_copy_only=False)[i]
                    label_, dim_ = (lambda n: (pa.array(np.full(n, label)), pa.array(np.full(n, dim, np.int32))))(len(pivots) if plan else len(i))  # noqa: B023
                    if plan:
                        n = len(pivots)
                        yield pa.RecordBatch.from_arrays([label_, dim_, pa.array([cell] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.bincount(c[first & (c == home[i])], minlength=n)), pa.array(np.bincount(c, minlength=n))], schema=_PLAN)
                        continue
                    cells = pa.array([f"{cell}/{k}" for k in range(len(pivots))]).take(pa.array(c))
                    yield pa.RecordBatch.from_arrays([label_, dim_, cells, pa.array(first & (c == home[i])), part.column(6).take(pa.array(i)), part.column(7).take(pa.array(i)), _binary(raw[i])], schema=_ROW)

    key = [*GROUP, "deal"]
    return p.unionByName(r).repartition(*key).sortWithinPartitions(*key, "kind", "id").mapInArrow(trimmed(run), "label long, dim int, cell string, pivot int, home long, all long" if plan else ROW)


def _partitioned(rows: DataFrame, radius: float, kind: str) -> DataFrame:
    """The rows in cells of at most CELL home vectors, or cells that pivots can't part: their rows would go to half of the new cells, or nearly all be at home in one.

    A part of the rows tells which cells those are; it decides how rows are joined, never which.
    """
    closed = None
    while True:
        sizes = rows.groupBy(*GROUP).agg(F.count_if("home").alias("n"), F.count(F.lit(1)).alias("all")).filter(F.col("n") > CELL)
        sizes = checkpointed(sizes if closed is None else sizes.join(closed, GROUP, "left_anti"))
        if sizes.isEmpty():
            return rows
        big = sizes.select(*GROUP, F.least(F.lit(PIVOTS), F.ceil(F.col("n") * 2 / CELL)).cast("int").alias("k"), F.ceil(F.col("all") / DEAL).cast("int").alias("s"))
        some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, CELL // 1024))) == 0)
        seen = _placed(some, big, radius, kind, plan=True).groupBy(*GROUP, "pivot").agg(F.sum("home").alias("home"), F.sum("all").alias("all"))
        seen = seen.groupBy(*GROUP).agg(F.sum("home").alias("home"), F.max("home").alias("most"), F.sum("all").alias("all"), F.count(F.lit(1)).alias("k"), F.sum("all").alias("went"))
        asked = some.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("asked"))
        parts = checkpointed(seen.join(asked, GROUP).filter((F.col("most") <= 0.9 * F.col("home")) & (F.col("went") * 2 <= F.col("asked") * F.col("k"))).select(*GROUP))
        shut = checkpointed(sizes.select(*GROUP).join(parts, GROUP, "left_anti"))
        closed = shut if closed is None else closed.unionByName(shut)
        if parts.isEmpty():
            return rows
        big = big.join(parts, GROUP)
        rows = checkpointed(rows.join(parts, GROUP, "left_anti").unionByName(_placed(rows, big, radius, kind)))


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[k] and b[k]; every node's parent is its root before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _cells(placed: DataFrame, least: float, radius: float, kind: str) -> DataFrame:
    """Per tile: (id, links, to): the weight of each vector's partners in the tile, and edges that join what the tile links.

    A cell all of whose rows are at home is cut into strips, and a pair of strips is one tile; otherwise strips of home rows meet strips of all.
    """
    strip = F.greatest(F.lit(1), F.floor(F.lit(64 * TILE) / F.greatest(F.lit(64), F.col("dim"))))
    size = placed.groupBy(*GROUP).agg(F.count_if("home").alias("n"), F.count(F.lit(1)).alias("all")).filter("n > 0")
    size = checkpointed(size.select(*GROUP, F.ceil(F.col("n") / strip).cast("int").alias("ni"), F.ceil(F.col("all") / strip).cast("int").alias("nj"), (F.col("n") == F.col("all")).alias("whole")))
    tiles = size.agg(F.sum(F.when(F.col("whole"), F.col("ni") * (F.col("ni") + 1) / 2).otherwise(F.col("ni") * F.col("nj")))).first()[0] or 1
    p = placed.join(size, GROUP).withColumn("si", F.pmod(F.xxhash64("id"), "ni").cast("int")).withColumn("sj", F.pmod(F.xxhash64("id"), "nj").cast("int"))
    at = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    strips = F.concat(F.transform(upto(F.col("si") + 1, F.col("ni") - 1), lambda j: at(F.col("si"), j, True)), F.transform(upto(zero, F.col("si")), lambda i: at(i, F.col("si"), False)))
    crossed = F.concat(F.when(F.col("home"), F.transform(upto(zero, F.col("nj") - 1), lambda j: at(F.col("si"), j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")), F.transform(upto(zero, F.col("ni") - 1), lambda i: at(i, F.col("sj"), False)))
    key = [*GROUP, "whole", "i", "j"]
    dealt = p.select(*GROUP, "whole", "id", "weight", "v", F.inline(F.when(F.col("whole"), strips).otherwise(crossed))).select(*key, "left", "id", "weight", "v")

    def tile(whole, left, ids, weight, raw):
        dim = raw.shape[1]
        one = bool(whole) and not left.any()  # a strip against itself
        a = np.arange(len(ids)) if one else np.flatnonzero(left)
        x = _unit(raw)
        flat, error = x.astype(np.float32), dim * 2.4e-7 + 1e-6  # of products of single precision
        pivots = flat[a[:: max(1, len(a) // 128)]] if len(a) >= 512 else flat[a[:1]]
        home, near = np.empty(len(a), np.int64), np.empty(len(a), np.float32)
        gone = lambda rows: np.sqrt(np.maximum(0, 2 - 2 * (flat[rows] @ pivots.T)))
        for s in range(0, len(a), 8192):
            d = gone(a[s : s + 8192])
            home[s : s + 8192] = d.argmin(1)
            near[s : s + 8192] = d.min(1)
        order = np.argsort(home, kind="stable")
        a, home, near = a[order], home[order], near[order]
        place = np.zeros(len(ids), np.int64)
        place[a] = np.arange(len(a))
        b = a if one else np.flatnonzero(~left)
        far = np.concatenate([gone(b[s : s + 8192]) for s in range(0, len(b), 8192)]) if len(b) else np.zeros((0, len(pivots)), np.float32)
        beyond = radius + 4 * math.sqrt(error)
        left_x, right_x = flat[a], flat[b]
        links, parent = np.zeros(len(ids)), np.arange(len(ids))
        ends = np.searchsorted(home, np.arange(len(pivots) + 1))
        for c in range(len(pivots)):
            for s in range(ends[c], ends[c + 1], 512):
                t = min(s + 512, int(ends[c + 1]))
                can = np.flatnonzero(far[s if one else 0 :, c] <= near[s:t].max() + beyond) + (s if one else 0)
                for k in range(0, len(can), 16384):
                    own = can[k : k + 16384]
                    dots = left_x[s:t] @ (right_x[own[0] : own[-1] + 1] if len(own) == own[-1] + 1 - own[0] else right_x[own]).T
                    i, j = np.nonzero(dots >= least - error)
                    if not len(i):
                        continue
                    sure, i, j = dots[i, j] >= least + error, a[i + s], b[own[j]]
                    keep = ids[i] != ids[j]
                    if one:  # a pair stands twice among the first rows
                        keep &= place[i] < place[j]
                    close = np.flatnonzero(keep & ~sure)
                    for m in range(0, len(close), 65536):
                        q = close[m : m + 65536]
                        keep[q] = (x[i[q]] * x[j[q]]).sum(1) >= least
                    i, j = i[keep], j[keep]
                    links += np.bincount(i, weights=weight[j], minlength=len(ids))
                    if whole:
                        links += np.bincount(j, weights=weight[i], minlength=len(ids))
                    _joined(parent, i, j)
        out = np.flatnonzero((links > 0) | (parent != np.arange(len(ids))))
        to = pa.array(ids[parent[out]], mask=parent[out] == out)
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(links[out].astype(np.int64)), to], ["id", "links", "to"])

    def run(parts):
        now, held = None, []

        def done():
            if held:
                left, ids, weight, raw = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                yield tile(now[3], left, ids, weight, raw)

        for batch in parts:
            for k, own in _runs(batch, 6):
                if k != now:
                    yield from done()
                    now = k
                held.append((own.column(6).to_numpy(zero_copy_only=False), own.column(7).to_numpy(), own.column(8).to_numpy(), _raw(own.column(9), k[1], kind)))
        yield from done()

    return dealt.repartition(int(min(4096, max(8, 2 * tiles))), *key).sortWithinPartitions(*key).mapInArrow(trimmed(run), "id long, links long, to long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two rows link when their labels are equal and not null, their vectors have one length, and their cosine
    in double precision is at least `least` (which must be over 0).  Vectors that are null, empty, zero or
    hold null or non-finite numbers link with nothing.  Equal vectors of a label are joined as one, with a
    weight.  component_id is the smallest id that links reach, kept whether it is the row's own.  Rows are told
    apart one by one: of rows that repeat an id, each has its own links and component.  A row with a null id stays
    alone, with null results for component_id and kept.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    narrow = df.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = "<f4" if narrow else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    sets = _scanned(rows, kind, True).filter("twin IS NOT NULL").groupBy(*SAME).agg(F.min_by("v", "id").alias("v"), F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    sets = checkpointed(sets.withColumn("node", F.monotonically_increasing_id()))
    start = sets.select("label", "dim", F.lit("").alias("cell"), F.lit(True).alias("home"), F.col("node").alias("id"), "weight", "v")
    found = checkpointed(_cells(_partitioned(start, radius, kind), least, radius, kind))
    comp = components(found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    few = comp.join(links, "node", "left")  # most vectors have no partner, so only those that have go through a component's smallest id
    name = sets.select("node", "first").join(comp, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    few = few.join(name, "component").select("node", "links", "component_id")
    own = sets.select(*SAME, "first", "weight", "node").join(few, "node", "left")
    done = own.select(*SAME, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    every = _scanned(rows, kind, False)
    linked = every.filter("twin IS NOT NULL").join(done, SAME).select("id", "n_links", "component_id")
    out = linked.unionByName(every.filter("twin IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
