"""N-gram Jaccard join of documents: size-aware, heavy and light.

A document is its set of word shingles.  Two sets link when their Jaccard similarity is at least
num/den.  The steps, none of which loses a link:

1. Equal sets are one set from here on.
2. Under any order of the shingles, linked sets share some of their first shingles.  By hash
   order, a set stays only if enough of its first shingles occur in another set.
3. Shingles are counted over the sets that stay; shingles of one set only are put aside, and
   with them every set that has too few left to link.
4. The rest is ordered from rare to frequent.  Small sets enumerate the fixed-size subsets
   (pairs) of their first shingles, and meet in equal subsets.  Large sets, and the small ones
   near enough in size to link with a large one, scan the inverted lists of their first single
   shingles.  The boundary is the size at which both together cost least; as lists are scanned
   from hubs, a list costs each of its members the root of its length.
5. Sets that meet are compared exactly, first each with one hub (the smallest id it meets).
   Sets that this has joined need no more comparison, so a group of copies costs about its size.
   The others are compared with all that they meet, in tiles, and only the links found leave a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .kernels import U, mix, shingles, word_hashes

SUBSET = 2
TILE = 4096
HOMES = 8


def need(n, num: int, den: int):
    """Least overlap of a set of n with one that it links with."""
    return -(-num * n // den)


def prefix(n, num: int, den: int):
    return n - need(n, num, den) + 1


def _extra(n, num, den):
    return prefix(n, num, den) // 2


def _sets(arrays: list, k: int):
    """Ids, null marks and shingle sets of a block's documents."""
    ids, nulls, off, data = arrays
    h, counts = word_hashes(data, off)
    return ids, nulls, shingles(h, counts, k)


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=U).view(np.int64)), int(mix(s ^ U(0x5555555555555555)).sum(dtype=U).view(np.int64))


BASE = "blk long, row int, id long, n long, s1 long, s2 long, alone boolean"
_BASE = pa.schema([("blk", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("alone", pa.bool_())])
SETS = "id long, n long, cost_subsets double, cost_lists double, tokens binary, first int"


def _kept_sets(docs: B.Blocks, reps: DataFrame, k: int, num: int, den: int, q: int) -> DataFrame:
    """Blocks of the sets (one per distinct set) whose first shingles by hash occur often enough in other sets."""

    def lead(s):
        return s[: prefix(len(s), num, den) + _extra(len(s), num, den)]

    def items(nulls, sets):
        """First shingles of the block's distinct sets: shingle, signature, and the first row with the set; and that row for each row."""
        seen, hs, sig, doc, same = {}, [], [], [], np.arange(len(sets))
        for n, s in enumerate(sets):
            if len(s) and not nulls[n]:
                x = _signature(s)
                same[n] = seen.setdefault(x, n)
                if same[n] == n:
                    p = lead(s)
                    hs.append(p)
                    sig.append(np.full(len(p), x[0], np.int64))
                    doc.append(np.full(len(p), n))
        if not hs:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), same
        return np.concatenate(hs), np.concatenate(sig), np.concatenate(doc), same

    def send(blk, arrays):
        h, sig, *_ = items(*_sets(arrays, k)[1:])
        for j, n in B.split_slices(B.slice_of(mix(h), q), q):  # first shingles have small hashes
            yield B.arrow_rows(B.CHUNKS, [(blk, j, B.pack(h[n], sig[n]))])

    def shared(chunks, _):
        h, sig = (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
        order = np.lexsort((sig, h))
        a, b = h[order], sig[order]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        group = np.cumsum(new) - 1
        many = np.zeros(group[-1] + 1, bool)
        many[group[1:][~new[1:] & (b[1:] != b[:-1])]] = True
        out = np.empty(len(h), bool)
        out[order] = many[group]
        ends = np.cumsum([len(c[0]) for c in chunks])
        return [B.pack(np.packbits(x)) for x in np.split(out, ends[:-1])]

    def keep(blk, arrays, got):
        ids, nulls, sets = _sets(arrays, k)
        h, _, doc, same = items(nulls, sets)
        common = np.zeros(len(h), bool)
        for j, n in B.split_slices(B.slice_of(mix(h), q), q):
            common[n] = np.unpackbits(got[0][j][0])[: len(n)]
        hits = np.bincount(doc[common], minlength=len(sets))
        rows = [n for n in got[1].tolist() if hits[same[n]] >= 1 + _extra(need(len(sets[n]), num, den), num, den)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int64()), pa.array([B.pack(ids[rows], np.array([len(sets[n]) for n in rows]), np.concatenate([sets[n] for n in rows]))], pa.binary())], ["blk", "body"])

    found = B.exchange(docs.each(send, B.CHUNK_SCHEMA), shared, q)
    return B.with_answers(docs.table(), [found, reps.select("blk", F.col("row").alias("number"))], keep, B.BLOCK_SCHEMA)


def _ordered_sets(kept: DataFrame, num: int, den: int, q: int) -> DataFrame:
    """The sets that may link, as their shingles that others have too, from rare to frequent."""

    def read(arrays):
        ids, n, tokens = arrays
        return ids, n, tokens, *np.unique(tokens, return_inverse=True, return_counts=True)

    def send(blk, arrays):
        *_, h, _, count = read(arrays)
        for j, n in B.split_slices(B.slice_of(h, q), q):
            yield B.arrow_rows(B.CHUNKS, [(blk, j, B.pack(h[n], count[n].astype(np.uint32)))])

    def total(chunks, _):
        h, inverse = np.unique(np.concatenate([c[0] for c in chunks]), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([c[1] for c in chunks]), len(h)).astype(np.uint32)[inverse]
        ends = np.cumsum([len(c[0]) for c in chunks])
        return [B.pack(x) for x in np.split(sums, ends[:-1])]

    def order(blk, arrays, got):
        ids, size, tokens, h, inverse, _ = read(arrays)
        df = np.zeros(len(h), np.int64)
        for j, n in B.split_slices(B.slice_of(h, q), q):
            df[n] = got[0][j][0]
        df, rows, at = df[inverse], [], 0
        for i, n in zip(ids.tolist(), size.tolist(), strict=True):
            t, f = tokens[at : at + n], df[at : at + n]
            at += n
            many = f > 1
            left = int(many.sum())
            if left < need(n, num, den):
                continue
            t, f = t[many], f[many]
            by = np.lexsort((t, f))
            first = prefix(n, num, den) - (n - left)
            rows.append((i, n, float((first + 1) * first / 2), float(np.sqrt(f[by][:first]).sum()), t[by].tobytes(), first))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32()), strict=True)], [x.split()[0] for x in SETS.split(", ")])

    found = B.exchange(B.each_block(kept, send, B.CHUNK_SCHEMA), total, q)
    return B.with_answers(kept, [found], order, SETS)


def boundary(sizes: list[tuple[int, float, float]]) -> int:
    """The largest size of a small set: where enumerating subsets up to it and scanning lists above cost least.  sizes: (size, cost of subsets, cost of lists), a size class each."""
    sizes = sorted(sizes)
    cost = sum(c for _, _, c in sizes)
    best, at = cost, 0
    for size, subsets, lists in sizes:
        cost += subsets - lists
        if cost < best:
            best, at = cost, size
    return at


def _keys(sets: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """(key, id): where sets meet."""

    def run(parts):
        for batch in parts:
            ids, keys = [], []
            for i, n, body, first in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "tokens", "first")), strict=True):
                t = np.frombuffer(body, U)
                if n <= small:
                    p = t[: first + SUBSET - 1]
                    a, b = np.triu_indices(len(p), 1)
                    lo, hi = np.minimum(p[a], p[b]), np.maximum(p[a], p[b])
                    keys.append(mix(mix(lo) + hi))
                    ids.append(np.full(len(a), i))
                if n > small or n >= need(small, num, den) or need(n, num, den) < SUBSET:
                    keys.append(mix(t[:first] + U(1)))
                    ids.append(np.full(first, i))
                if sum(map(len, keys)) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "id"])
                    ids, keys = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "id"])

    return sets.select("id", "n", "tokens", "first").mapInArrow(B.trimmed(run), "key long, id long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b)."""

    def run(parts):
        for batch in parts:
            a, b, na, ta, nb, tb = (batch.column(k).to_pylist() for k in range(6))
            linked = []
            for n, x, m, y in zip(na, ta, nb, tb, strict=True):
                both = len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)) if min(n, m) * den >= num * max(n, m) else 0
                linked.append(den * both >= num * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "ta", "nb", "tb").mapInArrow(B.trimmed(run), "a long, b long, linked boolean")


def _groups(keys: DataFrame, comp: DataFrame, homes: DataFrame) -> DataFrame:
    """(kind, g, id, component, main): who has to be compared with whom after the hubs.

    A key that joins several components sends its members to the homes (hubs) of them all (kind 0), so two
    members of a key with different components meet at the home of either.  A key with more than HOMES homes
    is a group of its own (kind 1), so no key sends a member to more than HOMES groups.
    """
    here = keys.join(homes, "id").join(comp, "id", "left").select("key", "id", "home", F.coalesce("component", "id").alias("component"))
    mixed = here.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", F.col("x").alias("main"))
    here = B.checkpointed(here.join(mixed, "key"))
    places = here.select("key", F.col("home").alias("g")).distinct()
    some = places.groupBy("key").agg(F.count(F.lit(1)).alias("homes"))
    few, many = some.filter(F.col("homes") <= HOMES).select("key"), some.filter(F.col("homes") > HOMES).select("key")
    at_homes = here.join(few, "key").join(places, "key").groupBy("g", "id").agg(F.first("component").alias("component"))
    main = comp.select(F.col("id").alias("g"), F.col("component").alias("main"))
    at_homes = at_homes.join(main, "g", "left").select(F.lit(0).alias("kind"), "g", "id", "component", F.coalesce("main", "g").alias("main"))
    return at_homes.unionByName(here.join(many, "key").select(F.lit(1).alias("kind"), F.col("key").alias("g"), "id", "component", "main").distinct())


def _compared(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of a group: for each member outside the group's main component, one to each component it links with.

    Members of the main component are joined already and aren't compared with each other.  A group of any
    size is dealt out in tiles of TILE members against TILE members.
    """
    g = B.checkpointed(groups.withColumn("active", F.col("component") != F.col("main")).drop("main"))
    size = g.groupBy("kind", "g").agg(F.ceil(F.count_if("active") / TILE).cast("int").alias("ni"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("nj")).filter("ni > 0")
    g = g.join(size, ["kind", "g"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("ni")).cast("int")).withColumn("j", F.pmod(F.xxhash64("id"), F.col("nj")).cast("int"))
    one = g.filter("active").select("kind", "g", "i", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "id", "component", F.lit(True).alias("active"))
    two = g.select("kind", "g", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), "j", "id", "component", F.lit(False).alias("active"))
    rows = one.union(two).join(sets.select("id", "n", "tokens"), "id").select("kind", "g", "i", "j", "active", "id", "component", "n", "tokens")

    def compare(ids, comps, sizes, active, tokens):
        vocabulary, number = np.unique(np.concatenate(tokens), return_inverse=True)
        ends = np.cumsum([len(t) for t in tokens])
        own = [number[e - len(t) : e] for e, t in zip(ends, tokens, strict=True)]
        right = np.flatnonzero(~active)
        if not len(right):
            return
        flat, first = np.concatenate([own[r] for r in right]), np.cumsum([0] + [len(own[r]) for r in right[:-1]])
        mark = np.zeros(len(vocabulary), np.int32)
        for k in np.flatnonzero(active):
            mark[own[k]] = 1
            both = np.add.reduceat(mark[flat], first)
            mark[own[k]] = 0
            hit = (den * both >= num * (sizes[k] + sizes[right] - both)) & (comps[right] != comps[k])
            if hit.any():
                to = right[hit]
                _, one_each = np.unique(comps[to], return_index=True)
                for r in to[one_each]:
                    yield int(ids[k]), int(ids[r])

    def run(parts):
        key, held = None, []

        def done():
            if any(h[0] for h in held) and len(held) > 1:
                active, ids, comps, sizes, tokens = zip(*held, strict=True)
                found = list(compare(np.array(ids), np.array(comps), np.array(sizes), np.array(active), [np.frombuffer(t, U) for t in tokens]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in parts:
            for kind, g, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if key != (kind, g, i, j):
                    yield from done()
                    key, held = (kind, g, i, j), []
                held.append(row)
        yield from done()

    return rows.repartition("kind", "g", "i", "j").sortWithinPartitions("kind", "g", "i", "j").mapInArrow(B.trimmed(run), "a long, b long")


def _linked(sets: DataFrame, keys: DataFrame, num: int, den: int) -> DataFrame:
    """(id, component) of the sets that some link touches."""
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    homes = B.checkpointed(keys.join(hubs, "key").groupBy("id").agg(F.min("hub").alias("home")))
    links = B.checkpointed(_verified(homes.filter("id <> home").select(F.col("home").alias("a"), F.col("id").alias("b")), sets, num, den).filter("linked").select("a", "b"))
    comp = B.checkpointed(components(links))
    more = B.checkpointed(_compared(_groups(keys, comp, homes), sets, num, den))
    return components(links.union(more)) if more.head(1) else comp


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links reach) of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than k words has the whole
    sequence as its one shingle; null, empty and blank texts have none and link with nothing.  Rows with one
    id are one document if their texts have one set, else they only share what their sets link with.  A row
    with a null id links with nothing and has a null component_id; other columns are not read.  Shingles are compared by 64-bit hash, equal sets by 128 bits.
    """
    docs = B.Blocks(df, id_col, text_col)
    q = docs.slices()

    def describe(blk, arrays):
        ids, nulls, sets = _sets(arrays, k)
        yield B.arrow_rows(_BASE, [(blk, n, i, len(s), *_signature(s), null) for n, (i, null, s) in enumerate(zip(ids.tolist(), nulls.tolist(), sets, strict=True))])

    base = B.checkpointed(docs.each(describe, BASE))
    same = ["n", "s1", "s2"]
    linked = base.filter("n > 0 and not alone")
    # A set's copies are combined block by block, so a large group of copies isn't one task's.
    local = linked.groupBy(*same, "blk").agg(F.min(F.struct("id", "blk", "row")).alias("r"))
    reps = local.groupBy(*same).agg(F.min("r").alias("r")).select(*same, F.col("r.id").alias("rep"), "r.blk", "r.row")
    kept = B.checkpointed(_kept_sets(docs, reps, k, num, den, q))
    sets = B.checkpointed(_ordered_sets(kept, num, den, q))
    size = F.ceil(F.pow(2.0, F.ceil(F.log2("n") * 16) / 16))
    costs = sets.groupBy(size.alias("size")).agg(F.sum("cost_subsets"), F.sum("cost_lists")).collect()
    comp = _linked(sets, _keys(sets, boundary([tuple(r) for r in costs]), num, den), num, den)
    # The component goes to a set first, then to its blocks, then to their rows.  Equal ids in different sets join their components.
    named = reps.select(*same, "rep").join(comp, F.col("rep") == F.col("id"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    by_block = local.select(*same, "blk").join(named, same)
    whole = linked.join(by_block, [*same, "blk"]).groupBy("id").agg(F.min("component").alias("component"))
    out = base.join(whole.withColumnRenamed("id", "other"), (F.col("id") == F.col("other")) & ~F.col("alone"), "left")
    own = F.when(~F.col("alone"), F.col("id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(own).alias("component_id"))
