"""Suffix-array dedup: removes bytes that a long enough string covers which also starts earlier.

Distributed prefix doubling: each position has the rank of the string of w bytes that starts there;
the rank is paired with the one at position + offset, the pairs are shuffled by ranges and sorted, and
their places are the ranks of longer strings, until a rank is unique or the threshold is reached.

Ranking every byte of a corpus costs many times its size in shuffles, so the starts whose fate is
settled by their surroundings leave first, and lose nothing by it:

1. Each string of ``length`` bytes has an *anchor*: its smallest inner k-gram by hash, leftmost
   on ties.  Equal strings have it at the same place, so only strings around equal anchors can
   be equal.  The strings around one occurrence of an anchor are an interval of starts.  Equal
   intervals (one hash over all their bytes) are equal string by string: all but the first
   occurrence are repeats.  An anchor with one kind of interval has no other repeats.
2. Intervals of one anchor that differ are cut into steps of a few starts, grouped by the
   bytes that all strings of the step share, and settled the same way.
3. The starts that are left, at the ends of repeated passages, go through prefix doubling, with
   the positions whose ranks theirs are made of.

An anchor's or a step's copies are combined inside a block before the shuffle, so a passage
that a third of all documents share arrives once per block and kind.  String equality is
decided on 64-bit hashes (two of them, or 112 bits, for intervals).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import blocks as B
from .kernels import Hasher, U, mix, segments

STEP, BLOCK_BYTES = 6, 1 << 20
LOW48 = U((1 << 48) - 1)


def gram(length: int) -> int:
    return 32 if length >= 64 else max(1, length // 3)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width`."""
    m, s = key, 1
    while s * 2 <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (width - s)], m[width - s :]) if width > s else m


class Hashed:
    """A block's bytes, hashed piece by piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def _hashed(self, at: np.ndarray):
        """Runs of ascending positions that one piece of the block's documents holds, with its Hasher."""
        for a, b in segments(self.off, 1 << 17):
            s, t = np.searchsorted(at, [self.off[a], self.off[b]])
            if t > s:
                yield s, t, Hasher(self.data[self.off[a] : self.off[b]]), self.off[a]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n bytes from each of these ascending positions."""
        out = np.zeros(len(at), U)
        for s, t, hashes, base in self._hashed(at):
            out[s:t] = hashes(at[s:t] - base, at[s:t] - base + n)
        return out


class Intervals(Hashed):
    """The anchors of a block, with the starts lo..hi of their strings and the hashes of 1."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        super().__init__(data, off)
        self.length, self.k = length, gram(length)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for a, b in segments(off, 1 << 17):
            base, o = off[a], off[a : b + 1] - off[a]
            n = int(o[-1])
            if n < length:
                continue
            hashes = Hasher(data[base : base + n])
            at = np.arange(n - self.k + 1)
            key = (hashes(at, at + self.k) & U(0xFFFFFFFF00000000)) | at.astype(U)
            anchor = (_least(key, length - self.k + 1) & U(0xFFFFFFFF)).astype(np.int64)
            own = np.zeros(n + 1, np.int32)
            long = np.diff(o) >= length
            np.add.at(own, o[:-1][long], 1)
            np.add.at(own, o[1:][long] - length + 1, -1)
            start = np.flatnonzero(np.cumsum(own)[: len(anchor)] > 0)
            if not len(start):
                continue
            anchor = anchor[start]
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
            lo, hi, anchor = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])], anchor[new]
            gap = (anchor - lo).astype(U)
            out[0].append(mix(hashes(anchor, anchor + self.k) + U(1)))  # anchors have small hashes; mixed, they fill all slices alike
            out[1].append(mix(hashes(lo, hi + length) + mix(gap * U(256) + U(1))))
            for x, y in zip(out[2:], (anchor, lo, hi), strict=True):
                x.append(y + base)
        self.key, self.full = (np.concatenate(x) if x else np.zeros(0, U) for x in out[:2])
        self.anchor, self.lo, self.hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[2:])

    def steps(self, which: np.ndarray):
        """Steps of the intervals `which`: key, full, lo, hi, and the anchors' own keys."""
        far, near = self.anchor[which] - self.lo[which], self.anchor[which] - self.hi[which]
        first, last = near // STEP, far // STEP
        n = last - first + 1
        item = np.repeat(which, n)
        c = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        a = self.anchor[item]
        lo, hi = np.maximum(self.lo[item], a - c * STEP - STEP + 1), np.minimum(self.hi[item], a - c * STEP)
        core_a, core_b = a - c * STEP, a - c * STEP - STEP + 1 + self.length
        core_b = np.maximum(core_b, core_a)
        key, full = (np.zeros(len(item), U) for _ in range(2))
        for s, t, hashes, base in self._hashed(lo):
            key[s:t] = hashes(core_a[s:t] - base, core_b[s:t] - base)
            full[s:t] = hashes(lo[s:t] - base, hi[s:t] + self.length - base)
        key = mix(key + mix(self.key[item] + c.astype(U)))
        full = mix(full + mix((a - lo).astype(U) * U(512) + U(3)))
        return key, full, lo, hi


def _firsts(key: np.ndarray, full: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the first item of each (key, full), in item order."""
    order = np.lexsort((at, ids, full, key))
    k, f = key[order], full[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    return np.sort(order[new])


def _runs(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges lo..end - 1, as starts and ends of maximal runs."""
    if not len(lo):
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))
    return lo[new], end[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


class Round:
    """What a block sends for a set of items, and what it makes of the answers: 0 first, 1 repeat, 2 open."""

    def __init__(self, key, full, ids, at):
        self.key, self.full, self.ids, self.at = key, full, ids, at
        self.firsts = _firsts(key, full, ids, at)

    def split(self, q: int):
        return B.split_slices(B.slice_of(self.key[self.firsts], q), q)

    def chunks(self, blk: int, q: int):
        rows = []
        for k, n in self.split(q):
            n = self.firsts[n]
            low = self.key[n] & LOW48
            rows.append((blk, k, B.pack((low & U(0xFFFFFFFF)).astype(np.uint32), (low >> U(32)).astype(np.uint16), self.full[n], self.ids[n], self.at[n].astype(np.int32 if self.at[n].max() < 1 << 31 else np.int64))))
        if rows:
            yield B.arrow_rows(B.CHUNKS, rows)

    def order(self, q: int) -> np.ndarray:
        """The items sent, in the order in which states() gets their answers."""
        sent = [self.firsts[n] for _, n in self.split(q)]
        return np.concatenate(sent) if sent else self.firsts


def states(n: int, order: np.ndarray, answers: dict) -> np.ndarray:
    """The state of each of n items; those that aren't the block's first of their kind are repeats."""
    out = np.ones(n, np.uint8)
    if len(order):
        out[order] = np.concatenate([answers[k][0] for k in sorted(answers)])
    return out


def settle(chunks: list, _: int) -> list[bytes]:
    """The states of a slice's items."""
    key = np.concatenate([c[0].astype(U) | c[1].astype(U) << U(32) for c in chunks])
    full, ids, at = (np.concatenate([c[n] for c in chunks]) for n in (2, 3, 4))
    order = np.lexsort((at, ids, full, key))
    k, f = key[order], full[order]
    new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (f[1:] != f[:-1])
    group = np.cumsum(new_key) - 1
    kinds = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0)
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(new, np.where(kinds[group] > 1, 2, 0), 1)
    ends = np.cumsum([len(c[2]) for c in chunks])
    return [B.pack(x) for x in np.split(state, ends[:-1])]


def _owned(ids: np.ndarray, off: np.ndarray, key, full, lo) -> Round:
    doc = np.searchsorted(off, lo, side="right") - 1
    return Round(key, full, ids[doc], lo - off[doc])


def widths(length: int) -> list[int]:
    """Widths of the strings that are ranked, from hashed ones to `length`."""
    out = [max(1, -(-length // 4))]
    while out[-1] < length:
        out.append(min(length, 2 * out[-1]))
    return out


def closure(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ranks the ranks of `starts` are made of, ascending, and for each the widths' numbers (as bits) that are asked of it."""
    steps = widths(length)
    at, deep = starts, np.full(len(starts), 1 << len(steps) - 1, np.int32)
    for n in range(len(steps) - 1, 0, -1):
        here = at[(deep >> n & 1) > 0]
        more = np.concatenate([here, here + steps[n] - steps[n - 1]])
        at, inverse = np.unique(np.concatenate([at, more]), return_inverse=True)
        bits = np.zeros(len(at), np.int32)
        np.bitwise_or.at(bits, inverse, np.concatenate([deep, np.full(len(more), 1 << n - 1, np.int32)]))
        deep = bits
    return at, deep


def _rank(last: bool):
    """Ranks of a slice's pairs: their places in order, 0 for a pair of one position; at the last width also which entry comes first."""

    def rank(chunks: list, k: int) -> list[bytes]:
        r, r2, many = (np.concatenate([c[n] for c in chunks]) for n in range(3))
        order = np.lexsort((*((np.concatenate([c[n] for c in chunks]) for n in (4, 3)) if last else ()), r2, r))
        new = np.ones(len(order), bool)
        new[1:] = (r[order][1:] != r[order][:-1]) | (r2[order][1:] != r2[order][:-1])
        place = np.cumsum(new) - 1
        size = np.bincount(place, 1 + many[order])
        out, first = np.zeros(len(order), U), np.zeros(len(order), bool)
        out[order] = np.where(size[place] > 1, (U(k) << U(PLACES)) + place.astype(U) + U(1), U(0))
        first[order] = new
        ends = np.cumsum([len(c[0]) for c in chunks])[:-1]
        return [B.pack(x, y) for x, y in zip(np.split(out, ends), np.split(first, ends), strict=True)]

    return rank


PLACES = 40


def _pairs(blk: int, n: int, length: int, q: int, at, deep, ids, where, r):
    """Rows of round n of a block: the pairs (rank, rank at position + offset) of the positions asked for, each distinct one once, and its state."""
    steps = widths(length)
    last = n + 1 == len(steps)
    here = np.flatnonzero(deep >> n & 1)
    there = np.minimum(np.searchsorted(at, at[here] + steps[n] - steps[n - 1]), max(0, len(at) - 1))
    both = at[there] == at[here] + steps[n] - steps[n - 1]
    here, there = here[both], there[both]
    if not len(here):
        return
    a, b = r[here], r[there]
    order = np.lexsort((where[here], ids[here], b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    entry = np.empty(len(here), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = order[new]
    a, b = a[new], b[new]
    many = np.bincount(entry)[np.arange(len(a))] > 1
    # Slices are ranges of the rank, so places within them are places among all pairs.
    which = B.slice_of(a, q) if n == 1 else (a >> U(PLACES)).astype(np.int64)
    rows, sent = [], []
    for k, own in B.split_slices(which, q):
        pos = here[first[own]]
        rows.append((blk, k, B.pack(a[own], b[own], many[own].astype(np.uint8), *((ids[pos], where[pos]) if last else ()))))
        sent.append(own)
    keep = B.pack(at[here], deep[here], ids[here], where[here], entry, np.concatenate(sent), first)
    yield B.arrow_rows(B.CHUNKS, [(blk, DEEP, keep), *rows])


def prefix_doubling(sent: DataFrame, length: int, q: int) -> DataFrame:
    """(blk, q, body): the positions in each block whose string of `length` bytes occurs earlier (smaller id, smaller place).

    sent: the rows of round 1.  Each round sorts the pairs and numbers them in that order; pairs of one
    position are unique and leave, the others' numbers are their positions' ranks in the next round.
    """
    for n in range(1, len(widths(length))):
        last = n + 1 == len(widths(length))

        def ranked(blk, state, got, n=n, last=last):
            at, deep, ids, where, entry, order, first = state
            rank, is_first = np.zeros(len(order), U), np.zeros(len(order), bool)
            rank[order] = np.concatenate([got[0][k][0] for k in sorted(got[0])])
            is_first[order] = np.concatenate([got[0][k][1] for k in sorted(got[0])])
            r = rank[entry]
            left = r > 0
            if not last:
                yield from _pairs(blk, n + 1, length, q, at[left], deep[left], ids[left], where[left], r[left])
                return
            left[first[is_first]] = False
            if left.any():
                yield B.arrow_rows(B.CHUNKS, [(blk, 0, B.pack(at[left]))])

        answers = B.exchange(sent.filter(F.col("q") >= 0), _rank(last), q)
        sent = B.checkpointed(B.with_answers(sent.filter(F.col("q") == DEEP).select("blk", "body"), [answers], ranked, B.CHUNK_SCHEMA))
    return sent


STATE, DEEP = -1, -2


def _repeats(docs: B.Blocks, length: int):
    """(blocks, their removed runs, and the further starts of repeats that prefix doubling finds)."""
    if length < 4:
        raise ValueError("length must be 4 or more")
    q = docs.slices()
    table = B.dealt(docs.table())

    def anchors(blk, arrays):
        ids, _, off, data = arrays[:4]
        x = Intervals(data, off, length)
        yield from _owned(ids, off, x.key, x.full, x.lo).chunks(blk, q)

    def steps(blk, arrays, got):
        """Chunks of the steps, and the block's state: runs that go, the steps, and the order of their answers."""
        ids, _, off, data = arrays[:4]
        x = Intervals(data, off, length)
        state = states(len(x.key), _owned(ids, off, x.key, x.full, x.lo).order(q), got[0])
        key, full, lo, hi = x.steps(np.flatnonzero(state == 2))
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        second = _owned(ids, off, key[order], full[order], lo)
        a, b = _runs(x.lo[state == 1], x.hi[state == 1] + length)
        yield B.arrow_rows(B.CHUNKS, [(blk, STATE, B.pack(a, b, lo, (hi - lo).astype(np.uint8), second.order(q).astype(np.int32)))])
        yield from second.chunks(blk, q)

    def positions(blk, arrays, got):
        """The runs that go, and round 1 of prefix doubling for the starts that are open."""
        ids, _, off, data = arrays[:4]
        a, b, lo, more, order = got[0][STATE]
        hi = lo + more
        state = states(len(lo), order, got[1])
        left = np.flatnonzero(state == 2)
        n = hi[left] - lo[left] + 1
        starts = np.repeat(lo[left] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.searchsorted(off, starts, side="right") - 1
        x = Hashed(data, off)
        whole = x.hashes(starts, length)
        first = _firsts(whole, whole, ids[doc], starts - off[doc])
        again = np.ones(len(starts), bool)
        again[first] = False
        gone = state == 1
        a, b = _runs(np.concatenate([a, lo[gone], starts[again]]), np.concatenate([b, hi[gone] + length, starts[again] + length]))
        at, deep = closure(np.sort(starts[first]), length)
        doc = np.searchsorted(off, at, side="right") - 1
        yield B.arrow_rows(B.CHUNKS, [(blk, STATE, B.pack(a, b))])
        yield from _pairs(blk, 1, length, q, at, deep, ids[doc], at - off[doc], x.hashes(at, widths(length)[0]))

    first = B.exchange(docs.each(anchors, B.CHUNK_SCHEMA), settle, q)
    sent = B.checkpointed(B.with_answers(table, [first], steps, B.CHUNK_SCHEMA))
    second = B.exchange(sent.filter(F.col("q") >= 0), settle, q)
    made = B.checkpointed(B.with_answers(table, [sent.filter(F.col("q") == STATE), second], positions, B.CHUNK_SCHEMA))
    return table, made.filter(F.col("q") == STATE), prefix_doubling(made.filter(F.col("q") != STATE), length, q)


def _cut(arrays, got, length: int):
    """For each document of a block: which of its bytes go."""
    off, data = arrays[2], arrays[3]
    a, b = got[0][STATE]
    found = got[1][0][0] if got[1] else a[:0]
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.concatenate([a, found]), 1)
    np.add.at(edge, np.concatenate([b, found + length]), -1)
    gone = np.cumsum(edge[:-1]) > 0
    for n in range(len(off) - 1):
        own, g = data[off[n] : off[n + 1]], gone[off[n] : off[n + 1]]
        yield own, g if g.any() else None


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = True) -> DataFrame:
    """Per row: its bytes less every byte covered by a string of `length` bytes that also starts earlier.

    Earlier: smaller id, or the same row at an earlier start (rows with equal ids: one of them, always the
    same one of the input as read, counts as earlier; null ids come after all others).  Matches never cross
    rows; strings are judged on the input.  Null and empty texts have no bytes; texts shorter than `length`
    stay whole.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    with_text, kept (the remaining bytes).  Other columns are not read.
    """
    table, state, found = _repeats(B.Blocks(df, id_col, text_col, BLOCK_BYTES), length)
    names = RESULT.names if with_text else RESULT.names[:-1]

    def cut(blk, arrays, got):
        out = []
        for i, null, (own, g) in zip(arrays[0].tolist(), arrays[1].tolist(), _cut(arrays, got, length), strict=True):
            kept = own.tobytes() if g is None else own[~g].tobytes()
            removed, spans = (0, 0) if g is None else (int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
            out.append((None if null else i, len(own), removed, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        yield B.arrow_rows(pa.schema([RESULT.field(n) for n in names]), out)

    return B.with_answers(table, [state, found], cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """df with the bytes that remove_repeats() removes cut out of its texts, and with them what a cut leaves of a character.

    All columns keep their places and types; values other than the text are carried as they are.  A null text
    stays null.
    """
    others = [c for c in df.columns if c != text_col]
    mark = "_" * (1 + max(map(len, df.columns)))
    docs = B.Blocks(df.withColumn(mark, F.col(f"`{text_col}`").isNull()), id_col, text_col, BLOCK_BYTES, [*others, mark])
    table, state, found = _repeats(docs, length)
    at = df.columns.index(text_col)

    def cut(blk, arrays, got):
        *columns, missing = B.rest_of(arrays).columns
        texts = pa.array([own.tobytes().decode() if g is None else own[~g].tobytes().decode("utf-8", "ignore") for own, g in _cut(arrays, got, length)], pa.string())
        columns.insert(at, pyarrow.compute.if_else(missing, pa.scalar(None, pa.string()), texts))
        yield pa.RecordBatch.from_arrays(columns, names)

    names = [f"c{n}" for n in range(len(df.columns))]
    kinds = StructType([StructField(c, f.dataType) for c, f in zip(names, df.schema, strict=True)])
    return B.with_answers(table, [state, found], cut, kinds).toDF(*df.columns)
