"""Hierarchical multi-length packing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .tokens import Encoder, runs

TIERS = (1024, 512, 256, 128)
GROUP_DOCS, GROUP_TOKENS, STEP_TOKENS = 8192, 1 << 23, 1 << 16


class Window:
    __slots__ = ("size", "pieces", "used")

    def __init__(self, size: int):
        self.size, self.pieces, self.used = size, [], 0

    def add(self, doc: int, start: int, n: int) -> None:
        self.pieces.append((doc, start, n))
        self.used += n


def pack(lengths: list[int], tiers=TIERS) -> list[Window]:
    """Windows over documents 0, 1, ... of these lengths; every token in one piece, every window full.

    Full windows of the longest tier come off long documents.  What is left of each goes to the shortest
    tier that holds it.  From the longest tier down, each document opens a window, whose gap takes the
    longest fitting ones of the shorter tiers.  Windows that still have gaps are filled with cuts of the
    ones that hold least; the last is cut into powers of two.
    """
    top = tiers[0]
    done: list[Window] = []
    shelf: dict[int, list[tuple[int, int]]] = {}
    here = 0  # bit n: the shelf has documents of n tokens
    for doc, n in enumerate(lengths):
        for start in range(0, n - top + 1, top):
            w = Window(top)
            w.add(doc, start, top)
            done.append(w)
        if n % top:
            shelf.setdefault(n % top, []).append((doc, n - n % top))
            here |= 1 << n % top

    def take(most: int):
        nonlocal here
        n = (here & (1 << most + 1) - 1).bit_length() - 1
        if n <= 0:
            return None
        doc, start = shelf[n].pop()
        if not shelf[n]:
            here &= ~(1 << n)
        return doc, start, n

    gaps: list[Window] = []
    for k, tier in enumerate(tiers):
        below = tiers[k + 1] if k + 1 < len(tiers) else 0
        while here >> below + 1:
            w = Window(tier)
            w.add(*take(tier))
            while w.used < tier and (x := take(tier - w.used)):
                w.add(*x)
            (done if w.used == tier else gaps).append(w)
    gaps.sort(key=lambda w: (w.size, w.used))
    give, at = 0, len(gaps) - 1
    while give < at:
        w, donor = gaps[at], gaps[give]
        while w.used < w.size and donor.pieces:
            doc, start, n = donor.pieces.pop()
            cut = min(n, w.size - w.used)
            w.add(doc, start, cut)
            donor.used -= n
            if n > cut:
                donor.add(doc, start + cut, n - cut)
        if w.used == w.size:
            done.append(w)
            at -= 1
        if not donor.pieces:
            give += 1
    if give <= at and gaps and gaps[at].pieces:
        last = gaps[at]
        pieces = last.pieces[::-1]
        left = last.used
        while left:
            w = Window(1 << left.bit_length() - 1)
            left -= w.size
            while w.used < w.size:
                doc, start, n = pieces.pop()
                cut = min(n, w.size - w.used)
                w.add(doc, start, cut)
                if n > cut:
                    pieces.append((doc, start + cut, n - cut))
            done.append(w)
    return done


def balance(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: the longest first, to the group that has the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def groups(parts, path: str, end: int | None) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of documents: their ids and their token ids as bytes.  The encoder ends with the task, so idle workers don't hold it."""
    enc, tail = Encoder(path), b"" if end is None else int(end).to_bytes(4, "little")
    ids, texts, size = [], [], 0
    for run in (run for batch in parts for run in runs(batch)):
        for i, x in zip(run.column(0).to_pylist(), enc.many(run.column(1)), strict=True):
            x += tail
            ids.append(i)
            texts.append(x)
            size += len(x) // 4
            if len(ids) >= GROUP_DOCS or size >= GROUP_TOKENS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: where a run of a document's token ids stands in a sequence.

    Ids are those of the tokenizers file, then end_id.  A null or empty text is end_id alone.  No sequence is
    padded (its length is a tier or a smaller power of two) and each id is in one piece.  The documents of a
    scan task are packed together, up to GROUP_DOCS or GROUP_TOKENS at a time, so nothing is shuffled and
    memory is bounded by the longest text.  Rows are packed one by one: ids may repeat or be null.
    sequence_length and step_group (sequences whose tokens add up alike) follow; with_ids adds the ids
    themselves (`ids`, little-endian unsigned 32-bit).
    """
    if tiers[0] & tiers[0] - 1 or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers: descending, the first a power of two")

    def run(parts):
        from pyspark import TaskContext

        sequence = step = TaskContext.get().partitionId() << 33
        for ids, tokens in groups(parts, tokenizer_path, end_id):
            windows = pack([len(x) // 4 for x in tokens], tiers)
            steps = balance([w.size for w in windows])
            rows = []
            for w, g in zip(windows, steps, strict=True):
                offset = 0
                for doc, start, n in w.pieces:
                    piece = tokens[doc][4 * start : 4 * (start + n)]
                    row = (ids[doc], start, n, zlib.crc32(piece), len(tokens[doc]) // 4, sequence, offset, w.size, step + g)
                    rows.append((*row, piece) if with_ids else row)
                    offset += n
                sequence += 1
            step += max(steps, default=0) + 1
            for k in range(0, len(rows), 50_000):
                cols = list(zip(*rows[k : k + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:9]] + [pa.array(c, pa.binary()) for c in cols[9:]], names)

    schema = SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(B.trimmed(run), schema)


def padding(df: DataFrame) -> DataFrame:
    """Sequences, tokens and padded places of a packing."""
    one = df.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("sequence_length").alias("size"))
    return one.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.col("size") - F.col("n")).alias("padding"))

