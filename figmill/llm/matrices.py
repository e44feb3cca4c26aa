"""Token-id output: best-fit-decreasing packing into id matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .packing import groups

WIDTH = 2048


class Capacities:
    """Segment tree over what bins have left: least(n) finds the least capacity of at least n that some bin has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, left: int, which: int) -> None:
        self.bins[left].append(which)
        k = left + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def least(self, n: int) -> int | None:
        k = n + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves

    def take(self, left: int) -> int:
        k = left + self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.bins[left].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (document, start, length).  Longer documents are split into whole widths and a rest."""
    pieces = [(doc, start, min(width, n - start)) for doc, n in enumerate(lengths) for start in range(0, n, width)]
    pieces.sort(key=lambda p: -p[2])
    bins: list[list[tuple[int, int, int]]] = []
    room = Capacities(width)
    for p in pieces:
        left = room.least(p[2])
        if left is None:
            which, left = len(bins), width
            bins.append([])
        else:
            which = room.take(left)
        bins[which].append(p)
        if left > p[2]:
            room.add(left - p[2], which)
    return bins


SCHEMA = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def to_matrices(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = 50256, pad_id: int = 50256) -> DataFrame:
    """One row of a packed id matrix per row: `width` ids, padded at its end.

    A document is its ids by the tokenizers file and end_id; a null or empty text is end_id alone.  Longer
    ones are split without loss.  input_ids and position_ids are little-endian unsigned 32-bit (ids) and
    16-bit (positions, or 32-bit where width is over 65,536); positions start again with every segment and
    in the padding.  cu_seqlens has 0 and the cumulative segment lengths without the padding; doc_ids and
    starts say which document and which of its tokens a segment starts with.  Packed within scan tasks, so
    nothing is shuffled; ids may repeat or be null.
    """
    if width < 1:
        raise ValueError("width must be positive")
    small = np.dtype("<u2") if width <= 65_536 else np.dtype("<u4")

    def run(parts):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        count, size = np.arange(width, dtype=small).tobytes(), small.itemsize
        pad = int(pad_id).to_bytes(4, "little")
        for ids, tokens in groups(parts, tokenizer_path, end_id):
            bins = best_fit_decreasing([len(x) // 4 for x in tokens], width)
            for k in range(0, len(bins), 512):
                rows = []
                for own in bins[k : k + 512]:
                    ends = np.cumsum([0] + [n for _, _, n in own])
                    used = int(ends[-1])
                    row = b"".join([*(tokens[d][4 * s : 4 * (s + n)] for d, s, n in own), pad * (width - used)])
                    position = b"".join([count[: size * n] for n in (*(n for _, _, n in own), width - used)])
                    rows.append((sequence, used, len(own), [ids[d] for d, _, _ in own], [s for _, s, _ in own], ends.tolist(), row, position))
                    sequence += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["sequence_id", "n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(B.trimmed(run), SCHEMA)


def write_matrices(df: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, one row per matrix row; fails if the path has something."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
