"""Embedding whitening by merging singular value decompositions.

A task centres its vectors batch by batch and keeps their number, their mean and the singular values
and right singular vectors of the centred rows, all of them.  Two such parts merge without loss: the
rows s*V of both, and one more row, sqrt(n1*n2/(n1+n2)) times the difference of the means, have the
singular values and vectors of all rows centred at the common mean.  Parts merge in rounds of FAN, so
no task holds more than FAN matrices of dimension x dimension, and the tree is as deep as the logarithm
of the number of tasks.  Nothing is squared on the way, so entries near 10**6 that differ by a few
units lose no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed

FAN, MOST = 8, 1 << 53
SCALE, OFFSET, TOP = 64.0, 1_000_000, 32
PART = "dim int, node long, n long, sums array<decimal(38,0)>, mean array<double>, singular array<double>, vectors binary"
_PART = pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("singular", pa.list_(pa.float64())), ("vectors", pa.binary())])


class Part:
    """n rows: their sums as whole numbers (None of other rows), mean, and the singular values and vectors of the centred rows."""

    def __init__(self, n: int, sums: list[int] | None, mean: np.ndarray, singular: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.mean, self.singular, self.vectors = n, sums, mean, singular, vectors

    @classmethod
    def of(cls, rows: np.ndarray, whole: bool) -> Part:
        sums = None
        if whole:
            ints = rows.astype(np.int64)
            safe = not rows.size or np.abs(rows).max() * len(rows) < 2.0**62
            sums = [int(x) for x in (ints.sum(0) if safe else ints.astype(object).sum(0))]
        mean = np.array([s / len(rows) for s in sums]) if whole else rows.mean(0)
        return cls(len(rows), sums, mean, *_svd(rows - mean))

    def merged(self, other: Part) -> Part:
        n = self.n + other.n
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)] if self.sums is not None else None
        mean = np.array([s / n for s in sums]) if sums is not None else self.mean + (other.mean - self.mean) * (other.n / n)
        between = math.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        return Part(n, sums, mean, *_svd(np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, between])))

    def row(self, dim: int, node: int) -> pa.RecordBatch:
        sums = None if self.sums is None else [Decimal(s) for s in self.sums]
        one = ([dim], [node], [self.n], [sums], [self.mean.tolist()], [self.singular.tolist()], [np.ascontiguousarray(self.vectors).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, _PART, strict=True)], schema=_PART)

    @classmethod
    def read(cls, dim: int, r: dict) -> Part:
        return cls(r["n"], None if r["sums"] is None else [int(s) for s in r["sums"]], np.array(r["mean"]), np.array(r["singular"]), np.frombuffer(r["vectors"]).reshape(-1, dim))


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.svd(rows, full_matrices=False)[1:]


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of the vectors of each length in a batch."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        yield int(dim), mine, lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), int(dim))


def fit(vectors: DataFrame, whole: bool = False) -> dict[int, Part]:
    """The merged part of each length of the column v (array<double>); whole: its numbers are whole, and summed exactly.

    The driver gets one part a length: a square of it in numbers, however many the vectors.
    """

    def leaves(batches):
        from pyspark import TaskContext

        parts: dict[int, Part] = {}
        for batch in batches:
            for dim, _, rows in _groups(batch, 0):
                own = Part.of(rows, whole)
                parts[dim] = parts[dim].merged(own) if dim in parts else own
        for dim, part in parts.items():
            yield part.row(dim, TaskContext.get().partitionId())

    def merge(key, table):
        dim, node = (k.as_py() for k in key)
        parts = [Part.read(dim, r) for r in table.sort_by("part").to_pylist()]
        while len(parts) > 1:
            parts = [parts[k].merged(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return pa.Table.from_batches([parts[0].row(dim, node)])

    table = checkpointed(vectors.select("v").filter(F.size("v") > 0).mapInArrow(leaves, PART))
    last = table.agg(F.max("node")).first()[0] or 0
    while last:
        table = table.withColumnsRenamed({"node": "part"}).withColumn("node", F.expr(f"part div {FAN}")).groupBy("dim", "node").applyInArrow(merge, PART)
        last //= FAN
    return {r.dim: Part.read(r.dim, r.asDict()) for r in table.collect()}


class Whitener:
    """The components of the vectors of one length."""

    def __init__(self, dim: int, part: Part, top: int):
        self.n, self.sums = part.n, part.sums
        values = part.singular**2 / part.n
        k = min(top, dim)
        self.values = np.zeros(k)
        self.values[: min(k, len(values))] = values[:k]
        self.components = np.zeros((k, dim))
        self.components[: min(k, len(values))] = part.vectors[:k]
        self.explained = self.values / values.sum() if values.sum() > 0 else np.full(k, np.nan)
        level = part.singular[0] * max(part.n, dim) * np.finfo(float).eps if len(part.singular) else 0.0
        self.real = np.zeros(k, bool)
        self.real[: min(k, len(values))] = (part.singular > level)[:k]  # of the others nothing is left but rounding
        self.error = None

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n*x - S in whole numbers."""
        most = max([abs(s) for s in self.sums], default=0)
        small = not x.size or self.n * int(np.abs(x).max()) + most < 1 << 62
        return self.n * x - np.array(self.sums, np.int64) if small else self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, spread: np.ndarray) -> np.ndarray:
        scale = np.sqrt(self.values[self.real])
        out = np.full((len(spread), len(self.values)), np.nan)
        out[:, self.real] = (spread / self.n).astype(float) @ self.components[self.real].T / scale
        return out


def _deviations(spread: np.ndarray) -> list[int | None]:
    if not spread.size or spread.dtype != object and float(np.abs(spread).max()) ** 2 * spread.shape[1] < 2.0**62:
        return (spread.astype(np.int64) ** 2).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (int(x) for x in (spread.astype(object) ** 2).sum(1))]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(64*c) of the vectors without null or non-finite entries; OFFSET is added at the end only, as it moves nothing but S."""
    bad = F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= MOST))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    return rows.filter(F.col("c").isNotNull() & ~bad).select("id", F.transform("c", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component up to `top`.

    Vectors that are null or hold null or non-finite entries are left out, and so are entries of 2**47 or more, whose
    multiples of 64 aren't exact.  Vectors of another length are a table of their own; empty ones have no components.
    Every row counts, repeated ids and null ids too.  A component on which the vectors don't differ (a single vector,
    fewer vectors than dimensions, a constant) has whitened null and is left out of identity_error; without any
    variance explained is null.  A deviation that doesn't fit a long is null.
    """
    rows = whole_vectors(df, id_col, vector_col)
    models = {dim: Whitener(dim, part, top) for dim, part in fit(rows, whole=True).items()}

    def projected(batches):
        for batch in batches:
            for dim, _, v in _groups(batch, 1):
                if dim:
                    w = models[dim].project(models[dim].spread(v.astype(np.int64)))[:, models[dim].real]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), dim, np.int32)), pa.array(list(w), pa.list_(pa.float64()))], schema=pa.schema([("dim", pa.int32()), ("v", pa.list_(pa.float64()))]))

    white = rows.mapInArrow(projected, "dim int, v array<double>")
    for dim, model in models.items():
        if model.real.any():
            own = fit(white.filter(F.col("dim") == dim))[int(model.real.sum())]
            model.error = float(np.abs((own.vectors.T * (own.singular**2 / own.n)) @ own.vectors - np.eye(len(own.mean))).max())

    def out(batches):
        for batch in batches:
            ids = batch.column(0)
            for dim, mine, v in _groups(batch, 1):
                if not dim:
                    continue
                m = models[dim]
                spread, k = m.spread(v.astype(np.int64)), len(m.values)
                white, each = m.project(spread).ravel(), np.repeat(np.arange(len(mine)), k)
                columns = [ids.take(pa.array(mine[each])), np.tile(np.arange(1, k + 1, dtype=np.int32), len(mine)), np.full(len(each), m.n), pa.array(_deviations(spread), pa.int64()).take(pa.array(each)), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(m.explained, len(mine)), mask=np.tile(np.isnan(m.explained), len(mine))), pa.array([m.error] * len(each), pa.float64())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=_OUT)

    return rows.mapInArrow(out, OUT)
