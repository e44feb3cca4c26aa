"""Centroid clustering with float32 screening.

Distances to all centroids come from one float32 matrix product.  Its error has a bound that holds for
any order of summation, so every score is an interval; a centroid whose interval begins beyond the
lowest end of all can't be the nearest.  Where one is left it is the nearest, and where intervals
overlap the ones left are compared by whole numbers, the smallest number first among equals.  Results
don't depend on the machine's product, only the number of comparisons does.  Sums are whole numbers
too; a round sends one row of sums for each task and centroid to Spark's aggregate, and the driver
holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, SCALE, K, ROUNDS, SEED = 64, 256.0, 40, 5, "2"
LIMIT = 1 << 27  # of whole numbers: 64 squared differences then fit a long
CELLS = 1 << 22  # scores held at once


def screened(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, centroids) that may be nearest, in the order of rows and then of centroids; x and centroids are whole numbers below LIMIT.

    A score is |c|^2 - 2 x.c.  With u = 2**-24, casting moves each factor by a share of u and a float32 sum of d products
    moves by at most g = (d+2)u / (1 - (d+2)u) of the sum of |x_i c_i|, which isn't over |x||c|.
    """
    d = x.shape[1]
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    products = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(1).astype(np.float64)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(squares)[None, :]
    scores = squares[None, :] - 2 * products
    # the last term: rounding in float64 of the squares, the lengths and the score itself, with room to spare
    error = 2 * g * lengths * (1 + 2.0**-40) + 2.0**-50 * (squares[None, :] + 2 * np.abs(products))
    return np.nonzero(scores - error <= (scores + error).min(1, keepdims=True))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, candidates) of the nearest centroid of every row; ties go to the smallest number."""
    step, out = max(1, CELLS // max(1, len(centroids))), []
    for at in range(0, len(x), step):
        part = x[at : at + step]
        rows, who = screened(part, centroids)
        n = np.bincount(rows, minlength=len(part))
        best = who[np.cumsum(n) - n]
        open_ = np.flatnonzero((n > 1)[rows])  # overlapping intervals only
        if len(open_):
            r, c = rows[open_], who[open_]
            far = ((part[r] - centroids[c]) ** 2).sum(1)
            order = np.lexsort((c, far, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            best[r[first]] = c[first]
        out.append((best, ((part - centroids[best]) ** 2).sum(1), n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): floor(256*x) of the vectors of `dim` components, all finite and below LIMIT when whole."""
    bad = F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= LIMIT - 1))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    return rows.filter(F.col("c").isNotNull() & (F.size("c") == dim) & ~bad).select("id", F.transform("c", lambda x: F.floor(x * SCALE)).alias("v"))


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; equal ids by their vectors.  Vectors without an id never start one."""
    first = rows.filter("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r.v for r in first.collect()], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def step(rows: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, inertia, sums) of every centroid with vectors: one row a centroid."""
    k, dim = centroids.shape

    def sums(batches):
        n, far, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                best, d, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                who, at = np.unique(best[order], return_index=True)
                n[who] += np.diff([*at, len(best)])
                total[who] += np.add.reduceat(x[order], at)
                for c, s in zip(who.tolist(), np.add.reduceat(d[order].astype(object), at), strict=True):
                    far[c] += int(s)
        mine = np.flatnonzero(n)
        if len(mine):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(mine.astype(np.int32)), "n": n[mine], "inertia": pa.array([Decimal(far[c]) for c in mine], pa.decimal128(38, 0)), "sums": pa.array(list(total[mine]), pa.list_(pa.int64()))})

    found = rows.mapInArrow(sums, "cluster int, n long, inertia decimal(38,0), sums array<long>")
    total = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")) for j in range(dim)]
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").cast("decimal(38,0)").alias("inertia"), F.array(*total).alias("sums")).collect()


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """The centroids after `rounds` rounds; an empty one stays where it is."""
    centroids = starts(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for r in step(rows, centroids):
            centroids[r.cluster] = [int(s) // r.n for s in r.sums]
    return centroids


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_candidates int"
_OUT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string()), ("n_candidates", pa.int32())])


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_candidates) of every vector kept.

    Kept are vectors of exactly `dim` components, none null or non-finite, nor of 2**19 or more (their distances need not
    fit a long).  Every row counts, repeated ids too; a null id takes part but starts no centroid.  With fewer than k
    ids there are fewer centroids; without any the result is empty.  An inertia that doesn't fit a long is null.
    n_candidates is the number of centroids that the screening left.
    """
    rows = whole_vectors(df, id_col, vector_col, dim)
    centroids = fit(rows, k, rounds, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], OUT)
    each = {r.cluster: int(r.inertia) for r in step(rows, centroids)}
    fits = lambda x: x if x < 1 << 63 else None
    own, total = [fits(each.get(c, 0)) for c in range(len(centroids))], fits(sum(each.values()))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def out(batches):
        for batch in batches:
            if batch.num_rows:
                best, far, n = nearest(_matrix(batch.column(1), dim), centroids)
                to = pa.array(best)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(far), pa.array(own, pa.int64()).take(to), pa.array([total] * len(best), pa.int64()), pa.array(names).take(to), pa.array(n.astype(np.int32))], schema=_OUT)

    return rows.mapInArrow(out, OUT)
