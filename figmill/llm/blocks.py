"""Document blocks and the block exchange.

Most text operators here follow one pattern.  Documents are packed into blocks of a few
megabytes (one row per block).  A block emits *chunks*: numpy columns for the items whose
hash falls into slice ``q``.  Chunks are shuffled by ``q``, a slice is worked on as plain
arrays, and its answers go back to the block they came from.  Items never become Spark rows,
so a shuffle carries 10-20 bytes an item, and a frequent item arrives once per block (it is
combined inside the block first), so no key outgrows its slice.
"""

from __future__ import annotations

import ctypes
import functools
import io
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_SCHEMA = "blk long, body binary"
CHUNK_SCHEMA = "blk long, q int, body binary"
LAST = (1 << 63) - 1


def trim() -> None:
    """Gives the memory that a worker has freed back to the system: idle workers share an executor with the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """run(parts), the function of a mapInArrow, and trim() at the task's end."""

    @functools.wraps(run)
    def own(parts):
        try:
            yield from run(parts)
        finally:
            trim()

    return own


_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
SMALL = 256


def pack(*arrays: np.ndarray) -> bytes:
    """Numpy arrays as one byte string, compressed unless it is short; unpack() returns them.

    Whole numbers of four or eight bytes are stored byte by byte of their places, so that bytes that hardly change compress away.
    """
    out = io.BytesIO()
    out.write(struct.pack("<I", len(arrays)))
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.dtype.kind in "iu" and a.itemsize >= 4 and a.size >= 64
        kind = (b"T" if planes else b"") + a.dtype.str.encode()
        out.write(struct.pack("<BQ", len(kind), a.size) + kind)
        out.write((a.view(np.uint8).reshape(-1, a.itemsize).T if planes else a).tobytes())
    raw = out.getvalue()
    return b"\0" + raw if len(raw) < SMALL else b"\1" + _SQUEEZE.compress(raw)


def unpack(body: bytes) -> list[np.ndarray]:
    raw = _OPEN.decompress(memoryview(body)[1:]) if body[0] else body[1:]
    (n,), at, out = struct.unpack_from("<I", raw, 0), 4, []
    for _ in range(n):
        k, size = struct.unpack_from("<BQ", raw, at)
        kind = raw[at + 9 : at + 9 + k].decode()
        dtype = np.dtype(kind.removeprefix("T"))
        at += 9 + k
        if kind[0] == "T":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size).T).view(dtype).ravel())
        else:
            out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


_BLOCKS = pa.schema([("blk", pa.int64()), ("body", pa.binary())])


def text_arrays(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids int64, byte offsets int64, bytes uint8) of Arrow columns; a null text is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return ids.cast(pa.int64()).to_numpy(zero_copy_only=False), off - off[0], data[off[0] : off[-1]]


def batches(parts, most: int):
    """Groups consecutive rows (id, text) of a mapInArrow input into (ids, nulls, offsets, bytes) of about `most` bytes."""
    held, size = [], 0
    for batch in parts:
        nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        i, o, d = text_arrays(batch.column(0).fill_null(LAST), batch.column(1))
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(o, o[at] + most - size, side="right")) - 1)
            to = min(to, len(i))
            held.append((i[at:to], nulls[at:to], np.diff(o[at : to + 1]), d[o[at] : o[to]].copy()))
            size += int(o[to] - o[at])
            at = to
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    ids, nulls, lens, data = (np.concatenate(x) for x in zip(*held, strict=True))
    return ids, nulls, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), data


def _with_rest(parts, most: int):
    """batches() of an input (id, text, other columns), each with the other columns of its rows as Arrow's own bytes."""
    for batch in parts:
        ends, at = text_arrays(batch.column(0).fill_null(LAST), batch.column(1))[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            own = batch.slice(at, to - at)
            sink = pa.BufferOutputStream()
            others = pa.RecordBatch.from_arrays(own.columns[2:], schema=pa.schema(list(own.schema)[2:])) if own.num_columns > 2 else own.select([0])
            with pa.ipc.new_stream(sink, others.schema) as w:
                w.write_batch(others)
            yield *next(batches([own], 1 << 62)), np.frombuffer(sink.getvalue(), np.uint8)
            at = to


def rest_of(arrays: list) -> pa.RecordBatch:
    """The other columns of a block that carries them."""
    return pa.ipc.open_stream(arrays[4].tobytes()).read_next_batch()


def stable(df: DataFrame) -> DataFrame:
    """df, whose rows come in the same order and partitions each time it is read: checkpointed if a shuffle could deal them anew."""
    return checkpointed(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


class Blocks:
    """The rows of df in blocks: numpy arrays of ids, null marks, offsets and UTF-8 bytes (and `rest` columns' bytes).

    A null text is empty.  A null id stands as the largest number, with its mark set.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, most: int = 4 << 20, rest: list[str] | None = None):
        src = stable(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"rest{n}") for n, c in enumerate(rest or []))))
        self.src, self.most, self.rest = src, most, rest is not None
        self.n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def slices(self, per: int = 12 << 20) -> int:
        """Number of hash slices, one for each `per` bytes of text: a slice's size doesn't grow with the input."""
        return max(6, -(-self.n_bytes // per))

    def _cut(self):
        most, parted = self.most, _with_rest if self.rest else batches

        def cut(parts):
            from pyspark import TaskContext

            base = TaskContext.get().partitionId() << 33
            for n, arrays in enumerate(parted(parts, most)):
                yield base + n, arrays

        return cut

    def each(self, work, schema: str) -> DataFrame:
        """work(blk, arrays) yields RecordBatches for every block, in the task that reads its rows."""
        cut = self._cut()

        def run(parts):
            for blk, arrays in cut(parts):
                yield from work(blk, arrays)

        return self.src.mapInArrow(trimmed(run), schema)

    def table(self) -> DataFrame:
        """One row per block."""
        return self.each(lambda blk, arrays: [arrow_rows(_BLOCKS, [(blk, pack(*arrays))])], BLOCK_SCHEMA)


def arrow_rows(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


CHUNKS = pa.schema([("blk", pa.int64()), ("q", pa.int32()), ("body", pa.binary())])


def slice_of(h: np.ndarray, q: int) -> np.ndarray:
    """Slice of each 64-bit hash, by its high bits."""
    return ((h >> np.uint64(32)) * np.uint64(q) >> np.uint64(32)).astype(np.int64)


def split_slices(which: np.ndarray, q: int):
    """Item numbers of each slice, in item order: yields (slice, item numbers)."""
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(q + 1))
    for k in range(q):
        if ends[k + 1] > ends[k]:
            yield k, order[ends[k] : ends[k + 1]]


def exchange(chunks: DataFrame, work, q: int, total=None) -> DataFrame:
    """Runs work(list of arrays per chunk, slice) -> list of packed answers over each slice; answers carry the chunk's blk and q.

    total(list of arrays per chunk, slice) gives one more answer a slice, whose blk is -1.  Without work there are only those.
    One task has one slice.
    """

    def run(parts):
        for k, rows in by_slice(parts):
            arrays = [unpack(x) for _, x in rows]
            if total:
                yield arrow_rows(CHUNKS, [(-1, k, total(arrays, k))])
            if work:
                for (b, _), answer in zip(rows, work(arrays, k), strict=True):
                    yield arrow_rows(CHUNKS, [(b, k, answer)])

    return chunks.repartitionById(q, F.col("q")).mapInArrow(trimmed(run), CHUNK_SCHEMA)


def by_slice(parts):
    """(slice, [(blk, body), ...] in the order of blk) of a mapInArrow input of chunks."""
    got: dict[int, list] = {}
    for batch in parts:
        for b, k, body in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            got.setdefault(k, []).append((b, body))
    for k in sorted(got):
        yield k, sorted(got.pop(k), key=lambda r: r[0])


def with_answers(blocks: DataFrame, answers: list[DataFrame], work, schema: str | StructType) -> DataFrame:
    """Brings every block together with its answers: work(blk, arrays, [{q: arrays} or numbers, ...]) yields RecordBatches.

    `answers` are told apart by their place in the list.  One with the columns (blk, number) instead of
    (blk, q, body) arrives as one array of numbers.
    """
    right = None
    for n, a in enumerate(answers):
        a = a.select("blk", F.lit(n).alias("n"), F.col("q").cast("long").alias("q"), "body") if "body" in a.columns else a.select("blk", F.lit(n).alias("n"), F.col("number").cast("long").alias("q"), F.lit(None).cast("binary").alias("body"))
        right = a if right is None else right.unionByName(a)
    plain = ["body" not in a.columns for a in answers]
    empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()

    def both(left: pa.Table, right: pa.Table):
        which, number = right.column("n").to_numpy(), right.column("q").to_numpy()
        got = []
        for n, numbers in enumerate(plain):
            if numbers:
                got.append(np.sort(number[which == n]))
            else:
                mine = right.filter(pa.array(which == n))
                got.append({k: unpack(x) for k, x in zip(mine.column("q").to_pylist(), mine.column("body").to_pylist(), strict=True)})
        out = [b for blk, body in zip(left.column("blk").to_pylist(), left.column("body").to_pylist(), strict=True) for b in work(blk, unpack(body), got)]
        trim()
        return pa.Table.from_batches(out) if out else empty

    return blocks.groupBy("blk").cogroup(right.groupBy("blk")).applyInArrow(both, schema)


def each_block(blocks: DataFrame, work, schema: str) -> DataFrame:
    """work(blk, arrays) yields RecordBatches for every row of a table of blocks."""

    def run(parts):
        for batch in parts:
            for blk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from work(blk, unpack(body))

    return blocks.mapInArrow(trimmed(run), schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage, in the shared folder that spark.checkpoint.dir names; where it is unset, only a local session may use a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", "") or None
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """df checkpointed with its rows dealt by blk, so that each later with_answers() reads it in place and shuffles the answers only.

    A checkpoint keeps its partitioning only if its plan isn't adaptive, so that is off while it is made.
    """
    spark = df.sparkSession
    conf, key = spark.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    try:
        conf.set(key, "false")
        return checkpointed(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), "blk"))
    finally:
        conf.set(key, before)
