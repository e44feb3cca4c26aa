"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are exploded into pre-tokens with their positions, kept as one array of word numbers per
document.  A block's distinct words go to the slice of their hash, where each distinct word is
encoded once; the ids join the block again, and its documents are put together by position.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .tokens import SINGLE, white

BLOCK_BYTES = 8 << 20
# Unicode's White_Space, spelled out: what `\s` is in the pattern's own library.
WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """findall of the split pattern."""
    import regex

    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(pattern).findall


_made: dict = {}


def _library(path: str, pattern: str):
    """(encoding, ranks), kept by the worker."""
    if (path, pattern) not in _made:
        import tiktoken

        ranks = read_ranks(path)
        _made[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks
    return _made[path, pattern]


class Words:
    """A block's distinct pre-tokens, and its documents as numbers of them.

    The pattern always starts a new pre-token at a single space between two characters that aren't white space,
    so only the distinct space-separated parts of the block are split by it.
    """

    def __init__(self, arrays: list, pattern: str):
        self.ids, self.nulls, off, data = arrays
        self.number: dict[str, int] = {}
        find = splitter(pattern)
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(data)))
        self.docs, wrong = self._of_parts(pc.split_pattern(texts, " "), find)
        if len(wrong):
            again = [SINGLE.split(t) for t in texts.take(pa.array(wrong)).to_pylist()]
            for k, doc in zip(wrong.tolist(), self._of_parts(pa.array(again, pa.large_list(pa.large_string())), find)[0], strict=True):
                self.docs[k] = doc
        self.words = [w.encode() for w in self.number]
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def _of_parts(self, lists: pa.Array, find) -> tuple[list[np.ndarray], np.ndarray]:
        """Texts, given as their parts at spaces, as numbers of pre-tokens; and which texts have a cut beside white space (their numbers are wrong)."""
        offsets, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        if len(offsets) < 2:
            return [], np.zeros(0, np.int64)
        first, last = offsets[:-1], offsets[1:] - 1
        parts, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        left, right = white(pc.utf8_slice_codeunits(parts, 0, 1))[which], white(pc.utf8_slice_codeunits(parts, -1))[which]
        left[first] = right[last] = False
        wrong = np.logical_or.reduceat(left | right, first)
        which[first] += len(parts)  # a text's first part has no space before it
        which[np.repeat(wrong, np.diff(offsets))] = len(parts)  # any part that is there: these texts come again
        used, place = np.unique(which, return_inverse=True)
        number, flat, size = self.number, [], []
        for u, part in zip(used.tolist(), parts.take(pa.array(used % len(parts))).to_pylist(), strict=True):
            found = find(part if u >= len(parts) else " " + part)
            flat.extend([number.setdefault(w, len(number)) for w in found])
            size.append(len(found))
        flat, size = np.array(flat, np.uint32), np.array(size, np.int64)
        n = size[place]
        ends = np.cumsum(n)
        whole = flat[np.repeat((np.cumsum(size) - size)[place] - ends + n, n) + np.arange(int(ends[-1]))]
        return np.split(whole, ends[last[:-1]]), np.flatnonzero(wrong)

    def split(self, q: int):
        return B.split_slices(B.slice_of(self.hash, q), q)


def _encoded(path: str, pattern: str):
    def work(chunks: list, _: int) -> list[bytes]:
        encoding, _ = _library(path, pattern)
        encode = encoding._encode_single_piece if hasattr(encoding, "_encode_single_piece") else lambda w: encoding.encode_ordinary(w.decode())
        known: dict[bytes, bytes] = {}
        out = []
        for lens, data in chunks:
            raw, ends = data.tobytes(), np.cumsum(lens).tolist()
            ids = []
            for a, b in zip([0, *ends], ends, strict=False):
                w = raw[a:b]
                x = known.get(w)
                if x is None:
                    x = known[w] = np.array(encode(w), "<u4").tobytes()
                ids.append(x)
            out.append(B.pack(np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4")))
        return out

    return work


ENCODED = "doc_id long, ids binary"


def _with_ids(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    docs = B.Blocks(df, id_col, text_col, BLOCK_BYTES)
    q = docs.slices()

    def words(blk, arrays):
        block = Words(arrays, pattern)
        for k, n in block.split(q):
            own = [block.words[i] for i in n.tolist()]
            yield B.arrow_rows(B.CHUNKS, [(blk, k, B.pack(np.array([len(w) for w in own], np.uint32), np.frombuffer(b"".join(own), np.uint8)))])

    def together(blk, arrays, got):
        block = Words(arrays, pattern)
        count, first = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64)
        ids, size = [], 0
        for k, n in block.split(q):
            lens, own = got[0][k]
            count[n] = lens
            first[n] = size + np.cumsum(lens) - lens
            size += len(own)
            ids.append(own)
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")

        def each():
            for i, null, doc in zip(block.ids.tolist(), block.nulls.tolist(), block.docs, strict=True):
                c = count[doc]
                yield None if null else i, ids[np.repeat(first[doc] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]

        yield from finish(each())

    found = B.exchange(docs.each(words, B.CHUNK_SCHEMA), _encoded(path, pattern), q)
    return B.with_answers(docs.table(), [found], together, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row; null and empty texts have none.

    Each match of the pattern is encoded separately by the ranks, without special tokens.  Rows stay apart,
    so ids may repeat or be null.  Other columns are not read.
    """

    def finish(docs):
        rows = [(i, x.tobytes()) for i, x in docs]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return _with_ids(df, ranks_path, pattern, id_col, text_col, finish, ENCODED)


def token_table(path: str) -> list[bytes]:
    """The token-byte table: bytes by id, at most as many as the vocabulary has."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids, by a join with the token-byte table, whose size is the vocabulary's.  Null ids: null; an id that the table lacks is an error."""

    def run(parts):
        table = token_table(ranks_path)
        for batch in parts:
            out = [None if x is None else b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(B.trimmed(run), "doc_id long, bytes binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes, and returns the digests of both, without carrying ids or bytes any further."""

    def finish(docs):
        table = token_table(ranks_path)
        rows = [(i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(b"".join([table[t] for t in x.tolist()])).hexdigest()) for i, x in docs]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _with_ids(df, ranks_path, pattern, id_col, text_col, finish, DIGEST)
