"""Quality rules: counts over words and lines, and compression bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .kernels import SPACE, Hasher, U, mix, segments, words

CHUNK = 1024
LEVEL = 3
# Limits of compressed/plain bytes, by the text's bytes: (from this many bytes, least, most).  Below the
# first row any ratio passes; the frame of zstandard dominates there.  A text below `least` repeats itself
# or draws on few symbols; above `most` it looks random.  From 256 to 8191 bytes `least` is 0.012 below the
# lowest ratio of the texts of that length that are labelled good (3,243 texts; with limits from one half of
# them, that margin lost none of the other half); where fewer are labelled, it is a few hundredths below.
WHOLE = ((64, 0.55, 1.40), (128, 0.50, 1.10), (256, 0.528, 0.95), (512, 0.494, 0.85), (1024, 0.453, 0.80), (2048, 0.439, 0.78), (4096, 0.415, 0.75), (8192, 0.40, 0.75), (16384, 0.388, 0.75), (32768, 0.375, 0.75), (65536, 0.36, 0.75), (131072, 0.34, 0.75), (1048576, 0.30, 0.75))
# Limits of the mean ratio of the whole chunks, by how many there are.
CHUNKS = ((1, 0.490, 0.80), (2, 0.497, 0.78), (4, 0.502, 0.76), (16, 0.507, 0.75))
# Limits of what is left after the whole chunks, by its bytes: those of texts of that length, less a margin for a cut.
REST = tuple((size, low - 0.03, high + 0.10) for size, low, high in WHOLE)
# A chunk outside these is odd; a text may have this share of odd chunks.
ODD = (0.40, 0.85)
ODD_SHARE = 0.2

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
BLANK = b" \t\n\x0b\x0c\r"


def in_band(bands, size: int, ratio: float) -> bool:
    for least, low, high in reversed(bands):
        if size >= least:
            return low <= ratio <= high
    return True


def compression(text: bytes, squeeze, chunk: int = CHUNK) -> tuple[float, float, float, bool]:
    """(ratio of the text, mean ratio of its whole chunks, share of odd chunks with what is left after them, verdict); 1, 1, 0 where there is nothing."""
    n = len(text)
    if not n:
        return 1.0, 1.0, 0.0, True
    whole = len(squeeze(text)) / n
    ratios = [len(squeeze(text[i : i + chunk])) / chunk for i in range(0, n - chunk + 1, chunk)]
    if not ratios:
        return whole, 1.0, 0.0, in_band(WHOLE, n, whole)
    mean = sum(ratios) / len(ratios)
    rest = text[len(ratios) * chunk :]
    odd = sum(not ODD[0] <= r <= ODD[1] for r in ratios) + (bool(rest) and not in_band(REST, len(rest), len(squeeze(rest)) / len(rest)))
    odd /= len(ratios) + bool(rest)
    return whole, mean, odd, in_band(WHOLE, n, whole) and in_band(CHUNKS, len(ratios), mean) and odd <= ODD_SHARE


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANK):
            seen.add(line)
    return n


def counts(data: np.ndarray, off: np.ndarray):
    """n_words, word_chars, n_symbols and n_repeat_words of each document."""
    start, end, n = words(data, off)
    inner = np.concatenate([[0], np.cumsum(~SPACE[data] & ((data & 0xC0) != 0x80))])
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    h = Hasher(data)(start, end)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(h), bool)
    if len(h) > 2:
        three = mix(mix(mix(h[:-2] + doc[:-2].astype(U)) * U(3) + h[1:-1]) * U(5) + h[2:])
        own = np.flatnonzero(doc[:-2] == doc[2:])
        three = three[own]
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(three), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = own[twice]
        for k in range(3):
            again[at + k] = True
    return n, inner[off[1:]] - inner[off[:-1]], marks[off[1:]] - marks[off[:-1]], np.bincount(doc[again], minlength=len(n))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_ratio double, odd_chunks double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _rated(texts: pa.Array, squeeze) -> list[pa.Array]:
    """The columns of SCHEMA after doc_id."""
    _, off, data = B.text_arrays(pa.nulls(len(texts), pa.int64()).fill_null(0), texts)
    cols: list[list] = [[] for _ in range(10)]
    for a, b in segments(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        n, chars, marks, again = counts(part, o)
        raw = part.tobytes()
        plain = [raw[x:y] for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        bad = ((n < 50) | (100 * again > 50 * n)).tolist()
        bands = [compression(t, squeeze) for t in plain]
        own = (n.tolist(), chars.tolist(), marks.tolist(), [repeated_lines(t) for t in plain], again.tolist(), bad, [not x and y[3] for x, y in zip(bad, bands, strict=True)], *zip(*(y[:3] for y in bands), strict=True))
        for c, v in zip(cols, own, strict=True):
            c.extend(v)
    return [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3, strict=True)]


def _squeeze():
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress


def rate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df, with counts and the verdict `kept`.

    Null and empty texts have no words and fail.  Words are runs without the six ASCII white-space bytes;
    a line is equal to an earlier one byte by byte; three-word windows are compared by 64-bit hash, case and
    all.  Rows are rated one by one (no shuffle), so ids may repeat or be null; other columns are not read.
    """

    def run(parts):
        squeeze = _squeeze()
        for batch in parts:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_rated(batch.column(1), squeeze)], NAMES)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(B.trimmed(run), SCHEMA)


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose texts rate() keeps, with all their columns; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(parts):
        squeeze = _squeeze()
        for batch in parts:
            if batch.num_rows:
                yield batch.filter(_rated(batch.column(at), squeeze)[NAMES.index("kept") - 1])

    return df.mapInArrow(B.trimmed(run), df.schema)
