"""Token ids of whole texts by a public byte-level vocabulary, by distinct parts.

The vocabulary's split pattern always starts a new piece at a single space between two
characters that aren't white space.  So a text is the concatenation of its space-separated
parts, and a run of texts needs the ids of its distinct parts only.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES, LONG_WORD = 8 << 20, 1000
SINGLE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def white(ends: pa.Array) -> np.ndarray:
    """Whether each of these single characters is white space, or is missing."""
    return pc.or_(pc.utf8_is_space(ends), pc.equal(pc.binary_length(ends), 0)).to_numpy(zero_copy_only=False)


def ranks_of(file: dict) -> dict[bytes, int] | None:
    """Ranks of a tokenizer file's tokens if its merges come in the order of their ids, after all bytes; else None."""
    model = file["model"]
    byte = {c: bytes([b]) for b, c in byte_alphabet().items()}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
    names = [*byte, *(a + b for a, b in pairs)]
    if any(x not in model["vocab"] or not byte.keys() >= set(x) for x in names):
        return None
    ids = [model["vocab"][x] for x in names]
    if max(ids[:256]) > min(ids[256:], default=256) or ids[256:] != sorted(set(ids[256:])):
        return None
    return {b"".join(byte[c] for c in x): i for x, i in zip(names, ids, strict=True)}


class Encoder:
    """Little-endian unsigned 32-bit ids as the tokenizers library gives them, special tokens' strings being ordinary text.

    many(texts) works a run of texts with a plain byte-level BPE file by its distinct parts, all in one
    call of a library that merges by rank; words over LONG_WORD go to the file's own model, whose time
    grows less than with the square of a word.  With any other file the library gets whole texts.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        plain = plain and all(x.get("special") for x in file.get("added_tokens") or []) and not file.get("truncation") and not file.get("padding")
        ranks = ranks_of(file) if plain else None
        self.plain = ranks is not None
        if self.plain:
            import public_tokenizers
            import tiktoken

            from .bpe import splitter

            self.find, self.alphabet = splitter(public_tokenizers.PATTERN), byte_alphabet()
            self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.n_bytes[list(ranks.values())] = list(map(len, ranks))

    @functools.cached_property
    def library(self):
        """The file in its own library, read when a text asks for it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def piece(self, piece: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def one(self, text: str) -> np.ndarray:
        """Ids of a string that stands alone."""
        if len(text) > LONG_WORD:
            return np.array([i for x in self.find(text) for i in self.piece(x)], "<u4")
        return self.merged(text)

    def merged(self, text: str) -> np.ndarray:
        return self.merge.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def ids(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not self.plain:
            return [np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts.to_pylist()]
        out, wrong = self.of_parts(pc.split_pattern(texts, " "))
        if wrong.size:
            again = [SINGLE.split(x) for x in texts.take(pa.array(wrong)).to_pylist()]
            for k, ids in zip(wrong.tolist(), self.of_parts(pa.array(again, pa.list_(pa.large_string())))[0], strict=True):
                out[k] = ids
        return out

    def of_parts(self, lists: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The ids of texts that are given as their parts at single spaces; numbers of the texts with a cut beside white space, whose ids are wrong."""
        offsets, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        if len(offsets) < 2:
            return [], np.zeros(0, np.int64)
        first, last, n_parts = offsets[:-1], offsets[1:] - 1, np.diff(offsets)
        words, which = coded.dictionary, coded.indices.to_numpy()
        before = white(pc.utf8_slice_codeunits(words, 0, 1))
        after = white(pc.utf8_slice_codeunits(words, -1))
        left, right = before[which], after[which]
        left[first] = right[last] = False
        wrong = np.logical_or.reduceat(left | right, first)

        # Parts after a text's first have their space; the ones that white space ends or that are long stand alone.
        used = ~np.repeat(wrong, n_parts)
        used[first] = False
        need = np.zeros(len(words), bool)
        need[which[used]] = True
        alone = need & (after | (pc.utf8_length(words).to_numpy() > LONG_WORD))
        begin, size = np.zeros((2, len(words) + len(first)), np.int64)
        store, at = [], 0
        together = np.flatnonzero(need & ~alone)
        if together.size:
            chosen = words.take(pa.array(together))
            ids = self.merged(" " + " ".join(chosen.to_pylist()))
            ends = np.cumsum(pc.binary_length(chosen).to_numpy().astype(np.int64) + 1)
            reach = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(reach, ends)
            if (reach[cuts] != ends).any():
                raise RuntimeError("a token crosses a cut")
            size[together] = np.diff(cuts + 1, prepend=0)
            begin[together] = cuts + 1 - size[together]
            store.append(ids)
            at = len(ids)
        rest = [(k, " " + words[k].as_py()) for k in np.flatnonzero(alone).tolist()]
        rest += [(len(words) + k, words[int(which[first[k]])].as_py()) for k in np.flatnonzero(~wrong).tolist()]
        for k, text in rest:
            ids = self.one(text)
            begin[k], size[k] = at, len(ids)
            store.append(ids)
            at += len(ids)
        which = which.copy()
        which[first] = len(words) + np.arange(len(first))

        n_ids = size[which]
        ends = np.cumsum(n_ids)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat((begin[which] - ends + n_ids).astype(kind), n_ids)
        place += np.arange(len(place), dtype=kind)
        flat = np.concatenate(store)[place].tobytes() if store else b""
        ends = 4 * ends[last]
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], np.flatnonzero(wrong)


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (id, text) of about RUN_BYTES of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to
