"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word is drawn in the restaurant of its context, the word before it (at the start of a text, the
end of texts).  Every training word is a context of its own.  All context restaurants have one
parent, whose customers are their tables; its own parent is uniform over the known words and one
unknown word.  A context that training lacks has no customers, so there the parent speaks alone.

Customers are counted over all training texts, in slices of the words' hashes, so that a word's
customers in all restaurants and in the parent lie in one slice.  A context's tables are added up in
the slice of the context's hash: each round, the words' slices send them their sums and get the
totals of those contexts back that they seat anyone in.  A customer who is alone with their dish
has one table for good, so after the start only tables beyond a dish's first one are sent.  The
driver gathers totals only.

Chinese-restaurant seating is sampled by Gibbs, a sweep a round: the customers of a dish leave and
are seated again, given the other dishes' tables and the parent as of the last round.  All that
counts of a seating is its number of tables t, whose chance, for c customers, is in proportion to
S(c, t) times the chance of t new tables, S being generalised Stirling numbers.  The discount is 1/2
on both levels, for which S(c, t+1) / S(c, t) = 2 (c-t) / ((2c-t-1) t): t is drawn from its exact
distribution for any c.  Draws depend on the dish and the round alone, so scores don't
depend on how the job is divided.  Predictive probabilities are averaged over the rounds after the burn-in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .kernels import LOWER, Hasher, U, mix, segments, words

BLOCK_BYTES = 16 << 20
ROUNDS, BURN_IN = 3, 1
STRENGTH, DISCOUNT = 1.0, 0.5  # the closed form of tables() holds for this discount
END = U(0xE4D0E4D0E4D0E4D1)
KEY = U(0xFFFFFFFFFFFF0000)  # a context is told apart by these bits of its word's hash


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class Texts:
    """A block's tokens: word hashes with an end after each text."""

    def __init__(self, arrays: list):
        self.ids, self.nulls, off, data = arrays
        hs, ns = [], []
        for a, b in segments(off):
            part, o = LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
            start, end, n = words(part, o)
            hs.append(Hasher(part)(start, end))
            ns.append(n)
        n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
        self.n = n + 1
        self.ends = np.cumsum(self.n)
        total = int(self.ends[-1]) if len(n) else 0
        self.h = np.full(total, END, U)
        word = np.ones(total, bool)
        word[self.ends - 1] = False
        if total:
            self.h[word] = np.concatenate(hs)
        self.held = np.array([held_out(i) for i in self.ids.tolist()], bool)
        self.train = ~np.repeat(self.held | self.nulls, self.n)
        self.words, self.at = np.unique(self.h, return_inverse=True)

    def slices(self, q: int) -> np.ndarray:
        """Bounds of the slices among the block's words."""
        return np.searchsorted(B.slice_of(self.words, q), np.arange(q + 1))

    def pairs(self):
        """Distinct (word, context) of the block in order: word numbers of both, training counts, and each token's pair."""
        size = max(1, len(self.words))
        before = np.roll(self.at, 1)  # an end stands before each text, the last one's before the first
        code, pair = np.unique(self.at * size + before, return_inverse=True)
        return code // size, code % size, np.bincount(pair[self.train], minlength=len(code)), pair


def _count(chunks: list, _: int) -> list[bytes]:
    """Training counts of each chunk's words."""
    h = np.concatenate([c[0] for c in chunks])
    _, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, np.concatenate([c[1] for c in chunks])).astype(np.int64)[at] if len(h) else h.astype(np.int64)
    return [B.pack(small(x)) for x in np.split(n, np.cumsum([len(c[0]) for c in chunks])[:-1])]


def _known(chunks: list, _: int) -> bytes:
    """The slice's types and tokens."""
    h = np.concatenate([c[0] for c in chunks])
    n = np.concatenate([c[1] for c in chunks])
    return B.pack(np.array([len(np.unique(h[n > 0])), int(n.sum())]))


class Model:
    """What all slices know: vocabulary size, and the root's customers and tables after each round."""

    def __init__(self, types, tokens):
        self.types, self.tokens = types, tokens
        self.root: list[tuple[float, float]] = []

    def prior(self) -> float:
        return 1.0 / (self.types + 1)


class Customers:
    """A slice's words and customers, and where each chunk's words and pairs are among them."""

    def __init__(self, chunks: list):
        """chunks: words, pairs of each, the pairs' context hashes, training counts."""
        self.words, at = np.unique(np.concatenate([c[0] for c in chunks]), return_inverse=True)
        self.contexts, context = np.unique(np.concatenate([c[2] for c in chunks]), return_inverse=True)
        word = np.repeat(at, np.concatenate([c[1] for c in chunks]))
        size = max(1, len(self.contexts))
        code, place = np.unique(word * size + context, return_inverse=True)
        n = np.bincount(place, np.concatenate([c[3] for c in chunks]), len(code)).astype(np.int64)
        seated = n > 0
        # Pairs in the order: some training, many (n > 1) first; others have the number after the last.
        order = np.concatenate([np.flatnonzero(n > 1), np.flatnonzero(n == 1)])
        number = np.full(len(code), len(order))
        number[order] = np.arange(len(order))
        self.word, self.context, self.n = (code // size)[order], (code % size)[order], n[order]
        self.many = int((n > 1).sum())
        self.root = np.bincount((code // size)[seated], minlength=len(self.words))
        self.at = np.split(at, np.cumsum([len(c[0]) for c in chunks])[:-1])
        self.place = np.split(number[place], np.cumsum([len(c[2]) for c in chunks])[:-1])


def uniform(word: np.ndarray, context: np.ndarray | None, r: int) -> np.ndarray:
    """A number of [0, 1) for each dish (word in context, or at the root) and round."""
    h = mix(word + U((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (mix(h + (mix(context) if context is not None else U(1))) >> U(11)).astype(float) / (1 << 53)


def tables(c: np.ndarray, others: np.ndarray, new: np.ndarray, u: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Draws the tables of dishes with c customers, by the uniform numbers u.

    others: the restaurant's tables of other dishes; new: the parent's probability of the dish.  The chances
    of t and t+1 are as 1 to 2 new (c-t) (2 STRENGTH + others + t) / ((2c-t-1) t), which falls with t, so they
    have one peak; what is left out around it is below the last bit.
    """
    out = np.ones(len(c))
    g = 2 * new
    # Peak: g (c-t)(s+t) = (2c-1-t) t, that is (1-g) t^2 - (2c-1 - g (c-s)) t + g c s = 0.
    s = 2 * STRENGTH + others
    q2, q1, q0 = 1 - g, 2 * c - 1 - g * (c - s), g * c * s
    peak = np.clip(2 * q0 / (q1 + np.sqrt(np.maximum(q1 * q1 - 4 * q2 * q0, 0))), 1, c)
    spread = 1 / np.sqrt(1 / peak - 1 / (s + peak) + 1 / np.maximum(c - peak, 0.5) - 1 / np.maximum(2 * c - 1 - peak, 1) + 1e-300)
    reach = np.ceil(10 * np.minimum(spread, c) + 60)
    lo, hi = np.maximum(1, np.floor(peak - reach)), np.minimum(c, np.ceil(peak + reach))
    size = (hi - lo + 1).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(c):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        who = np.repeat(np.arange(at, to), n)
        t = np.arange(len(who)) - np.repeat(first, n) + lo[who]
        with np.errstate(divide="ignore"):
            step = np.log(g[who] * (c[who] - t + 1) * (s[who] + t - 1) / ((2 * c[who] - t) * np.maximum(t - 1, 1)))
        step[first] = 0
        w = np.cumsum(step)
        w -= np.repeat(w[first], n)
        w = np.exp(w - np.repeat(np.maximum.reduceat(w, first), n))
        total = np.cumsum(w)
        below = total[first] - w[first]
        chosen = np.searchsorted(total, below + u[at:to] * (total[first + n - 1] - below), side="right")
        out[at:to] = t[np.clip(chosen, first, first + n - 1)]
        at = to
    return out


class Seating:
    """Tables of each dish (word, context) with some customers, and of each word at the root.

    once: how many dishes of one customer each word has.
    """

    def __init__(self, word: np.ndarray, n: np.ndarray, once: np.ndarray, model: Model, t: np.ndarray | None = None, root_t: np.ndarray | None = None):
        self.m, self.word, self.n, self.once = model, word, n.astype(float), once
        self.t = np.ceil(np.sqrt(self.n)) if t is None else t.astype(float)
        self.enter()
        self.root_t = np.where(self.root_n > 0, np.ceil(np.sqrt(self.root_n)), 0.0) if root_t is None else root_t.astype(float)

    def enter(self) -> None:
        """The tables are the root's customers."""
        self.root_n = self.once + np.bincount(self.word, self.t, len(self.once))

    def root(self, r: int) -> np.ndarray:
        """Each word's probability at the root, given the totals after round r."""
        customers, held = self.m.root[r]
        return (np.maximum(self.root_n - DISCOUNT * self.root_t, 0) + (STRENGTH + DISCOUNT * held) * self.m.prior()) / (STRENGTH + customers)

    def round(self, r: int, held: np.ndarray, words: np.ndarray, contexts: np.ndarray) -> None:
        """Seats all customers again, given the totals after round r; held: the tables of each dish's context."""
        if len(self.n):
            self.t = tables(self.n, held - self.t, self.root(r)[self.word], uniform(words[self.word], contexts, r))
        self.enter()
        j = np.flatnonzero(self.root_n > 0)
        here = self.m.root[r][1] - self.root_t[j]
        self.root_t[j] = tables(self.root_n[j], here, np.full(len(j), self.m.prior()), uniform(words[j], None, r))

    def totals(self) -> np.ndarray:
        return np.array([self.root_n.sum(), self.root_t.sum()])


def present(bounds: np.ndarray) -> list[int]:
    """The slices that have words: as many as there are words, at most, however many slices there are."""
    return np.flatnonzero(np.diff(bounds)).tolist()


def total(df: DataFrame, columns: int) -> list[int]:
    """Sums of whole numbers packed in the bodies of df."""
    names = [f"c{n}" for n in range(columns)]

    def run(parts):
        for batch in parts:
            for body in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in B.unpack(body)[0]], names)

    row = df.select("body").mapInArrow(B.trimmed(run), ", ".join(f"{n} long" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).first()
    return list(row)


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability).

    Learns from the rows whose crc32(id as text) mod 5 is not 1, and scores all.  Tokens are words without
    ASCII white space, A-Z lower-cased, and one end a text, which is all that a null or empty text has.  Words
    are told apart by 64-bit hash, as contexts by 48 bits of it.  Ids may repeat (each row counts).  A row with a null id is scored but not
    learned from, and its held_out is null.  An empty table gives no rows.  Other columns are not read.
    """
    docs = B.Blocks(df, id_col, text_col, BLOCK_BYTES)
    q = docs.slices()
    table = docs.table()

    def unigrams(blk, arrays):
        x = Texts(arrays)
        n = np.bincount(x.at[x.train], minlength=len(x.words))
        bounds = x.slices(q)
        for k in present(bounds):
            s = slice(bounds[k], bounds[k + 1])
            yield B.arrow_rows(B.CHUNKS, [(blk, k, B.pack(x.words[s], small(n[s])))])

    counted = B.checkpointed(B.exchange(docs.each(unigrams, B.CHUNK_SCHEMA), _count, q, _known))
    types, tokens = total(counted.filter("blk = -1"), 2)
    model = Model(types, tokens)

    def bigrams(blk, arrays):
        x = Texts(arrays)
        word, context, n, _ = x.pairs()
        bounds = x.slices(q)
        ends = np.searchsorted(word, bounds)
        for k in present(bounds):
            s, t = slice(bounds[k], bounds[k + 1]), slice(ends[k], ends[k + 1])
            per = np.bincount(word[t] - bounds[k], minlength=int(bounds[k + 1] - bounds[k]))
            yield B.arrow_rows(B.CHUNKS, [(blk, k, B.pack(x.words[s], small(per), x.words[context[t]] & KEY, small(n[t])))])

    def customers(chunks):
        c = Customers(chunks)
        places = [B.pack(small(a), small(p)) for a, p in zip(c.at, c.place, strict=True)]
        seen, first = np.bincount(c.context, minlength=len(c.contexts)), np.bincount(c.context[: c.many], minlength=len(c.contexts))
        need = np.flatnonzero(first)
        number = np.zeros(len(c.contexts), np.int64)
        number[need] = np.arange(len(need))
        once = np.bincount(c.word[c.many :], minlength=len(c.words))
        own = B.pack(c.words, small(c.word[: c.many]), small(number[c.context[: c.many]]), small(c.n[: c.many]), small(once), c.contexts[need], np.array([len(c.n)]))
        return places, own, B.pack(c.contexts[seen > 0], small(seen[seen > 0]))

    def gathered(parts):
        """Each slice: its customers (blk -1), its contexts' distinct words (blk -2), and each chunk's places."""
        for k, rows in B.by_slice(parts):
            places, own, seen = customers([B.unpack(x) for _, x in rows])
            yield B.arrow_rows(B.CHUNKS, [(-1, k, own)])
            yield B.arrow_rows(B.CHUNKS, [(-2, k, seen)])
            for (b, _), x in zip(rows, places, strict=True):
                yield B.arrow_rows(B.CHUNKS, [(b, k, x)])

    chunks = docs.each(bigrams, B.CHUNK_SCHEMA)
    held = B.checkpointed(chunks.repartitionById(q, F.col("q")).mapInArrow(B.trimmed(gathered), B.CHUNK_SCHEMA))
    slices = held.filter("blk = -1").select(F.col("q").cast("long").alias("blk"), "body")

    def sent(k, s, context, contexts):
        """Rows of a slice after a round: its tables (q -1), its totals (q -2), and each context's tables beyond the dishes' first."""
        yield B.arrow_rows(B.CHUNKS, [(k, -1, B.pack(small(s.t), small(s.root_t)))])
        yield B.arrow_rows(B.CHUNKS, [(k, -2, B.pack(s.totals()))])
        more = np.bincount(context, s.t - 1, len(contexts))
        for j, own in B.split_slices(B.slice_of(contexts, q), q):
            yield B.arrow_rows(B.CHUNKS, [(k, j, B.pack(contexts[own], small(more[own])))])

    def seated(k, arrays):
        _, word, context, n, once, contexts, _ = arrays
        yield from sent(k, Seating(word, n, once, model), context, contexts)

    def distinct(parts):
        """Each context's distinct words, to the context's slice."""
        for batch in parts:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                contexts, seen = B.unpack(body)
                for j, own in B.split_slices(B.slice_of(contexts, q), q):
                    yield B.arrow_rows(B.CHUNKS, [(k, j, B.pack(contexts[own], seen[own]))])

    def summed(chunks):
        h, at = np.unique(np.concatenate([c[0] for c in chunks]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([c[1] for c in chunks]), len(h)).astype(np.int64), at

    def whole(chunks, _):
        """A slice's contexts and their tables: the dishes' first ones, or those beyond."""
        h, total, _ = summed(chunks)
        return B.pack(h, small(total))

    def added(chunks, _):
        """The tables of each chunk's contexts; a chunk of three arrays holds the first ones."""
        base = [c for c in chunks if len(c) == 3]
        ask = [c for c in chunks if len(c) == 2]
        if not ask:
            return [B.pack() for _ in chunks]
        h, total, at = summed(ask)
        if base:
            total = total + base[0][1][np.searchsorted(base[0][0], h)]
        split = iter(np.split(total[at], np.cumsum([len(c[0]) for c in ask])[:-1]))
        return [B.pack() if len(c) == 3 else B.pack(small(next(split))) for c in chunks]

    def beyond(chunks, k):
        return whole([c for c in chunks if len(c) == 2] or [(np.zeros(0, U), np.zeros(0, np.int64))], k)

    # First tables of each context: as many as distinct words follow it.
    mine = held.filter("blk = -2").select(F.col("q").cast("long").alias("blk"), "body").mapInArrow(B.trimmed(distinct), B.CHUNK_SCHEMA)
    firsts = B.checkpointed(B.exchange(mine, None, q, whole))

    def tagged(parts):
        for batch in parts:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield B.arrow_rows(B.CHUNKS, [(-3, k, B.pack(*B.unpack(body), np.zeros(1, np.int8)))])

    bases = firsts.select("q", "body").mapInArrow(B.trimmed(tagged), B.CHUNK_SCHEMA)

    def seat(r):
        def work(k, arrays, got):
            words, word, context, n, once, contexts, _ = arrays
            t, root_t = got[0][-1]
            held = np.zeros(len(contexts))
            for j, own in B.split_slices(B.slice_of(contexts, q), q):
                held[own] = got[0][j][0]
            s = Seating(word, n, once, model, t, root_t)
            s.round(r, held[context], words, contexts[context])
            yield from sent(k, s, context, contexts)

        return work

    states = [B.checkpointed(B.each_block(slices, seated, B.CHUNK_SCHEMA))]
    totals = []
    for r in range(ROUNDS + 1):
        if r:
            states.append(B.checkpointed(B.with_answers(slices, [states[-1].filter("q = -1").unionByName(totals[-1].filter("blk >= 0"))], seat(r - 1), B.CHUNK_SCHEMA)))
        model.root.append(tuple(map(float, total(states[r].filter("q = -2"), 2))))
        totals.append(B.checkpointed(B.exchange(states[r].filter("q >= 0").unionByName(bases), added, q, beyond)))

    def predicted(parts):
        """For each chunk: its pairs' customers and tables, and its words' root probabilities and tables as contexts, in each round that counts."""
        got: dict[int, list] = {}
        for batch in parts:
            for n, b, k, body in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                got.setdefault(k, []).append((n, b, body))
        for k in sorted(got):
            rows = got.pop(k)
            own = {n: B.unpack(body) for n, _, body in rows if n}
            words, word, _, n, once, _, few = own[1]

            def at_words(contexts, values, words=words):
                out = np.zeros(len(words))
                if len(contexts):
                    k = np.minimum(np.searchsorted(contexts, words & KEY), len(contexts) - 1)
                    same = contexts[k] == words & KEY
                    out[same] = values[k[same]]
                return out

            first = at_words(*own[2]) if 2 in own else np.zeros(len(words))
            kept, root, held = [], [], []
            rest = int(few[0]) - len(n)
            for r in range(BURN_IN + 1, ROUNDS + 1):
                t, root_t = own[2 * r + 1]
                kept.append(small(np.concatenate([t, np.ones(rest, np.int64), [0]]).astype(np.int64)))
                root.append(Seating(word, n, once, model, t, root_t).root(r))
                more = first.copy()
                if 2 * r + 2 in own:
                    more += at_words(*own[2 * r + 2])
                held.append(more)
            count = small(np.concatenate([n, np.ones(rest, np.int64), [0]]).astype(np.int64))
            for kind, b, body in rows:
                if not kind:
                    at, place = B.unpack(body)
                    yield B.arrow_rows(B.CHUNKS, [(b, k, B.pack(count[place], *(x[place] for x in kept), *(x[at] for x in root), *(small(x[at].astype(np.int64)) for x in held)))])

    def tag(df, n, blk="blk", k="q"):
        return df.select(F.lit(n).alias("n"), F.col(blk).cast("long").alias("blk"), F.col(k).cast("int").alias("q"), "body")

    asked = tag(held.filter("blk >= 0"), 0).unionByName(tag(held.filter("blk = -1"), 1)).unionByName(tag(firsts, 2))
    for r in range(BURN_IN + 1, ROUNDS + 1):
        asked = asked.unionByName(tag(states[r].filter("q = -1"), 2 * r + 1, "q", "blk")).unionByName(tag(totals[r].filter("blk = -1"), 2 * r + 2))
    answers = asked.repartitionById(q, F.col("q")).mapInArrow(B.trimmed(predicted), B.CHUNK_SCHEMA)
    smooth = tokens + 0.5 * (types + 1)
    rounds = ROUNDS - BURN_IN

    def scored(blk, arrays, got):
        x = Texts(arrays)
        word, context, _, pair = x.pairs()
        bounds = x.slices(q)
        ends = np.searchsorted(word, bounds)
        n, p = np.zeros(len(x.words), np.int64), np.zeros(len(word))
        root, held = np.zeros((rounds, len(x.words))), np.zeros((rounds, len(x.words)))
        count, kept = np.zeros(len(word)), np.zeros((rounds, len(word)), np.int64)
        for k in present(bounds):
            w, e, a = slice(bounds[k], bounds[k + 1]), slice(ends[k], ends[k + 1]), got[1][k]
            n[w], count[e] = got[0][k][0], a[0]
            for r in range(rounds):
                kept[r, e], root[r, w], held[r, w] = a[1 + r], a[1 + rounds + r], a[1 + 2 * rounds + r]
        for r in range(rounds):
            p += (count - DISCOUNT * kept[r] + (STRENGTH + DISCOUNT * held[r][context]) * root[r][word]) / (STRENGTH + n[context])
        p = np.log10(p / rounds)
        first = x.ends - x.n
        base = np.add.reduceat(np.log10((n + 0.5) / smooth)[x.at], first)
        whole, known = np.add.reduceat(p[pair], first), np.add.reduceat((n > 0)[x.at].astype(np.int64), first)
        cols = (x.ids, x.held, x.n, known, np.full(len(x.ids), tokens), base, whole)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type, mask=x.nulls if f.name in ("doc_id", "held_out") else None) for c, f in zip(cols, RESULT, strict=True)], schema=RESULT)

    return B.with_answers(table, [counted.filter("blk >= 0"), answers], scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
