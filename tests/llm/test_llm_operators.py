"""Every operator against brute force on small tables with nulls, empty and repeated texts, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from figmill.llm import bpe, components, lm, matrices, metric_join, ngram_join, packing, quality, quotes, suffix_dedup, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "a  b", " a", "a\n b \n", "été  naïve's x\x1cy", "<|endoftext|> x", "x" * 3000, "日本 語\r\n", "don't  'll 12,345 -- end "]


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß'1,.") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 300))) for _ in range(12)]
    return ODD + base + [rnd.choice(base) if rnd.random() < 0.5 else rnd.choice(base)[: rnd.randint(1, 900)] for _ in range(n)]


def frame(spark, values, parts=3):
    rows = [(7 * i + 3, v, i, "z") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, blk string").repartition(parts)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_packing(spark, encode):
    values = texts()
    got = packing.pack_documents(frame(spark, values), JSON).toPandas()
    ids = {7 * i + 3: np.array(encode(v) + [0], "<u4") for i, v in enumerate(values)}
    assert set(got.doc_id) == set(ids)
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert list(g.start) == list(np.cumsum(g.length) - g.length) and g.length.sum() == len(ids[i]) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[i][s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)
        n = g.length.sum()
        assert n == g.sequence_length.iloc[0] <= 1024 and n & n - 1 == 0


def test_packing_of_lengths():
    rnd = random.Random(2)
    for lengths in ([], [1], [1024], [1025, 3], [rnd.randint(1, 3000) for _ in range(300)], [600] * 50, [5] * 7):
        seen = collections.Counter()
        for w in packing.pack(lengths):
            assert w.used == w.size == sum(n for _, _, n in w.pieces)
            for d, s, n in w.pieces:
                seen.update((d, k) for k in range(s, s + n))
        assert seen == collections.Counter((d, k) for d, n in enumerate(lengths) for k in range(n))


def test_matrices(spark, encode):
    values = texts()
    got = matrices.to_matrices(frame(spark, values), JSON, width=64).collect()
    ids, back = {7 * i + 3: encode(v) + [50256] for i, v in enumerate(values)}, collections.defaultdict(dict)
    for r in got:
        row, at = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(row) == len(at) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back[d][s] = row[a:b].tolist()
            assert at[a:b].tolist() == list(range(b - a))
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in back.items()} == ids


def test_best_fit():
    rnd = random.Random(4)
    for _ in range(20):
        lengths = [rnd.randint(1, 40) for _ in range(60)]
        left, want = [], 0
        for n in sorted(lengths, reverse=True):
            fit = [x for x in left if x >= n]
            if fit:
                left.remove(min(fit))
                left.append(min(fit) - n)
            else:
                left.append(40 - n)
                want += 1
        assert len(matrices.best_fit_decreasing(lengths, 40)) == want


def test_byte_bpe(spark):
    import tiktoken

    values = texts()
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, values), RANKS, P.PATTERN).collect()}
    coded = bpe.encode(frame(spark, values), RANKS, P.PATTERN)
    plain = {r.doc_id: bytes(r["bytes"]) for r in bpe.decode(coded, RANKS).collect()}
    for i, v in enumerate(values):
        ids = np.array(e.encode_ordinary(v or ""), "<u4")
        r = got[7 * i + 3]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((v or "").encode()).hexdigest())
        assert plain[7 * i + 3] == (v or "").encode()


@pytest.mark.parametrize("length", [8, 100])
def test_suffix_dedup(spark, length):
    values, seen, want = texts(3), set(), {}
    for i, v in enumerate(values):
        b = (v or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            if x in seen:
                gone[p : p + length] = [True] * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[7 * i + 3] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept)
    got = suffix_dedup.remove_repeats(frame(spark, values), length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == want


def test_quality(spark):
    values = texts() + ["one two three four " * 40, "good line\nother\ngood line\n \n \n", "a a a a"]
    for r in quality.rate(frame(spark, values)).collect():
        t = values[(r.doc_id - 3) // 7] or ""
        w = WORD.findall(t)
        three = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(three)
        again = {k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality.keep(frame(spark, values))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.rate(frame(spark, values)).collect() if r.kept}


def test_quality_verdict(spark):
    """Kept as computed chunk by chunk from the limits alone."""
    import zstandard

    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(40, 900))) for _ in range(30)]
    values = prose + [" ".join(rnd.choice(words[:9]) for _ in range(400)) for _ in range(5)] + [p + " " + "".join(rnd.choice("0123456789abcdef") for _ in range(700)) for p in prose[:5]] + [p + " spam" * 180 for p in prose[:5]]
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=False).compress

    def allowed(bands, size, ratio):
        own = [(lo, hi) for at, lo, hi in bands if size >= at]
        return not own or own[-1][0] <= ratio <= own[-1][1]

    verdicts = []
    for r in quality.rate(frame(spark, values)).collect():
        t = values[(r.doc_id - 3) // 7].encode()
        chunks = [t[i : i + 1024] for i in range(0, len(t), 1024)]
        ratio = [len(squeeze(c)) / len(c) for c in chunks]
        good = allowed(quality.WHOLE, len(t), len(squeeze(t)) / len(t))
        if len(t) >= 1024:
            full = [x for c, x in zip(chunks, ratio) if len(c) == 1024]
            odd = sum(not 0.40 <= x <= 0.85 if len(c) == 1024 else not allowed([(n, lo - 0.03, hi + 0.10) for n, lo, hi in quality.WHOLE], len(c), x) for c, x in zip(chunks, ratio))
            good &= allowed(quality.CHUNKS, len(full), sum(full) / len(full)) and odd / len(chunks) <= 0.2
        assert r.kept == (good and not r.base_failed), r
        verdicts.append(r.kept)
    assert 5 < sum(verdicts) < len(verdicts) - 5


@pytest.mark.parametrize("k, num", [(4, 85), (2, 60)])
def test_ngram_join(spark, k, num):
    rnd = random.Random(k)
    base = [[str(rnd.randint(0, 300)) for _ in range(rnd.randint(1, 70))] for _ in range(15)]
    values = ODD[:6]
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w.insert(rnd.randrange(len(w) + 1), "X" + str(rnd.randint(0, 5)))
        values.append(" ".join(w))
    sets = []
    for v in values:
        w = WORD.findall((v or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in range(20):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, values), k=k, num=num).collect()}
    assert got == {7 * i + 3: (len(s), 7 * root[i] + 3) for i, s in enumerate(sets)}


@pytest.mark.parametrize("homes", [0, 8])
def test_ngram_tiles(spark, monkeypatch, homes):
    monkeypatch.setattr(ngram_join, "TILE", 5)
    monkeypatch.setattr(ngram_join, "HOMES", homes)
    test_ngram_join(spark, 2, 60)


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 20)
    monkeypatch.setattr(metric_join, "TILE", 16)
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + rnd.normal(size=8) * rnd.choice([0.0, 0.05, 0.1, 0.2])).astype("float32").tolist(), int(i % 12 % 3)) for i in range(200)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, rows[0][1], None), (205, [2 * x for x in rows[0][1]], 0), (206, [1.0, 0.0], 0), (207, [], 0), (208, [float("inf")] * 8, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(df, least=0.98).collect()}

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, link = len(rows) - 1, {}
    for i in range(n):
        link[i] = [j for j in range(n) if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and usable(rows[i][1]) and usable(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(np.array(rows[i][1], float)) / np.linalg.norm(np.array(rows[j][1], float)) >= 0.98]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(n)]
    assert got.pop(None) == (0, None, None)
    assert got == {i: (len(link[i]), comp[i], comp[i] == i) for i in range(n)}


def test_metric_join_does_not_copy_patternless_vectors(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 100)
    went, cells = [], metric_join._cells
    monkeypatch.setattr(metric_join, "_cells", lambda placed, *rest: went.append(placed.count()) or cells(placed, *rest))
    x = np.random.default_rng(2).normal(size=(800, 48))
    x[400:410] = x[:10] * 3 + 0.01
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & ~np.eye(800, dtype=bool)
    assert link.sum() == 20
    assert got == {i: (int(link[i].sum()), min([i, *np.flatnonzero(link[i]).tolist()])) for i in range(800)}
    assert went[0] <= 2 * 800


def test_metric_join_of_repeated_ids_and_many_levels(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 12)
    monkeypatch.setattr(metric_join, "PIVOTS", 3)
    monkeypatch.setattr(metric_join, "DEAL", 50)
    rnd = np.random.default_rng(5)
    centre = rnd.normal(size=(60, 6))
    rows = [(i % 290, (centre[i % 60] + rnd.normal(size=6) * 0.1).tolist(), 0) for i in range(300)]
    got = metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    x = np.array([v / np.linalg.norm(v) for _, v, _ in rows])
    link = (x @ x.T >= 0.98) & ~np.eye(300, dtype=bool)
    comp = [i for i, *_ in rows]
    for _ in range(20):
        comp = [min([c, *(comp[j] for j in np.flatnonzero(link[i]))]) for i, c in enumerate(comp)]
    assert sorted(tuple(r) for r in got) == sorted((rows[i][0], int(link[i].sum()), comp[i], comp[i] == rows[i][0]) for i in range(300))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (300, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 300: 300}


def test_language_model(spark):
    values = texts()
    got = {r.doc_id: r for r in lm.score(frame(spark, values)).collect()}
    tokens = {7 * i + 3: [*WORD.findall((v or "").translate(LOWER)), ""] for i, v in enumerate(values)}
    n = collections.Counter(t for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in x)
    total = sum(n.values())
    for i, x in tokens.items():
        r = got[i]
        base = sum(math.log10((n[t] + 0.5) / (total + 0.5 * (len(n) + 1))) for t in x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(x), sum(n[t] > 0 for t in x), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def seatings(c, d):
    """Weight of all seatings of c customers by their number of tables, one by one."""
    out = collections.Counter()

    def seat(n, sizes, weight):
        if n == c:
            out[len(sizes)] += weight
            return
        for k, size in enumerate(sizes):
            seat(n + 1, [*sizes[:k], size + 1, *sizes[k + 1 :]], weight * (size - d))
        seat(n + 1, [*sizes, 1], weight)

    seat(0, [], 1.0)
    return out


@pytest.mark.parametrize("c, others, new", [(1, 3, 0.1), (2, 0, 0.5), (5, 7, 0.01), (7, 100, 0.3), (8, 4, 0.9)])
def test_tables_are_drawn_from_all_seatings(c, others, new):
    weight = {t: w * math.prod(lm.STRENGTH + lm.DISCOUNT * (others + i) for i in range(t)) * new**t for t, w in seatings(c, lm.DISCOUNT).items()}
    u = (np.arange(20000) + 0.5) / 20000
    got = collections.Counter(lm.tables(np.full(len(u), float(c)), np.full(len(u), float(others)), np.full(len(u), new), u, most=1000))
    for t, w in weight.items():
        assert abs(got[t] / len(u) - w / sum(weight.values())) < 2e-4, (t, got)


def test_tables_of_many_customers():
    """Against the recurrence of the generalised Stirling numbers, S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    s = [1]  # times 2^c, as whole numbers
    for c in range(1, 400):
        s = [2 * (s[t - 1] if t else 0) + ((2 * c - t - 1) * s[t] if t < len(s) else 0) for t in range(c + 1)]
    u = (np.arange(4000) + 0.5) / 4000
    for others, new in ((5.0, 1e-4), (3000.0, 0.02), (1e5, 0.5)):
        weight = np.array([math.log(x) if x else -math.inf for x in s]) + np.cumsum(np.log((1 + 0.5 * (others + np.arange(400))) * new))
        p = np.exp(weight - weight.max())
        mean = (p * np.arange(1, 401)).sum() / p.sum()
        got = lm.tables(np.full(len(u), 400.0), np.full(len(u), others), np.full(len(u), new), u)
        assert abs(got.mean() - mean) < 0.02 * max(1, mean ** 0.5)
    huge = lm.tables(np.array([1e9]), np.array([1e6]), np.array([1e-3]), np.array([0.5]))
    assert 1 < huge[0] < 1e9


def test_language_model_at_any_partition_count(spark):
    values = texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n, parts in ((3, 2), (7, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.doc_id: r.score for r in lm.score(frame(spark, values, parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_null_ids(spark):
    """A null id's row keeps a result of its own."""
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, a), (4, a), (None, None), (2, a + " x"), (None, a)], "doc_id long, text string").coalesce(1)
    cut = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in cut) == [(0, 0, 0), (0, len(a), len(a)), (0, len(a), len(a)), (2, len(a) + 2, 0), (4, len(a), len(a))]
    joined = ngram_join.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in joined) == [(0, 0, 0), (0, 56, 0), (0, 56, 0), (2, 57, 2), (4, 56, 2)]
    coded = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0) for r in coded) == [0, 0, 0, 2, 4] and len({r.ids_sha256 for r in coded}) == 3
    scored = lm.score(df).collect()
    assert [r.held_out for r in scored if r.doc_id is None] == [None] * 3 and all(r.train_tokens == sum(61 + (i == 2) for i in (2, 4) if not lm.held_out(i)) for r in scored)


def test_cut_repeats_carries_all_columns(spark):
    import datetime

    rnd = random.Random(3)
    a = "é" + "".join(rnd.choice("abcdefghij ") for _ in range(400))
    at = datetime.datetime(2020, 1, 1, 1, 2, 3, 456789)
    rows = [(1, a, at, bytes([0, 255]), [1.5, None], "r"), (2, "x" + a[1:], at, None, None, None), (None, None, None, b"", [], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at timestamp, raw binary, `a b` array<double>, rest_ string").coalesce(1)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(df).collect()}
    assert suffix_dedup.cut_repeats(df).schema == df.schema
    assert got[1] == rows[0] and got[None] == rows[2] and got[2][2:] == rows[1][2:] and got[2].text == "x"


def test_suffix_dedup_over_many_blocks(spark, monkeypatch):
    """Every text in a block of its own, so that the ends of repeats reach prefix doubling."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    values = [base[i : i + rnd.randint(90, 500)] + str(rnd.random()) + base[rnd.randint(0, 400) :][:250] for i in (rnd.randint(0, 700) for _ in range(40))]
    seen, want = set(), {}
    for i, v in enumerate(values):
        b, gone = v.encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        want[7 * i + 3] = len(gone)
    got = suffix_dedup.remove_repeats(frame(spark, values, 40)).collect()
    assert {r.doc_id: r.n_removed for r in got} == want
    assert suffix_dedup._repeats(suffix_dedup.B.Blocks(frame(spark, values, 40), "doc_id", "text"), 100)[2].count() > 0


def test_ngram_join_of_low_similarity(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A B"), (3, "C D"), (4, "D C E F")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, k=1, num=50, den=100).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


PAGE = "<!doctype html><html><head><title>t</title><script>var a='<p>';</script></head><body><header>top</header><nav><ul><li><a href=/>x</a></ul></nav><div class='cookie-notice'>ok?</div><article class=post><header><h1>A &amp; B</h1><span>by me</span></header><p>one\n two<br>three&nbsp;<b>four<p>five <i>six</i></p><div class=ad>buy</div><form><input></form><ul><li>p<li>q</ul><section id='comments'>hi</section></article><aside>s</aside><footer>f</footer></body>"


def test_html(spark):
    rows = [(1, "http://a.b/1", PAGE, 5), (2, None, None, 5), (3, "", "", 5), (4, "http://a.b/2", PAGE.replace("article", "div").replace("class=post", "class=body-text"), 5), (5, "http://a.b/3", "plain < text & more", 5), (1, "http://a.b/1", PAGE, 5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    want = "A & B\none two three four\nfive six\np\nq"
    assert sorted((r.page_id, r.text) for r in got) == [(1, want), (1, want), (2, ""), (3, ""), (4, want), (5, "plain < text & more")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_wrapper_pattern():
    e = [wrappers.expression(wrappers.parse(f"<article><h1>t{n}</h1>{'<p>x</p>' * n}{x}</article>")) for n, x in ((1, ""), (3, "<ul><li>a</ul>"))]
    assert wrappers.pattern(wrappers.aligned(*e)) == '<> <article> <h1> # </h1> ( <p> "x" </p> )+ ( <ul> <li> "a" </li> </ul> )? </article> </>'


def stream(node):
    """A page as one string of tokens."""
    return "".join(f"T({wrappers.plain(k)})" if isinstance(k, str) else f"<{k.label}>{stream(k)}</{k.label}>" for k in node.kids if (wrappers.plain(k) if isinstance(k, str) else not k.drop))


def regex(e):
    inner = "".join(map(regex, e[wrappers.KIDS]))
    if e[wrappers.LABEL] == wrappers.SLOT:
        inner = r"T\([^)]*\)" if e[wrappers.CONSTANT] is None else re.escape(f"T({e[wrappers.CONSTANT]})")
    elif e[wrappers.LABEL] and not e[wrappers.LABEL].startswith(wrappers.GROUP):
        inner = re.escape(f"<{e[wrappers.LABEL]}>") + inner + re.escape(f"</{e[wrappers.LABEL]}>")
    return f"(?:{inner})" + ("", "?", "+", "*")[e[wrappers.FLAG]]


def test_wrappers_match_their_pages():
    """An expression, as a regular expression over tokens, matches every page that it was folded from."""
    rnd = random.Random(6)

    def page(depth):
        out = ""
        for _ in range(rnd.randint(0, 4)):
            out += rnd.choice(["x", "y", ""]) if rnd.random() < 0.4 else (lambda t: f"<{t}>{page(depth - 1) if depth else 'z'}</{t}>")(rnd.choice(["div", "b", "i", "section"]))
        return out

    for _ in range(150):
        pages = [wrappers.parse(page(3)) for _ in range(4)]
        e = wrappers.expression(pages[0])
        for p in pages[1:]:
            e = wrappers.aligned(e, wrappers.expression(p))
        for p in pages:
            assert re.fullmatch(regex(e), stream(p)), (wrappers.pattern(e), stream(p))


def test_alignment_keeps_order():
    rnd = random.Random(7)
    for _ in range(300):
        x, y = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = wrappers.matched(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    x = [str(rnd.randrange(40000)) for _ in range(40000)]
    assert wrappers.matched(x, x[:20000] + ["-"] + x[20000:])[-1] == (39999, 40000)


def test_html_of_any_depth_and_length():
    for tag in ("div", "b", "section", "blockquote"):
        assert wrappers.read(f"<{tag}>" * 5000 + "x", None) == "x"
    assert wrappers.read("<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y</p>", None) == "x\ny"
    assert wrappers.read("<article>" + "<div>" * 300 + "x<nav>m</nav><div>y</div>z" + "</div>" * 300 + "<p>w</article><footer>f</footer>", None) == "x\ny\nz\nw"
    long = "".join(f"<{t}>{n}</{t}>" for n, t in enumerate(random.Random(1).choices(["p", "h2", "pre", "blockquote"], k=20000)))
    assert wrappers.read(f"<article>{long}</article>", None) == "\n".join(map(str, range(20000)))


def test_html_names_inside_an_article():
    page = "<article><div class='share-price-table'>a</div><p class='social-history'>b</p><p>c</p><div class='share-buttons'>s</div><div id='comment-list'>r</div></article>"
    assert wrappers.read(page, None) == "a\nb\nc"


def test_html_template_texts(spark):
    """Without an element that marks the article, what all pages of a host say is the template's; partly telling names need the pages' agreement."""
    rows = [(n, f"http://h.x/{n}", f"<body><div id=brand>The Site</div><div id=text><h1>Title {n}</h1><p>text {n} of some length here</p><div>Follow us</div></div><div id=legal>All rights kept</div></body>") for n in range(6)]
    rows += [(10 + n, f"http://g.x/{n}", f"<article><p>words {n} and more of them</p><div class='share-tip'>Tell a friend</div><div class='social-note'>note {n}</div></article>") for n in range(6)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Title {n}\ntext {n} of some length here" for n in range(6)} | {10 + n: f"words {n} and more of them\nnote {n}" for n in range(6)}


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_html_rules_joined(spark, monkeypatch, small):
    monkeypatch.setattr(wrappers, "SMALL_RULES", small)
    test_html(spark)


def test_quotes(spark):
    rows = [(1, 0, "user", "First point.\n\nSecond  Point."), (1, 1, "assistant", "Other."), (1, 2, "user", "A wrote:\n> second point.\n>> deeper\nI agree."), (2, 0, "user", "> Other.\nyes"), (2, 1, "user", None), (None, None, None, None), (2, 1, "user", None)]
    got = sorted(quotes.link(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")).collect(), key=lambda r: (r.conv_id or 0, r.position))
    assert [(r.conv_id, r.turn, r.text, r.n_quotes, r.n_linked, r.parent_conv, r.parent_turn) for r in got] == [(None, None, "", 0, 0, None, None), (1, 0, rows[0][3], 0, 0, None, None), (1, 1, "Other.", 0, 0, 1, 0), (1, 2, "I agree.", 2, 1, 1, 0), (2, 0, "yes", 1, 1, 1, 1), (2, 1, "", 0, 0, 2, 0), (2, 1, "", 0, 0, 2, 0)]


def test_quotes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 4)
    rnd = random.Random(21)
    said = [f"point {i} is made" for i in range(12)]
    rows = []
    for conv in [None, 1, 2, 3, 4]:
        for turn in sorted(rnd.sample(range(30), rnd.randint(1, 14))):
            lines = []
            for _ in range(rnd.randint(0, 2)):
                lines += ["> " * rnd.randint(1, 2) + rnd.choice(said), ""]
            rows.append((conv, turn, rnd.choice(["a", "b"]), "\n".join([*lines, *("\n\n".join(rnd.sample(said, rnd.randint(0, 2)))).split("\n")])))
    rows.append((1, None, "a", said[0]))
    speak = [(c, t, {p for level, p in quotes.passages(x)[1] if not level}) for c, t, _, x in rows]
    order = lambda t: -1 if t is None else t
    want = {}
    for c, t, _, x in rows:
        earlier = [(u, p) for d, u, p in speak if d == c and order(u) < order(t)]
        links = []
        for level, q in {p for p in quotes.passages(x)[1] if p[0]}:
            inside = [u for u, p in earlier if q in p]
            if not inside and any(d == c and u == t and q in p for d, u, p in speak):
                inside = []
            away = sorted(((d is not None, d or 0), order(u)) for d, u, p in speak if d != c and q in p)
            if inside:
                links.append((level, 0, -max(map(order, inside)), c, max(map(order, inside))))
            elif away:
                links.append((level, 1, 0, away[0][0][1] if away[0][0][0] else None, away[0][1]))
        before = max((order(u) for d, u, _ in speak if d == c and order(u) < order(t)), default=None)
        links.sort(key=lambda v: (v[:3], (v[3] is not None, v[3] or 0), v[4]))
        want[c, order(t)] = (len(links), *(links[0][3:] if links else (c if before is not None else None, before)))
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    none = lambda v: None if v in (None, -1) else v
    assert {(r.conv_id, order(r.turn)): (r.n_linked, r.parent_conv, r.parent_turn) for r in got} == {k: (n, pc, none(pt)) for k, (n, pc, pt) in want.items()}
    for conv in [None, 1, 2, 3, 4]:
        turns = sorted(t for c, t in want if c == conv)
        parent = {t: want[conv, t][2] if want[conv, t][1] == conv and want[conv, t][2] in turns and want[conv, t][2] < t else max((u for u in turns if u < t), default=None) for t in turns}

        def walk(t):
            return [t] + [x for u in turns if parent[u] == t for x in walk(u)]

        assert [order(r.turn) for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)] == [x for t in turns if parent[t] is None for x in walk(t)]
    whole = quotes.conversations(spark.createDataFrame(got), part=3).collect()
    assert sum(len(r.messages) for r in whole) == len(rows) and all([m.position for m in r.messages] == list(range(3 * r.part, 3 * r.part + len(r.messages))) for r in whole)


def test_quotes_with_a_long_introduction():
    assert quotes.passages("x" * 500 + " wrote:\n> hi\nyes")[0] == "yes"


EMPTY = [
    (packing.pack_documents, (JSON,)), (matrices.to_matrices, (JSON,)), (bpe.round_trip, (RANKS, P.PATTERN)), (suffix_dedup.remove_repeats, ()),
    (quality.rate, ()), (ngram_join.near_duplicates, ()), (lm.score, ()),
]


@pytest.mark.parametrize("operator, more", EMPTY)
def test_empty_table(spark, operator, more):
    assert operator(spark.createDataFrame([], "doc_id long, text string"), *more).count() == 0


def test_empty_tables_of_others(spark):
    assert metric_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    prose = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(12)]
    shared = " ".join(rnd.choice(words) for _ in range(60))
    values = [*prose, prose[0], prose[1] + " more", "spam " * 300, None, prose[2][:500] + " " + shared + " " + prose[3][::-1], prose[4][::-1] + " " + shared]
    rows = [(i, v, "en", "s", len(v or "")) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = [docs], []
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, kept[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"{n}"))
        kept.append(spark.read.parquet(str(tmp_path / f"{n}")))
        seen.append({r.doc_id for r in kept[-1].select("doc_id").collect()})
        assert n == 3 or kept[-1].columns == docs.columns
    assert {14, 15}.isdisjoint(seen[0]) and set(range(12)) <= seen[0]
    assert {12, 13}.isdisjoint(seen[1]) and set(range(12)) | {16, 17} <= seen[1] and seen[1] == seen[2] == seen[3]
    last = kept[3].toPandas().set_index("doc_id")
    assert shared in last.text[16] and shared not in last.text[17] and (last.n_chars == last.text.map(len)).all() and set(last.lang) == {"en"}
    want = pd.DataFrame([tuple(r)[:6] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()])
    assert want[2].sum() == kept[4].toPandas().length.sum()


def test_encoder_is_the_library():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from figmill.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encoder, r = tokens.Encoder(path), random.Random(7)
    words = ["alpha", "beta,", "I'm", "don't", "x1", "été", "9,", "naïve.", "foo!?", "中文", "<|endoftext|>", "(a)", "q)", "😀"]
    for _ in range(1500):
        text = r.choice(["", " ", "\n"]) + "".join(r.choice(words + ["".join(r.choice("abcXYZ,.é") for _ in range(5))]) + r.choice([" ", " ", "  ", "\n", "\t ", ""]) for _ in range(r.randrange(12)))
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_runs_of_texts_have_the_library_s_ids(monkeypatch):
    import random

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from figmill.llm import tokens

    monkeypatch.setattr(tokens, "RUN_BYTES", 200)
    monkeypatch.setattr(tokens, "LONG_WORD", 9)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encoder, r = tokens.Encoder(path), random.Random(11)
    assert encoder.plain
    words = ["alpha", "beta,", "I'm", "été", "naïve.", "中文", "<|endoftext|>", "😀", "q" * 30, "\u00a0", "a\nb", "x\u2028y", "\x1cz", "\u0085"]
    texts = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "é " * 500, "q" * 5000, " " * 5000 + "a"]
    texts += ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", " \t", ""]) for _ in range(r.randrange(9))) for _ in range(1500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    runs = list(tokens.runs(batch.slice(0, 700))) + list(tokens.runs(batch.slice(700)))
    assert len(runs) > 50 and sum(x.num_rows for x in runs) == len(texts)
    got = [ids for run in runs for ids in encoder.many(run.column(1))]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want
    assert list(tokens.runs(batch.slice(0, 0))) == [] and encoder.many(pa.array([], pa.string())) == []


def test_language_model_of_rare_contexts(spark):
    """After a word seen only a few times, the word that always follows it is likelier than after its look-alikes."""
    rnd = random.Random(5)
    heads = [f"{rnd.randrange(10**9):09d}ing" for _ in range(3000)]  # each under 1/4096 of the tokens, all with the same last two bytes
    tails = [f"t{rnd.randrange(10**9)}" for _ in range(3000)]
    values = [" ".join(f"{h} {t}" for h, t in zip(heads[k : k + 300], tails[k : k + 300])) for k in range(0, 3000, 300)]
    train = [i for i in range(200) if not lm.held_out(i)]
    out = [i for i in range(200) if lm.held_out(i)][:2]
    right, wrong = " ".join(f"{h} {t}" for h, t in zip(heads[:100], tails[:100])), " ".join(f"{h} {t}" for h, t in zip(heads[:100], tails[1:101]))
    rows = [(i, values[n % 10]) for n, i in enumerate(train[:30])] + [(out[0], right), (out[1], wrong)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[out[0]].n_tokens == got[out[1]].n_tokens == 201 and got[out[0]].score > got[out[1]].score + 150


def test_ngram_copies_in_descending_order(spark):
    """The smallest id of a set need not be its first row in a block."""
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(9, a), (3, a), (5, a + " x")]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {9: 3, 3: 3, 5: 3}


def test_html_keeps_siblings_of_the_largest_group():
    body = "".join(f"<p>{'long words ' * 20}{n}</p>" for n in range(4))
    texts = [f"{'long words ' * 20}{n}" for n in range(4)]
    page = f"<body><ul><li><a href='/'>home</a></ul><div><h1>Title</h1><p>lead</p><div class=text>{body}</div></div></body>"
    assert wrappers.read(page, None).split("\n") == ["Title", "lead", *texts]
    linked = f"<body><div><h2><a href='/x'>Title</a></h2><div class=text>{body}</div></div></body>"
    assert wrappers.read(linked, None).split("\n") == ["Title", *texts]
    parts = f"<body><div><h1>Title</h1><section>{body}</section><section>{body}</section><p>end</p></div></body>"
    assert wrappers.read(parts, wrappers.rule(wrappers.expression(wrappers.parse(parts)))).split("\n") == ["Title", *texts, *texts, "end"]


def test_html_attributes_are_read_whole():
    for attrs in ("style='overflow:hidden'", "data-id=ad", 'data-role="banner"', "title='id=ad role=banner hidden'", "data-hidden", "aria-label=hidden"):
        assert wrappers.read(f"<article><p>a</p><div {attrs}><p>b</p></div></article>", None) == "a\nb", attrs
    assert wrappers.read("<article><p>a <a href='/hidden-valley'>b</a></p></article>", None) == "a b"
    for attrs in ("hidden", "HIDDEN=''", "class='x ad'", "id = ad", 'role="banner"', "aria-hidden=true", "style='a:b'hidden"):
        assert wrappers.read(f"<article><p>a</p><div {attrs}><p>b</p></div></article>", None) == "a", attrs
