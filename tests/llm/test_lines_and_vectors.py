"""Line dedup, whitening and centroid clustering against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from figmill.llm import centroids, line_dedup, whitening

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    docs = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            if len(key(line)) >= min_chars:
                docs[key(line)].add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        gone = [i is not None and len(docs.get(key(x), ())) >= min_docs and i != max(docs[key(x)]) for x in all_lines]
        out.append((i, len(all_lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(all_lines, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_got(spark, rows, **options):
    df = spark.createDataFrame([(n, i, t, 1) for n, (i, t) in enumerate(rows)], "pos int, doc_id long, text string, keep int").repartition(3)
    return sorted((tuple(r) for r in line_dedup.digests(df, **options).collect()), key=repr)


def test_lines(spark):
    rnd = random.Random(7)
    pool = ["A line of some twenty characters", " a LINE of some twenty characters\t", "é" * 19, "É" * 20, "é" * 20, "exactly twenty chars", "short", "", "  ", "x" * 5000, "\x0b\x0cvertical space all around it\r"]
    pool += ["line number %d of the pool of lines" % k for k in range(30)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, pool[0]), (203, pool[0] + "\nother text of the same document"), (203, pool[0]), (None, pool[0]), (None, None), (-5, pool[0] + "\n" + pool[0])]
    rows += [(300, "\n".join(["a very frequent line of one document"] * 500)), (301, "a very frequent line of one document"), (302, "\n".join("a very frequent line of one document" if k % 3 else f"number {k}" for k in range(3000)))]
    assert lines_got(spark, rows) == lines_by_hand(rows)
    assert lines_got(spark, rows, min_chars=1, min_docs=2) == lines_by_hand(rows, 1, 2)


def test_lines_of_an_empty_table(spark):
    assert lines_got(spark, []) == []


def test_a_line_of_a_third_of_all_documents(spark):
    rows = [(k, ("the same footer stands in every third text\n" if k % 3 == 0 else "") + f"text {k}") for k in range(3000)]
    assert lines_got(spark, rows) == lines_by_hand(rows)


def test_bitmaps_and_plan(spark):
    df = spark.createDataFrame([(k, "first\nsame line in all of these documents\nlast\nsame line in all of these documents") for k in range(4)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, [tuple(x) for x in r["keep"]]) for r in line_dedup.keep_bitmaps(df).collect()}
    assert got == {k: (4, 2, [(0, 1), (2, 1)]) for k in range(3)}
    plan = line_dedup.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan


def vectors_frame(spark, vectors, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], None if v is None else [None if x is None else float(x) for x in v], 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int").repartition(4)


def check_whitening(spark, kept, got, top=32):
    """kept: {id: vector} of one length, without repeated ids."""
    ids = sorted(kept)
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in kept[i]] for i in ids]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    spread = np.array([[n * c - s for c, s in zip(r, sums)] for r in x], object)
    centred = (spread / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(top, len(sums))
    rows = {(r.vec_id, r.component): r for r in got}
    assert set(rows) == {(i, c) for i in ids for c in range(1, k + 1)} and len(got) == len(rows)
    for at, i in enumerate(ids):
        for c in range(k):
            r = rows[i, c + 1]
            assert r.n == n and r.deviation == int((spread[at] ** 2).sum())
            if values[c] > 1e-9:
                assert abs(abs(r.whitened) - abs(centred[at] @ vectors[:, c]) / math.sqrt(values[c])) < 1e-8
                assert abs(r.explained - values[c] / values.sum()) < 1e-9 and r.identity_error < 1e-9
            else:
                assert r.whitened is None


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    v = list((rnd.normal(size=(300, 12)) * np.linspace(1, 3, 12) + 5).astype(np.float32))
    odd = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("-inf")]]
    check_whitening(spark, dict(enumerate(v)), whitening.whiten(vectors_frame(spark, v + odd)).collect())


def test_whitening_signs_agree_between_rows(spark):
    """The covariance of the whitened rows is the identity, so one sign holds for all of them."""
    rnd = np.random.default_rng(4)
    v = (rnd.normal(size=(200, 40)) * np.linspace(1, 2, 40) / 8).astype(np.float32)
    got = whitening.whiten(vectors_frame(spark, list(v))).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == (200, 32) and np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-10


def test_whitening_degenerate(spark):
    one = whitening.whiten(vectors_frame(spark, [[1.0, 2.0, 3.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    assert whitening.whiten(vectors_frame(spark, [])).collect() == [] == whitening.whiten(vectors_frame(spark, [None, []])).collect()
    flat = {k: [float(k), 7.0, -float(k)] for k in range(9)}  # one direction only
    check_whitening(spark, flat, whitening.whiten(vectors_frame(spark, list(flat.values()))).collect())
    mixed = [[float(k), float(k * k % 7)] for k in range(9)] + [[float(k), 1.0 / (k + 1), float(k % 3)] for k in range(8)]
    got = whitening.whiten(vectors_frame(spark, mixed)).collect()
    check_whitening(spark, dict(enumerate(mixed[:9])), [r for r in got if r.vec_id < 9])
    check_whitening(spark, {9 + k: v for k, v in enumerate(mixed[9:])}, [r for r in got if r.vec_id >= 9])
    repeated = whitening.whiten(vectors_frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [5, 5, None])).collect()
    assert sorted((r.vec_id or -1, r.n) for r in repeated if r.component == 1) == [(-1, 3), (5, 3), (5, 3)]


def test_merging_loses_nothing():
    rnd = np.random.default_rng(5)
    x = np.floor(rnd.normal(size=(5000, 20)) * 9)
    parts = [whitening.Part.of(x[a:b], True) for a, b in ((0, 1), (1, 7), (7, 2000), (2000, 2003), (2003, 5000))]
    while len(parts) > 1:
        parts = [parts[0].merged(parts[1]), *parts[2:]]
    whole = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert parts[0].sums == [int(s) for s in x.sum(0)] and np.allclose(parts[0].singular, whole[1], rtol=1e-12)
    assert np.abs(np.abs(np.sum(parts[0].vectors * whole[2], axis=1)) - 1).max() < 1e-9


def clusters_by_hand(vectors, ids, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in zip(ids, vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, v) for i, v in kept if len(v) == len(vectors[0])]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        best = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(centres)):
                mine = [v for b, (_, v) in zip(best, kept) if b == c]
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centres[c]
    d = [far(v, centres[b]) for b, (_, v) in zip(best, kept)]
    own = collections.Counter()
    for b, x in zip(best, d):
        own[b] += x
    return sorted((i, b, x, own[b], sum(d), hashlib.sha256(",".join(map(str, centres[b])).encode()).hexdigest()) for (i, _), b, x in zip(kept, best, d))


@pytest.mark.parametrize("kind", ["apart", "ties"])
def test_clusters(spark, kind):
    rnd = np.random.default_rng(6)
    v = [list(map(float, r)) for r in (rnd.normal(size=(400, 8)) if kind == "apart" else rnd.integers(-1, 2, size=(400, 8)) / 256)]
    v[0] = list(map(float, np.float32(v[0])))
    v += v[:20] + [None, [], v[0][:7] + [None], v[0][:7] + [float("nan")], v[0][:7] + [float("inf")], v[0] + [1.0]]
    got = centroids.cluster(vectors_frame(spark, v), k=9, dim=8).drop("n_candidates").collect()
    assert sorted(tuple(r) for r in got) == clusters_by_hand(v, range(len(v)), 9, 5)


def test_few_vectors_and_null_ids(spark):
    few = [[0.0, 1.0], [5.0, 5.0]]
    assert sorted(tuple(r)[:6] for r in centroids.cluster(vectors_frame(spark, few), k=9, dim=2).collect()) == clusters_by_hand(few, [0, 1], 9, 5)
    assert centroids.cluster(vectors_frame(spark, [None, [1.0]]), dim=2).collect() == []
    got = centroids.cluster(vectors_frame(spark, few + [[5.0, 6.0], [1e9, 0.0]], [1, 1, None, 2]), k=9, dim=2).collect()
    assert len(got) == 3 and len({r.cluster for r in got}) == 2  # a null id starts no centroid; what needs over a long is left out


def test_screening_is_safe():
    """Near ties at the edge of float32: the exact nearest is always among the candidates."""
    rnd = np.random.default_rng(8)
    base = rnd.integers(-(1 << 26), 1 << 26, size=(1, 64))
    c = base + rnd.integers(-3, 4, size=(40, 64))
    x = base + rnd.integers(-3, 4, size=(500, 64))
    best, far, n = centroids.nearest(x, c)
    all_far = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (far == all_far.min(1)).all() and (best == all_far.argmin(1)).all() and n.max() == 40
    x, c = rnd.integers(-200, 200, size=(500, 64)), rnd.integers(-200, 200, size=(40, 64))
    best, far, n = centroids.nearest(x, c)
    assert (best == ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)).all() and n.mean() < 1.5
