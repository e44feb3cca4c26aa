"""The page tokeniser's time, and repeated and null ids of the document operators."""

import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers as P
import pytest

from figmill.llm import bpe, lm, matrices, packing, quality, suffix_dedup, wrappers

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_tokens_are_those_of_the_pattern():
    rnd = random.Random(1)
    parts = ["<", "</", "<a", "<a ", '"', "'", ">", "x", " ", "<!--", "-->", "<script", "</script>", "<script>", "<!d", "<?p", "/", "=", "<style ", "<1", "a='b'"]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [m.span() for m in wrappers.tokens(text)] == [m.span() for m in wrappers.TOKEN.finditer(text)], text


@pytest.mark.parametrize("text", ['<a "', "<a '", "<script ", "<a \"'", "<", "</", "<a '<b \"", "<!", '<a ">'])
def test_a_page_of_unclosed_tags(text):
    began = time.time()
    wrappers.read("<p>x</p>" + text * 100_000, None)
    assert time.time() - began < 20


def documents(spark):
    """Ids 1 (twice, different texts), 2 (twice, one text) and null (twice)."""
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(70))
    rows = [(1, a), (1, b), (2, b), (2, b), (None, a), (None, None), (3, None)]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, blk string").coalesce(1)


def test_repeated_and_null_ids(spark):
    from tokenizers import Tokenizer

    rows, df = documents(spark)
    encode = Tokenizer.from_file(JSON)
    n = {t: len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows}
    packed = packing.pack_documents(df, JSON).toPandas()
    assert packed["length"].sum() == sum(n[t] for _, t in rows)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)
    want = sorted((i or 0) for i, _ in rows)
    rated = quality.rate(df).collect()
    assert sorted((r.doc_id or 0) for r in rated) == want and sorted(r.n_words for r in rated) == sorted(len((t or "").split()) for _, t in rows)
    cut = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0) for r in cut) == want and sum(r.n_bytes - r.n_removed for r in cut) == len(rows[0][1]) + len(rows[1][1])
    coded = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert sorted(((r.doc_id or 0), r.decoded_sha256) for r in coded) == sorted(((i or 0), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    scored = lm.score(df).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in scored) == sorted(((i or 0), len((t or "").split()) + 1) for i, t in rows)
    rows_out = matrices.to_matrices(df, JSON, width=64).collect()
    assert sum(r.n_tokens for r in rows_out) == sum(n[t] for _, t in rows)


def test_matrices_are_written(spark, tmp_path):
    _, df = documents(spark)
    out = matrices.to_matrices(df, JSON, width=64)
    matrices.write_matrices(out, str(tmp_path / "m"))
    again = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(json.dumps(r.asDict(), default=repr, sort_keys=True) for r in again.select(out.columns).collect()) == sorted(json.dumps(r.asDict(), default=repr, sort_keys=True) for r in out.collect())


def test_language_model_sends_no_empty_chunks(spark, monkeypatch):
    """With far more slices than words, a block has a chunk a word at most, and the scores are the same."""
    rows = [(i, f"one two three w{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = {r.doc_id: r.score for r in lm.score(df).collect()}
    from figmill.llm import blocks as B

    sent = []
    through = B.exchange
    monkeypatch.setattr(B.Blocks, "slices", lambda self: 300)
    monkeypatch.setattr(B, "exchange", lambda chunks, *a, **k: (sent.append(chunks.count()), through(chunks, *a, **k))[1])
    got = {r.doc_id: r.score for r in lm.score(df).collect()}
    assert sent[0] <= 2 * 7 and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
