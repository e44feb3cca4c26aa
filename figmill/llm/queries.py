"""The opN_ queries: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, line_dedup, lm, matrices, metric_join, ngram_join, oracles, packing, quality, quotes, suffix_dedup, whitening, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_metric_join(spark, sf_dir):
    return metric_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op4_quality_rules(spark, sf_dir):
    return quality.rate(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pitman_yor(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_token_matrices(spark, sf_dir):
    return matrices.to_matrices(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html_wrappers(spark, sf_dir):
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op10_quote_linking(spark, sf_dir):
    return quotes.conversations(quotes.link(_table(spark, sf_dir, "conversations")))


def op11_line_dedup(spark, sf_dir):
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op12_svd_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_centroids(spark, sf_dir):
    return centroids.cluster(_table(spark, sf_dir, "embeddings")).drop("n_candidates")


def whitening_counts(spark, sf_dir):
    """The whole numbers of op12_svd_whitening, which SQL can express; components it can't."""
    return op12_svd_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def quality_counts(spark, sf_dir):
    """The counts and the base rule of op4_quality_rules, which SQL can express; the compression bands it can't."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_packing, op2_metric_join, op3_suffix_dedup, op4_quality_rules, op5_ngram_join, op6_byte_bpe, op7_pitman_yor, op8_token_matrices, op9_html_wrappers, op10_quote_linking, op11_line_dedup, op12_svd_whitening, op13_centroids, quality_counts, whitening_counts)}
ORACLES: dict[str, str] = {"op2_metric_join": oracles.METRIC, "op5_ngram_join": oracles.NGRAMS, "quality_counts": oracles.BASE, "op11_line_dedup": oracles.LINES, "op13_centroids": oracles.clusters(), "whitening_counts": oracles.SPREAD}
