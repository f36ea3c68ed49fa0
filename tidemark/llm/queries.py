"""The registered queries of the training-data operators, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bitkmeans, exactdup, linededup, neardup, negatives, packing, pieces, pii, quality, sharding, substring, tokencount, warc
from tidemark.llm.common import table

EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16, base=16)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_dedup(table(spark, sf_dir, "documents"), exactdup.some_half())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(table(spark, sf_dir, "pages"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), "query key", count="n_replaced").select("doc_id", "text", "n_replaced")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitkmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards, "op2_quality_rules": op2_quality_rules, "op3_sentencepiece": op3_sentencepiece, "op4_near_dedup": op4_near_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts, "op7_best_fit_packing": op7_best_fit_packing, "op8_substring_dedup": op8_substring_dedup, "op9_warc_revisits": op9_warc_revisits,
    "op10_surrogates": op10_surrogates, "op11_line_dedup": op11_line_dedup,
    "op12_centroids": op12_centroids, "op13_hard_negatives": op13_hard_negatives,
}
LLM_SQL: dict[str, str] = {"op4_near_dedup": neardup.NEAR_SQL, "op5_exact_dedup": EXACT_SQL, "op8_substring_dedup": substring.REPEATS_SQL,
    "op9_warc_revisits": warc.REVISITS_SQL, "op11_line_dedup": linededup.LINES_SQL,
    "op12_centroids": bitkmeans.CLUSTERS_SQL, "op13_hard_negatives": negatives.NEGATIVES_SQL}
