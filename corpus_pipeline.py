"""The corpus pipeline: quality rules, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``. Nulls: a null text fails the quality rules. Stages work on all rows they get,
also those that lack an id or repeat one: each is judged by its own text, and of rows equal in id and text the dedup stages leave one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exactdup, neardup, packing, pii, quality
from tidemark.llm.common import table, text_of
from tidemark.session import scratch_path

KEY = "pipeline key"


def _digest() -> Column:
    return F.unhex(F.sha2(text_of().cast("binary"), 256))


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose own verdict (doc_id, _digest, kept) is to stay, null ids included; of rows with equal id and text, one.

    The row keys are doc_id and text digest. Where such rows differ in other columns, the one with the smallest hash of its JSON stays.
    """
    keys = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "no_id": F.col("doc_id").isNull()}
    kept = verdicts.where("kept").select(*(x.alias(k) for k, x in keys.items()), F.col("_digest").alias("digest")).distinct()
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))  # apart from the keys, so that no column of docs clashes with them
    rows = docs.select(whole.alias("row"), *(x.alias(k) for k, x in keys.items()), _digest().alias("digest")).join(kept, [*keys, "digest"], "left_semi")
    first = rows.groupBy(*keys, "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return first.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: rows that the quality rules keep, each judged by its own text."""
    return quality.good_rows(docs, quality.fit(quality.fit_sample(docs, table(spark, sf_dir, "labels"))))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of equal texts, one row: the one with the largest id, or without an id where none has one."""
    verdicts = exactdup.exact_dedup(docs, exactdup.some_half())
    return _only(docs, verdicts.select("doc_id", F.unhex("text_sha256").alias("_digest"), "kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of linked rows (five-word shingles, similarity 0.8), the one with the smallest id; rows without an id link with nothing."""
    verdicts = neardup.near_duplicates(docs, width=5, percent=80, key=_digest())
    return _only(docs, verdicts.select("doc_id", F.col("key").alias("_digest"), "kept"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: personal data replaced by surrogates; n_chars follows the text."""
    out = pii.pseudonymize(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the documents' token ids in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", good_documents), ("exact dedup", without_copies), ("near dedup", without_near_copies),
          ("personal data", without_personal_data), ("packing", packed)]
#: The labelling field, MinHash, keyed surrogates and the genetic packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
