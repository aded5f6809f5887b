"""Queries op1..op10: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import jaccard_join, langid, media, neardup, packing, quality, secrets, sentencepieces, sharding, toxicity
from strataspark.llm.common import table
from strataspark.llm.oracles import ORACLE


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), 0.8)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids are given as their digest only, taken from the ids as placed."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0).drop("ids")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate; the value itself is given as its digest only."""
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)), path="source")
    return found.select("doc_id", "word", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.round("score", 9).alias("score"), "is_secret")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def llm_queries() -> dict:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_quality_classifier, op3_language_id, op4_best_fit_packing, op5_sharding,
        op6_sentencepiece, op7_secret_scan, op8_embedding_near_dedup, op9_toxicity, op10_media_columns,
    )}


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
