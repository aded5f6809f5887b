"""A training-data pipeline over `documents`: quality, toxicity, near duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import jaccard_join, packing, quality, secrets, toxicity
from strataspark.llm.common import forget, fresh, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold; null and empty texts score by the bias. If
    there are no labelled texts of both kinds to learn from, all stay."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not weights.any():
        return docs
    name = fresh(docs, "score")
    scored = docs.withColumn(name, quality.quality_score(F.col("text"), weights, spark))
    return scored.where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag. If there are no labelled texts of both kinds to learn from,
    all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    name = fresh(docs, "score")
    scored = docs.withColumn(name, toxicity.toxicity_score(F.col("text"), model, spark))
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group that links of Jaccard similarity >= 0.8 hold
    together, and one row of a repeated document; see jaccard_join.keep_one."""
    return jaccard_join.keep_one(docs, 0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; a document's source counts as its path."""
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)), path="source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces, placed in sequences of 2048. Workers that ran the stages before have less room,
    so they remember fewer chunks."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, remember=200_000)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models and the LSH forest have no SQL form; see tests/llm.
ORACLE_SQL = None


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's output: masked texts as pieces with their token ids and places; see also packing.sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents: one row for each placed piece (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset), token ids given as their digest only, taken from the ids as placed. Each stage's table goes
    when the next is written; an empty table gives no rows."""
    return packed(spark, sf_dir).drop("ids")
