"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.members import fresh, may_hold
from strataspark.functions.storage import forget, shared_dir, written
from strataspark.operators.graph import connected_components

__all__ = ["columns_of", "components", "may_hold", "memo", "fold", "forget", "fresh", "labelled_sample", "one_text_each", "release", "shared_dir", "table", "trim", "written"]

components = connected_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts: the split into learning and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def columns_of(df: DataFrame) -> list[Column]:
    """df's columns as they are named, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def labelled_sample(labels: DataFrame, label: str, parts: int, held: int, bound: dict[int, int]) -> DataFrame:
    """(doc_id, label) of at most bound[v] rows of each label value v, taken in the order of a hash of doc_id
    from the rows whose fold is not `held`. A doc_id with null or contradicting labels is left out."""
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("__other"))
        .where((F.col("label") == F.col("__other")) & (fold(F.col("doc_id"), parts) != held))
        .select("doc_id", "label")
    )
    picked = [
        clean.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in sorted(bound.items())
    ]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) for the ids of sample(doc_id, label), a bounded table, whose text is not null. Of the
    texts of rows that share an id the least counts, so a repeated id brings one row."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.col("text").cast("string")).alias("text"))


_MEMO: dict[str, dict] = {}


def memo(owner: str) -> dict:
    """What an operator remembers in a Python worker. Workers are used again by other operators of a pipeline, so
    taking one owner's memory frees that of all others."""
    if owner not in _MEMO:
        _MEMO.clear()
        gc.collect()
        _MEMO[owner] = {}
    return _MEMO[owner]


def release() -> None:
    """Give freed memory back to the system, where the C library can, so that what a training took is not held by the
    driver through the stages that follow."""
    gc.collect()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def trim(known: dict, limit: int) -> None:
    """Halve a memory that has outgrown its limit; what came first, and so is common, stays."""
    if len(known) > limit:
        for k in list(known)[limit // 2 :]:
            del known[k]
