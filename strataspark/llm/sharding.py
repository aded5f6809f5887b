"""Proportional stratified interleaving into shards of equal row counts.

Rows are ranked in a seeded random order within their source; a row's fractional rank is (2 rank - 1) / (2 n) for n
rows of that source. All rows are put in the order of fractional rank (ties by source, then by the seeded order) and
cut into equal runs, so every shard holds each source in proportion. Both rankings count rows by bucket first and
then number them within buckets, so neither a hot source nor the global order is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket on average.
BUCKET_ROWS = 1_000


def _numbered(df: DataFrame, groups: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """df with a number from 1 within groups, in the order of (bucket, *order)."""
    keys = [*groups, bucket]
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.sum("__n").over(by.orderBy(bucket)) - F.col("__n")).alias("__before"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = local.join(before, on)
    return joined.withColumn(name, F.col("__before") + F.col("__local")).drop("__local", "__before", *[f"__{k}" for k in keys])


def shard(docs: DataFrame, shards: int = 24, seed: str = "42") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row of docs(doc_id, text, source).

    size: UTF-8 bytes of the text (null: none) plus 8. A null source is a source of its own. Ties in the seeded
    order go by doc_id, then crc32; rows equal in all are interchangeable. An empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )
    total = docs.count()
    buckets = max(1, min(1 << 20, total // BUCKET_ROWS))
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    rows = _numbered(rows, ["source"], "b", [F.col("h"), F.col("doc_id"), F.col("text_crc32")], "rank")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source_")).agg(F.count("*").alias("n"))
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("f", (2 * F.col("rank") - 1) / (2 * F.col("n"))).withColumn("g", F.floor(F.col("f") * buckets))
    ties = [F.col("f"), F.col("source").asc_nulls_first(), F.col("rank")]
    rows = _numbered(rows, [], "g", ties, "at").withColumn("at", F.col("at") - 1)
    s = F.floor(F.col("at") * shards / F.lit(max(1, total))).cast("int")
    # floor(at * shards / total) = s exactly when at >= ceil(s * total / shards)
    first = F.ceil(F.col("shard").cast("long") * F.lit(total) / F.lit(shards))
    return rows.withColumn("shard", s).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot")
    )
