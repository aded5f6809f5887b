"""Event log, sessions, incidents: batch forms. Streaming forms are in strataspark.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cursor_page(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The first `limit` events after the cursor, in the order of seq_id."""
    return events.where(F.col("seq_id") > cursor).orderBy("seq_id").limit(limit)


def merge_replay(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each seq_id; what is in memory wins over what is stored."""
    both = memory.withColumn("__from", F.lit(0)).unionByName(stored.withColumn("__from", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("seq_id").orderBy("__from"))
    return both.withColumn("__best", best).where("__best = 1").drop("__from", "__best")


def debounce(changes: DataFrame, gap: str) -> DataFrame:
    """(key, first, last, paths, n) of changes(key, ts, path): a batch ends when `gap` passes without a change."""
    w = F.session_window("ts", gap)
    out = changes.groupBy("key", w).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.count("*").alias("n"))
    return out.drop("session_window")


def ledger(queries: DataFrame) -> DataFrame:
    """(session_id, queries, hits, spent, saved, cost, saved_percent, hit_ratio) of queries(session_id, hit, spent, saved).
    cost is 3 microcents for each saved token; the percentage is clamped to 0..99.9."""
    g = queries.groupBy("session_id").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.sum("spent").alias("spent"), F.sum("saved").alias("saved"))
    all_ = F.col("spent") + F.col("saved")
    percent = F.when(all_ == 0, 0.0).otherwise(F.least(F.lit(99.9), F.greatest(F.lit(0.0), 100.0 * F.col("saved") / all_)))
    return g.select("*", (F.col("saved") * 3).alias("cost"), F.round(percent, 6).alias("saved_percent"), F.round(F.col("hits") / F.col("queries"), 6).alias("hit_ratio"))


def incident_candidates(deployments: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(service, commit, ts, start_ms, end_ms): deployments(commit, ts) inside windows(service, start_ms, end_ms), ends
    included. Windows are cut into slots of `width` ms, so the join is on equal slots and not on all pairs."""
    slots = windows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))))
    d = deployments.withColumn("slot", F.floor(F.col("ts") / width))
    return d.join(slots, "slot").where("ts between start_ms and end_ms").drop("slot")


def receipts(steps: DataFrame) -> DataFrame:
    """(session_id, steps, failed, verdict): the last step's exit code decides; no exit code is UNKNOWN."""
    g = steps.groupBy("session_id").agg(F.count("*").alias("steps"), F.count_if(F.col("exit_code") != 0).alias("failed"), F.max_by("exit_code", "idx").alias("last"))
    return g.select("session_id", "steps", "failed", F.when(F.col("last").isNull(), "UNKNOWN").when(F.col("last") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def golden_angle_layout(nodes: DataFrame, radius: float = 10.0) -> DataFrame:
    """(id, x, y, z) on a sphere, evenly spread by the golden angle in the order of ids, to four decimals."""
    from strataspark.operators.browse import numbered

    total = max(1, nodes.count())
    at = numbered(nodes.select("id"), ["id"], "at")
    z = 1 - 2 * (F.col("at") + 0.5) / total
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    angle = F.col("at") * (3.141592653589793 * (3 - 5**0.5))
    return at.select("id", F.round(ring * F.cos(angle) * radius, 4).alias("x"), F.round(ring * F.sin(angle) * radius, 4).alias("y"), F.round(z * radius, 4).alias("z"))


def disambiguate(symbols: DataFrame) -> DataFrame:
    """symbols(id, signature) with overload ids: the n-th signature of an id, in order, gets ':overload:n'; ids of one stay."""
    n = F.count("*").over(Window.partitionBy("id"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("signature"))
    return symbols.withColumn("k", k).withColumn("n", n).select(F.when(F.col("n") > 1, F.concat_ws(":overload:", "id", F.col("k").cast("string"))).otherwise(F.col("id")).alias("id"), "signature")
