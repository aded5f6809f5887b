"""Live event log on Structured Streaming: replay once, debounce, running ledger, keyed cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each seq_id once, though delivery is at least once; ids are remembered for `late` of event time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq_id"])


def debounced(changes: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n, paths): a batch of changes(key, ts, path) ends when `gap` passes without another."""
    w = F.session_window("ts", gap)
    out = changes.withWatermark("ts", late).groupBy("key", w).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.drop("session_window")


def running_ledger(queries: DataFrame) -> DataFrame:
    """Totals of each session; for update mode."""
    return queries.groupBy("session_id").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.sum("spent").alias("spent"), F.sum("saved").alias("saved"))


def fixed_delay(changes: DataFrame, delay_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, first_ms, n, paths): changes(key, ts, path) gathered for delay_ms after the first, not longer however many
    follow. Event-time timers; a batch is emitted when the watermark passes its end."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        first, n, paths = state.get if state.exists else (None, 0, [])
        if state.hasTimedOut:
            state.remove()
            done.append((key[0], first, n, sorted(paths)))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "path"])
            for ts, path in zip(rows["ts"], rows["path"], strict=True):
                ms = int(ts.value // 1_000_000)
                if first is not None and ms > first + delay_ms:
                    done.append((key[0], first, n, sorted(paths)))
                    first, n, paths = None, 0, []
                if first is None:
                    first = ms
                n, paths = n + 1, sorted({*paths, path})
            state.update((first, n, list(paths)))
            state.setTimeoutTimestamp(max(first + delay_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["key", "first_ms", "n", "paths"])

    return changes.withWatermark("ts", late).groupBy("key").applyInPandasWithState(
        step, "key string, first_ms long, n long, paths array<string>", "first_ms long, n long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def cache_hits(requests: DataFrame) -> DataFrame:
    """(cache_key, digest, hits, unchanged) of requests(cache_key, digest), one row a key and batch: how often the key
    was asked for since its digest last changed, and whether this batch left the digest as it was."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, hits = state.get if state.exists else (None, 0)
        same = True
        for pdf in batches:
            for d in pdf["digest"]:
                same = same and d == digest
                digest, hits = d, hits + 1 if d == digest else 0
        state.update((digest, hits))
        yield pd.DataFrame({"cache_key": [key[0]], "digest": [digest], "hits": [hits], "unchanged": [same]})

    return requests.groupBy("cache_key").applyInPandasWithState(step, "cache_key string, digest string, hits long, unchanged boolean", "digest string, hits long", "update", GroupStateTimeout.NoTimeout)


def reindex(changes: DataFrame, table: str, keys: list[str], checkpoint: str):
    """A query that upserts each micro-batch of changed rows into a Parquet table; the last change of a key wins."""
    from pyspark.sql import Window

    from strataspark.sinks.reports import upsert

    def apply(batch: DataFrame, _id: int) -> None:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq_id")))
        upsert(batch.withColumn("__last", last).where("__last = 1").drop("__last"), table, keys)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
