"""Persistence of runs, contents and sessions, and publication of live events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _once(rows: DataFrame, keys: list[str]) -> None:
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")


def save_run(run_id: str, findings: DataFrame, evidence: DataFrame, root: str) -> None:
    """Findings and evidence of a run under root, in a folder of its own: saving a run again replaces that one only.
    Ids of findings are unique."""
    _once(findings, ["finding_id"])
    for name, rows in (("findings", findings), ("evidence", evidence)):
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def load_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def put_contents(files: DataFrame, root: str) -> None:
    """Contents of files(content) under their SHA-256, each once; what is there already is not written again. The store
    is parted by the first two digits."""
    spark = files.sparkSession
    new = files.where("content is not null").select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"]).withColumn("shelf", F.substring("hash", 1, 2))
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(root).select("shelf", "hash"), ["shelf", "hash"], "left_anti")
    new.select("hash", "content", "shelf").write.mode("append").partitionBy("shelf").parquet(root)


def get_contents(files: DataFrame, root: str) -> DataFrame:
    """files(path, content_hash) with content from the store (null if it is not there) and `intact`: it has that hash."""
    stored = files.sparkSession.read.parquet(root).select(F.col("hash").alias("content_hash"), "content")
    return files.join(stored, "content_hash", "left").withColumn("intact", F.coalesce(F.sha2("content", 256) == F.col("content_hash"), F.lit(False)))


def export_session(events: DataFrame, session_id: str, path: str) -> None:
    """Events of a session as lines of JSON."""
    events.where(F.col("session_id") == session_id).write.mode("overwrite").json(path)


def import_session(spark: SparkSession, path: str, schema) -> DataFrame:
    """What export_session wrote, in order; two events of one number are an error."""
    rows = spark.read.schema(schema).json(path)
    _once(rows, ["session_id", "event_seq"])
    return rows.orderBy("event_seq")


def publish(events: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """A query that appends live events(seq_id, event_type, data_json) to path as server-sent events, one text line each
    with its id; `every` is how often (a pause between polls), without it what is there is published once."""
    line = F.format_string("id: %d\nevent: %s\ndata: %s\n", "seq_id", "event_type", "data_json").alias("value")
    w = events.select(line).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
