"""Cutting lineage through the shared folder, so loops survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made for sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}
#: Tables that were written and not forgotten, each with what deletes it.
_KEPT: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else that of the context. Where neither is set
    a local master (as in tests) gets a folder that goes when the driver ends; on a cluster that is an error, for no
    folder of one machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        set_there = context._jsc.sc().getCheckpointDir()
        if set_there.isDefined():
            at = set_there.get()
        elif not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            at = _LOCAL.setdefault(context.applicationId, f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df under the shared folder and read it back. The table stays until `forget`, the end of the `scratch`
    scope that it was written in, or the end of the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataspark/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    _KEPT[path] = (spark._jvm, spark._jsc)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def _delete(path: str) -> None:
    jvm, context = _KEPT.pop(path, (None, None))
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame | None) -> None:
    """Delete the folder behind a written() table that no later plan reads."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Everything written inside goes at the end of the block. Results that are lazy must be consumed inside."""
    before = set(_KEPT)
    try:
        yield
    finally:
        for path in set(_KEPT) - before:
            _delete(path)


@atexit.register
def _clean() -> None:
    for path in list(_KEPT):
        try:
            _delete(path)
        except Exception:  # the engine is gone already; the shared folder is swept with the application
            return
