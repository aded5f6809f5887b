"""Snapshot-to-snapshot differences: files, symbols, contracts, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, type, old_*, new_*): added, removed and modified rows; equal ones are left out. Nulls equal nulls."""
    b = before.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values]).withColumn("in_before", F.lit(True))
    a = after.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values]).withColumn("in_after", F.lit(True))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    kind = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(changed, "modified")
    return b.join(a, keys, "full").withColumn("type", kind).where("type is not null").drop("in_before", "in_after")


def unique_pairs(gone: DataFrame, new: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(left, right, keys) where exactly one gone and one new row share the keys."""
    g = gone.groupBy(*keys).agg(F.count("*").alias("n"), F.min(left).alias("from_id")).where("n = 1").drop("n")
    n = new.groupBy(*keys).agg(F.count("*").alias("n"), F.min(right).alias("to_id")).where("n = 1").drop("n")
    return g.join(n, keys)


def file_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, path, old_path) over files(path, content_hash): renamed where one removed and one added file have the
    same content, and only they; else added, removed, modified."""
    d = full_diff(before, after, ["path"], ["content_hash"])
    gone = d.where("type = 'removed'").select("path", F.col("old_content_hash").alias("content_hash"))
    new = d.where("type = 'added'").select("path", F.col("new_content_hash").alias("content_hash"))
    moved = unique_pairs(gone, new, ["content_hash"], "path", "path").select("from_id", "to_id")
    plain = (
        d.select("type", "path")
        .join(moved.select(F.col("from_id").alias("path"), F.lit("removed").alias("type")), ["path", "type"], "left_anti")
        .join(moved.select(F.col("to_id").alias("path"), F.lit("added").alias("type")), ["path", "type"], "left_anti")
        .select("type", "path", F.lit(None).cast("string").alias("old_path"))
    )
    return plain.unionAll(moved.select(F.lit("renamed"), "to_id", "from_id"))


def symbol_diff(before: DataFrame, after: DataFrame, moved_files: DataFrame | None = None) -> DataFrame:
    """(type, id, old_id) over symbols(id, path, kind, signature, line, visibility): renamed where one removed and one
    added symbol agree in file, kind and non-null signature; modifications name the first field that differs. A file
    of moved_files(path, old_path), as `file_diff` gives renames, counts as the one it became."""
    fields = ["path", "kind", "signature", "visibility", "line"]
    d = full_diff(before, after, ["id"], fields)
    keys = ["path", "kind", "signature"]
    gone = d.where("type = 'removed' and old_signature is not null").select("id", *[F.col(f"old_{k}").alias(k) for k in keys])
    if moved_files is not None:
        to = moved_files.where("old_path is not null").select(F.col("old_path").alias("path"), F.col("path").alias("__to"))
        gone = gone.join(to, "path", "left").select("id", F.coalesce("__to", "path").alias("path"), "kind", "signature")
    new = d.where("type = 'added' and new_signature is not null").select("id", *[F.col(f"new_{k}").alias(k) for k in keys])
    moved = unique_pairs(gone, new, keys, "id", "id").select("from_id", "to_id")
    what = (
        F.when(F.col("type") != "modified", F.col("type"))
        .when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "signature_modified")
        .when(~F.col("old_visibility").eqNullSafe(F.col("new_visibility")), "visibility_modified")
        .otherwise("body_modified")
    )
    plain = (
        d.join(moved.select(F.col("from_id").alias("id"), F.lit("removed").alias("type")), ["id", "type"], "left_anti")
        .join(moved.select(F.col("to_id").alias("id"), F.lit("added").alias("type")), ["id", "type"], "left_anti")
        .select(what.alias("type"), "id", F.lit(None).cast("string").alias("old_id"))
    )
    return plain.unionAll(moved.select(F.lit("renamed"), "to_id", "from_id"))


def parameter_reasons(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, name, reason, breaking) over parameters(owner, name, type, optional) of callables in both snapshots."""
    owners = before.select("owner").distinct().join(after.select("owner").distinct(), "owner")
    d = full_diff(before.join(owners, "owner", "left_semi"), after.join(owners, "owner", "left_semi"), ["owner", "name"], ["type", "optional"]).withColumnRenamed("type", "change")
    reason = (
        F.when(F.col("change") == "removed", "parameter_removed")
        .when((F.col("change") == "added") & F.col("new_optional"), "optional_parameter_added")
        .when(F.col("change") == "added", "required_parameter_added")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changed")
        .when(F.col("old_optional") & ~F.col("new_optional"), "became_required")
        .otherwise("became_optional")
    )
    return d.select("owner", "name", reason.alias("reason")).withColumn("breaking", ~F.col("reason").isin("optional_parameter_added", "became_optional"))


def api_verdict(reasons: DataFrame, coverage: DataFrame) -> DataFrame:
    """(owner, verdict, reasons): breaking if any reason is; unknown if the owner's coverage is not verified; else compatible."""
    r = reasons.groupBy("owner").agg(F.max("breaking").alias("breaking"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    out = coverage.join(r, "owner", "left")
    verdict = F.when(F.coalesce("breaking", F.lit(False)), "breaking").when(F.col("coverage") != "verified", "unknown").otherwise("compatible")
    return out.select("owner", verdict.alias("verdict"), F.concat_ws(",", F.coalesce("reasons", F.array().cast("array<string>"))).alias("reasons"))


def diff_summary(deltas: DataFrame) -> DataFrame:
    """(family, type, n) of rows (family, type)."""
    return deltas.groupBy("family", "type").agg(F.count("*").alias("n"))


def positional_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos, left, right) where two ordered outputs (pos, value) differ; a missing position is null."""
    l, r = left.select("pos", F.col("value").alias("left_value")), right.select("pos", F.col("value").alias("right_value"))
    return l.join(r, "pos", "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def tree_changes(entries: DataFrame) -> DataFrame:
    """(idx, path, change) over tree entries(idx, path, blob) of a linear history: each commit against the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("idx")
    e = entries.withColumn("before_idx", F.lag("idx").over(w)).withColumn("before_blob", F.lag("blob").over(w)).withColumn("next_idx", F.lead("idx").over(w))
    last = entries.agg(F.max("idx").alias("last"))
    there = e.where((F.col("before_idx") == F.col("idx") - 1) & (F.col("before_blob") != F.col("blob"))).select("idx", "path", F.lit("modified").alias("change"))
    new = e.where((F.col("idx") > 0) & (F.col("before_idx").isNull() | (F.col("before_idx") < F.col("idx") - 1))).select("idx", "path", F.lit("added"))
    gone = e.crossJoin(F.broadcast(last)).where((F.col("idx") < F.col("last")) & (F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1))).select((F.col("idx") + 1).alias("idx"), "path", F.lit("deleted"))
    return there.unionAll(new).unionAll(gone)


def commit_forensics(changes: DataFrame) -> DataFrame:
    """(idx, added, modified, deleted, blast, verdict): blast = 2 m + a + 3 d; WARN from 3 deletions or 11 modifications on."""
    counts = changes.groupBy("idx").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")])
    warn = (F.col("deleted") > 2) | (F.col("modified") > 10)
    return counts.withColumn("blast", 2 * F.col("modified") + F.col("added") + 3 * F.col("deleted")).withColumn("verdict", F.when(warn, "WARN").otherwise("PASS"))
