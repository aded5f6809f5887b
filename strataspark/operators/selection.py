"""Test selection, coverage matrices and LCOV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.coverage import fold
from strataspark.operators.graph import reach


def lcov_hits(lines: DataFrame) -> DataFrame:
    """(suite_id, path, line, hits) from raw lines(suite_id, line_no, text): the last SF record before a DA record
    names its file. Repeated lines of a file add up; records that `lcov_errors` names do not count, and lines before any file have a null path.

    A suite is read in blocks of LCOV_BLOCK line numbers: the last file of each block is carried to the next, so a long
    record is not one task's."""
    whole = lines.withColumn("block", F.floor(F.col("line_no") / LCOV_BLOCK))
    sf = F.when(F.col("text").startswith("SF:"), F.expr("substring(text, 4)"))
    ends = whole.withColumn("sf", sf).where("sf is not null").groupBy("suite_id", "block").agg(F.max_by("sf", "line_no").alias("last"))
    blocks = whole.select("suite_id", "block").distinct().join(ends, ["suite_id", "block"], "left")
    before = Window.partitionBy("suite_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("suite_id", "block", F.last("last", True).over(before).alias("carried"))
    w = Window.partitionBy("suite_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = whole.withColumn("local", F.last(sf, True).over(w)).where(F.col("text").rlike(LCOV_RECORD))
    seen = local.join(carried, ["suite_id", "block"]).withColumn("path", F.coalesce("local", "carried"))
    parts = F.split(F.expr("substring(text, 4)"), ",")
    return seen.groupBy("suite_id", "path", parts[0].cast("int").alias("line")).agg(F.sum(parts[1].cast("bigint")).alias("hits"))


#: Line numbers of a block, and what a line record is.
LCOV_BLOCK, LCOV_RECORD = 100_000, r"^DA:[0-9]{1,9},[0-9]{1,18}(,.*)?$"


def lcov_errors(lines: DataFrame) -> DataFrame:
    """(suite_id, line_no, text) of raw lines that begin a line record and are none."""
    return lines.where(F.col("text").startswith("DA:") & ~F.col("text").rlike(LCOV_RECORD)).select("suite_id", "line_no", "text")


def affected_sources(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): changed(id) and everything that reaches it."""
    return reach(calls, changed, None, "backward").select("id")


def plan(suites: DataFrame, imports: DataFrame, hits: DataFrame, affected: DataFrame) -> DataFrame:
    """(suite_id, decision): run_static where the suite imports an affected source, run_dynamic where it executed one,
    run_unruled where the suite's coverage is not verified, else skip. If nothing is affected all suites run."""
    static = imports.join(affected.withColumnRenamed("id", "source"), "source", "left_semi").select("suite_id").distinct().withColumn("s", F.lit(True))
    dynamic = hits.where("hits > 0").join(affected.withColumnRenamed("id", "source"), "source", "left_semi").select("suite_id").distinct().withColumn("d", F.lit(True))
    nothing = affected.agg((F.count("*") == 0).alias("nothing"))
    decision = (
        F.when(F.col("nothing"), "run_all")
        .when(F.col("s"), "run_static")
        .when(F.col("d"), "run_dynamic")
        .when(F.col("coverage") != "verified", "run_unruled")
        .otherwise("skip")
    )
    return suites.join(static, "suite_id", "left").join(dynamic, "suite_id", "left").crossJoin(F.broadcast(nothing)).select("suite_id", decision.alias("decision"))


def rank_suites(hits: DataFrame, affected: DataFrame) -> DataFrame:
    """(suite_id, observed, total, probability): affected sources that each suite executed over all affected ones."""
    total = affected.agg(F.count("*").alias("total"))
    seen = hits.where("hits > 0").join(affected.withColumnRenamed("id", "source"), "source", "left_semi").groupBy("suite_id").agg(F.countDistinct("source").alias("observed"))
    return seen.crossJoin(F.broadcast(total)).withColumn("probability", F.round(F.col("observed") / F.col("total"), 9))


def merge_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """(suite_id, files, coverage) of two coverage tables (suite_id, path, coverage): union of files, worst coverage."""
    return a.unionByName(b).groupBy("suite_id").agg(F.countDistinct("path").alias("files"), fold(F.col("coverage")).alias("coverage"))


def classification_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(task, tp, fp, fn, precision, recall, f1) of predicted(task, item) against truth(task, item); empty ratios are 0."""
    p, t = predicted.select("task", "item").distinct().withColumn("p", F.lit(1)), truth.select("task", "item").distinct().withColumn("t", F.lit(1))
    c = p.join(t, ["task", "item"], "full").groupBy("task").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )

    def part(n, d):
        return F.when(d == 0, F.lit(0.0)).otherwise(F.round(n / d, 9))

    return c.select("task", "tp", "fp", "fn", part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
