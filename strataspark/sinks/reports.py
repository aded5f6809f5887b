"""Reports and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(rows: DataFrame) -> DataFrame:
    """(json) of each row, its keys in order of name."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def sarif_results(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rule_id, result): SARIF 2.1.0 result objects of findings(finding_id, rule_id, severity, message) with the
    locations of evidence(finding_id, path, line)."""
    spot = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    places = evidence.groupBy("finding_id").agg(F.array_sort(F.collect_set(spot)).alias("locations"))
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.coalesce("locations", F.array()).alias("locations"))
    return findings.join(places, "finding_id", "left").select("rule_id", F.to_json(body).alias("result"))


#: Results of a SARIF run, about.
RUN_RESULTS = 10_000


def write_sarif(findings: DataFrame, evidence: DataFrame, path: str, tool: str = "strataspark") -> None:
    """SARIF runs as lines of JSON, one for each rule and about RUN_RESULTS results: runs of one tool may be split so, and
    no task holds all results."""
    results = sarif_results(findings, evidence)
    blocks = results.groupBy("rule_id").agg(F.ceil(F.count("*") / RUN_RESULTS).alias("blocks"))
    dealt = results.join(blocks, "rule_id").withColumn("block", F.pmod(F.xxhash64("result"), F.col("blocks")))
    runs = dealt.groupBy("rule_id", "block").agg(F.array_join(F.array_sort(F.collect_list("result")), ",").alias("results"))
    head = f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    runs.select(F.concat(F.lit(head), "results", F.lit("]}]}")).alias("value")).write.mode("overwrite").text(path)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace or add rows by key in a Parquet table. Duplicate keys within rows are an error. The new version is
    written beside the old one, which moves aside before the new one takes its place; if the driver is lost in between,
    the next call finds the old one and puts it back, so no moment loses the table."""
    spark = rows.sparkSession
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at, new, aside = (fs_path(path.rstrip("/") + tail) for tail in ("", ".new", ".old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(at):
            fs.delete(aside, True)
        else:
            fs.rename(aside, at)
    out = rows
    if fs.exists(at):
        old = spark.read.schema(rows.schema).parquet(path)
        out = old.join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)
    out.write.mode("overwrite").parquet(new.toString())
    if fs.exists(at):
        fs.rename(at, aside)
    fs.rename(new, at)
    fs.delete(aside, True)


def text_report(findings: DataFrame) -> DataFrame:
    """(line): severity, rule, message of findings, worst first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "rule_id", "finding_id").select(F.format_string("[%s] %s: %s", "severity", "rule_id", "message").alias("line"))
