"""Correlating observed spans with declared routes and symbols; redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.text import redaction_kind, route_template, subsumes


def redaction_counts(texts: DataFrame) -> DataFrame:
    """(kind, n): white-space separated words of texts(text) that have a redacted shape, by kind."""
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("w"))
    # a word of any shape holds a digit, a dot or a colon; the rest is skipped before the shapes are tried
    kinds = words.where(F.col("w").rlike("[0-9.:]")).select(redaction_kind(F.col("w")).alias("kind"))
    return kinds.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def redact_words(texts: DataFrame) -> DataFrame:
    """texts with every word of a redacted shape replaced by [kind]."""
    words = F.transform(F.split("text", " "), lambda w: F.coalesce(F.concat(F.lit("["), redaction_kind(w), F.lit("]")), w))
    return texts.withColumn("text", F.array_join(words, " "))


def occupancy_key(route, function, rpc):
    """What a span occupies: its route, else its function, else its rpc, else nothing known."""
    return (
        F.when(route.isNotNull(), F.concat(F.lit("route:"), route_template(route)))
        .when(function.isNotNull(), F.concat(F.lit("function:"), function))
        .when(rpc.isNotNull(), F.concat(F.lit("rpc:"), rpc))
        .otherwise("uncorrelated")
    )


def match_routes(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """(span_id, operation_id, outcome) of spans(span_id, method, path) against routes(method, template, operation_id).

    A route of no method covers all. The most specific route wins: fewest placeholders, then its template; if several
    operations remain the span is ambiguous. Spans join on segment count and first segment, or on a route that begins
    with a placeholder, so no span meets all routes."""
    def keyed(df, col):
        return df.withColumn("segments", F.size(F.split(col, "/"))).withColumn("head", F.element_at(F.split(col, "/"), 2))

    r = keyed(routes, "template").withColumn("wild", F.col("head").rlike(r"^\{.*\}$")).withColumn("holes", F.size(F.regexp_extract_all("template", F.lit(r"(\{[^/]*\})"), F.lit(1))))
    s = keyed(spans, "path")
    ok = subsumes(F.col("template"), F.col("path")) & (F.col("r_method").isNull() | F.col("method").isNull() | (F.upper("r_method") == F.upper("method")))
    r = r.withColumnRenamed("method", "r_method").withColumnsRenamed({"segments": "r_segments", "head": "r_head"})
    near = s.join(r.where(~F.col("wild")), (F.col("segments") == F.col("r_segments")) & (F.col("head") == F.col("r_head")) & ok)
    wild = s.join(r.where("wild"), (F.col("segments") == F.col("r_segments")) & ok)
    w = Window.partitionBy("span_id").orderBy("holes")
    best = near.unionByName(wild).withColumn("place", F.rank().over(w)).where("place = 1")
    one = best.groupBy("span_id").agg(F.countDistinct("operation_id").alias("n"), F.min("operation_id").alias("operation_id"))
    outcome = F.when(F.col("n").isNull(), "undocumented").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return spans.select("span_id").join(one, "span_id", "left").select("span_id", "operation_id", outcome.alias("outcome"))


def undocumented_routes(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(shape, method, example, services, invocations) of the spans that no declared route covers."""
    lost = spans.join(matches.where("outcome = 'undocumented'").select("span_id"), "span_id", "left_semi")
    shape = F.regexp_replace("path", r"/[0-9]+(?=/|$)", "/{}")
    return lost.groupBy(shape.alias("shape"), "method").agg(
        F.min("path").alias("example"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"), F.count("*").alias("invocations")
    )


def unseen(declared: DataFrame, observed: DataFrame, key: str, windows: DataFrame, required: int) -> DataFrame:
    """declared rows never observed, with the verdict `dead`, or `insufficient_evidence` on every row when fewer than
    `required` distinct windows were observed."""
    n = windows.agg(F.countDistinct("window_id").alias("n"))
    lost = declared.join(observed.select(key).distinct(), key, "left_anti")
    return lost.crossJoin(F.broadcast(n)).withColumn("verdict", F.when(F.col("n") >= required, "dead").otherwise("insufficient_evidence")).drop("n")


def duplicated_routes(routes: DataFrame) -> DataFrame:
    """(shape, method, n) of route shapes that are declared more than once."""
    return routes.groupBy(route_template(F.col("template")).alias("shape"), "method").agg(F.count("*").alias("n")).where("n > 1")
