"""Graph edits, row projections of analysed files, and revisions of symbols side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.coverage import rank, state


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one with the greatest order."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(order)).alias("__row")).select("__row.*")


def build_graph(nodes: DataFrame, edges: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from additions: of nodes(id, ...) the last by `order` counts, equal edges(src, dst, kind) are one."""
    return last_of(nodes, ["id"], order), edges.dropDuplicates(["src", "dst", "kind"])


def remove_symbols(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, ...) and edges(src, dst, ...) without gone(id) and what touches it."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(*edges.columns)


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, path, ...) and edges(src, dst, kind, path, ...) after files(path) were read again: their nodes and the
    edges that they hold are replaced. Edges of other files into a node that is gone stay, and dangle."""
    kept_nodes = nodes.join(files.select("path"), "path", "left_anti").select(*nodes.columns)
    kept_edges = edges.join(files.select("path"), "path", "left_anti").select(*edges.columns)
    return kept_nodes.unionByName(new_nodes), kept_edges.unionByName(new_edges)


# How sure an edge of a coverage state is in the row form.
CONFIDENCE = {"verified": "exact", "partial": "heuristic"}


def graph_rows(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row form of symbols(id, name, path, kind) and edges(src, dst, kind, coverage): nodes(id, kind, path, coverage) with a
    node for each file and for each end that is no symbol (`unknown`), and edges(src, dst, kind, confidence) with a
    `contains` edge from each file to its symbols."""
    own = symbols.select("id", "kind", "path", F.lit("verified").alias("coverage"))
    file_id = F.concat(F.lit("file::"), "path")
    files = symbols.select(file_id.alias("id"), F.lit("file").alias("kind"), "path", F.lit("verified").alias("coverage")).distinct()
    known = own.unionAll(files)
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(known.select("id"), "id", "left_anti")
    unknown = ends.select("id", F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit("unknown").alias("coverage"))
    sure = F.lit("dynamic_unknown")
    for s, c in CONFIDENCE.items():
        sure = F.when(F.col("coverage") == s, c).otherwise(sure)
    rows = edges.select("src", "dst", "kind", sure.alias("confidence"))
    contains = symbols.select(file_id.alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit("exact").alias("confidence"))
    return known.unionAll(unknown), rows.unionAll(contains)


def symbol_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, status) of symbols(id, path, signature) in two revisions: added, deleted, modified or unchanged."""
    b = before.select("id", F.col("path").alias("bp"), F.col("signature").alias("bs"), F.lit(True).alias("in_b"))
    a = after.select("id", F.col("path").alias("ap"), F.col("signature").alias("asig"), F.lit(True).alias("in_a"))
    same = F.col("bs").eqNullSafe(F.col("asig")) & F.col("bp").eqNullSafe(F.col("ap"))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return b.join(a, "id", "full").select("id", F.coalesce("ap", "bp").alias("path"), status.alias("status"))


def folder_clusters(paths: DataFrame) -> DataFrame:
    """(path, folder, cluster): clusters are numbered from 0 in the order of folder names. The folders are numbered, not
    the paths, so the one ordered list is as long as there are folders."""
    each = paths.select("path", F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^$", ".").alias("folder"))
    folders = each.select("folder").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("folder")) - 1)
    return each.join(folders, "folder").select("path", "folder", "cluster")


def time_travel_frame(before: DataFrame, after: DataFrame, edges: DataFrame, cap: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the view of one revision: the first `cap` symbols by id with status, cluster and place, and the
    edges between them."""
    from strataspark.operators.events import golden_angle_layout

    shown = symbol_status(before, after).orderBy("id").limit(cap)
    nodes = shown.join(folder_clusters(shown.select("path").distinct()).select("path", "cluster"), "path", "left").join(golden_angle_layout(shown.select("id")), "id")
    ids = shown.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inside.select(*edges.columns)


def semantic_verdict(changes: DataFrame, frontier: DataFrame, coverage: DataFrame) -> DataFrame:
    """(commit, verdict, blast) of changes(commit, breaking), frontier(commit, id) and coverage(commit, coverage): unknown where
    the analysis is, breaking where a change is, warn where something lies on the frontier, else pass."""
    c = changes.groupBy("commit").agg(F.max(F.col("breaking").cast("int")).alias("breaking"))
    f = frontier.groupBy("commit").agg(F.countDistinct("id").alias("blast"))
    rows = coverage.groupBy("commit").agg(F.max(rank(F.col("coverage"))).alias("worst")).join(c, "commit", "left").join(f, "commit", "left")
    blast = F.coalesce("blast", F.lit(0))
    verdict = F.when(F.col("worst") == 3, "UNKNOWN").when(F.col("breaking") == 1, "BREAKING").when(blast > 0, "WARN").otherwise("PASS")
    return rows.select("commit", verdict.alias("verdict"), blast.cast("bigint").alias("blast"))


def overall_coverage(parts: DataFrame) -> DataFrame:
    """(coverage) of an analysis from parts(kind, coverage): unknown if any part is or a `gap` is among them, unsupported
    if any is, partial if any is or a scan is `incomplete`, else verified; unknown without parts."""
    worst = F.max(F.when(F.col("kind") == "gap", 3).when(F.col("kind") == "incomplete", F.greatest(rank(F.col("coverage")), F.lit(1))).otherwise(rank(F.col("coverage"))))
    return parts.agg(state(F.coalesce(worst, F.lit(3))).alias("coverage"))


def edge_priority(edges: DataFrame, limit: int) -> DataFrame:
    """The first edges: calls first, then verified ones, then by ends and kind."""
    return edges.orderBy(F.desc(F.col("kind") == "calls"), F.desc(F.col("coverage") == "verified"), "src", "dst", "kind").limit(limit)


def numbered(events: DataFrame, key: str, order: list[str], blocks: int = 64) -> DataFrame:
    """events with seq, from 1 within key in the given order. Each key is counted in blocks of its first order column,
    by range, so that one busy key is not one task."""
    first = order[0]
    span = events.groupBy(key).agg(F.min(first).cast("double").alias("__low"), F.max(first).cast("double").alias("__high"))
    block = F.least(F.floor((F.col(first).cast("double") - F.col("__low")) * blocks / (F.col("__high") - F.col("__low") + 1)), F.lit(blocks - 1))
    rows = events.join(span, key).withColumn("__block", block)
    before = rows.groupBy(key, "__block").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__block")) - F.col("__n"))
    local = rows.withColumn("__local", F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order)))
    return local.join(before.drop("__n"), [key, "__block"]).withColumn("seq", F.col("__before") + F.col("__local")).select(*events.columns, "seq")
