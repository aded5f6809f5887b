"""Finding, listing, paging and counting over symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.text import package_key
from strataspark.operators.graph import degrees


def find_symbols(symbols: DataFrame, pattern: str, kind: str | None = None, name_only: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols whose name, path or (unless name_only) id holds the pattern, whatever the case; ordered by id and name,
    with the honest total of all hits on every row. A blank pattern is an error; limit is at most 1000."""
    if not pattern.strip():
        raise ValueError("blank pattern")
    low = pattern.lower()
    hit = F.lower("name").contains(low) | F.lower("path").contains(low)
    if not name_only:
        hit = hit | F.lower("id").contains(low)
    found = symbols.where(hit if kind is None else hit & (F.col("kind") == kind))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("id", "name").offset(offset).limit(min(limit, 1000))
    return page.crossJoin(F.broadcast(total))  # one row


def top_degree(edges: DataFrame, symbols: DataFrame, top: int = 25) -> DataFrame:
    """The `top` (1..500) symbols by degree, then id; symbols without edges count as 0."""
    d = degrees(edges)
    ranked = symbols.join(d, "id", "left").select("id", "kind", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fan_in", "fan_out", "degree")])
    return ranked.orderBy(F.desc("degree"), "id").limit(max(1, min(top, 500)))


def code_map(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n): symbols by kind, symbols by package (first two path segments), edges by kind."""
    parts = [
        symbols.groupBy(F.col("kind").alias("key")).count().withColumn("section", F.lit("kind")),
        symbols.groupBy(package_key(F.col("path")).alias("key")).count().withColumn("section", F.lit("package")),
        edges.groupBy(F.col("kind").alias("key")).count().withColumn("section", F.lit("edge_kind")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("section", "key", F.col("count").cast("bigint").alias("n"))


def ego_network(edges: DataFrame, node: str, kinds: tuple[str, ...] = ("calls", "references", "imports")) -> DataFrame:
    """(direction, neighbor, kind, coverage) of one node's edges of the given kinds."""
    kept = edges.where(F.col("kind").isin(*kinds))
    out = kept.where(F.col("src") == node).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("neighbor"), "kind", "coverage")
    return out.unionAll(kept.where(F.col("dst") == node).select(F.lit("incoming"), "src", "kind", "coverage"))


def neighbours(edges: DataFrame, node: str, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Distinct (neighbor, kind) of a node in either direction, ordered and paged."""
    both = ego_network(edges, node, tuple(k for k in ([kind] if kind else ALL_KINDS)))
    return both.select("neighbor", "kind").distinct().orderBy("neighbor", "kind").offset(offset).limit(min(limit, 1000))


# Kinds of edges.
ALL_KINDS = "calls references imports contains inherits implements reads_schema writes_schema test_covers statistical_co_change".split()


def neighbourhood_counts(edges: DataFrame) -> DataFrame:
    """(id, callers, callees, inexact): distinct callers and callees over call edges, and edges of partial or unknown
    coverage at either end, for every endpoint."""
    calls = F.col("kind") == "calls"
    inexact = F.col("coverage").isin("partial", "unknown").cast("int")
    ends = edges.select(F.col("src").alias("id"), F.when(calls, F.col("dst")).alias("callee"), F.lit(None).cast("string").alias("caller"), inexact.alias("x")).unionAll(
        edges.select(F.col("dst").alias("id"), F.lit(None).cast("string"), F.when(calls, F.col("src")), inexact)
    )
    return ends.groupBy("id").agg(F.countDistinct("caller").alias("callers"), F.countDistinct("callee").alias("callees"), F.sum("x").alias("inexact"))


# Grades in ppm.
GRADES = {"unrated": 0, "name_level": 250_000, "structural": 500_000, "inferred": 600_000, "resolved": 900_000, "declared": 1_000_000}


def edge_grade(kind: Column, coverage: Column, tier: Column) -> Column:
    """How sure an edge is, in ppm. `tier` is the parsed resolution tier (imported-name, bare-name, unresolved, ...)."""
    named = tier.isin("imported-name", "bare-name", "unresolved")
    return (
        F.when(coverage.isin("unknown", "unsupported") | coverage.isNull(), GRADES["unrated"])
        .when(coverage == "partial", F.when(named, GRADES["name_level"]).otherwise(GRADES["inferred"]))
        .when(kind.isin("contains", "imports"), GRADES["structural"])
        .when(kind.isin("inherits", "implements"), GRADES["declared"])
        .when(kind == "statistical_co_change", GRADES["inferred"])
        .when(named, GRADES["name_level"])
        .otherwise(GRADES["resolved"])
        .cast("bigint")
    )


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank and how many more there are (`omitted`)."""
    counts = rows.groupBy(group).agg(F.count("*").alias("__n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(counts, group).withColumn("omitted", F.greatest(F.col("__n") - k, F.lit(0))).drop("__n")


def universe(nodes: DataFrame, edges: DataFrame, node_limit: int) -> DataFrame:
    """(id, degree, hub) of a bounded view: half the most connected nodes, and an even spread over the rest by id.

    The rest is numbered by range-partitioned position, so no single task sorts all of it."""
    hubs = max(1, node_limit // 2)
    d = degrees(edges).select("id", "degree")
    ranked = nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    top = ranked.orderBy(F.desc("degree"), "id").limit(hubs).withColumn("hub", F.lit(True))
    rest = numbered(ranked.join(top.select("id"), "id", "left_anti"), ["id"], "at")
    total = rest.count()
    take = min(node_limit - hubs, total)
    if take <= 0:
        return top
    # position p is the i-th of floor(i * total / take) when floor of the next index moves past it
    i = F.ceil(F.col("at") * take / total).cast("bigint")
    spread = rest.where((F.floor(i * total / take) == F.col("at")) & (i < take)).select("id", "degree", F.lit(False).alias("hub"))
    return top.unionByName(spread)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows numbered from 0 in the order of keys. Sorted by range; counts of the partitions give each its start."""
    from strataspark.functions.storage import written

    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    placed = written(placed, "numbered")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return placed.withColumn("__local", local).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__local") - 1).drop("__part", "__p", "__before", "__local")
