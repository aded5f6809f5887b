"""Impact of changed nodes: bounded reachability with hops, shortest paths, weakest-link grades and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.storage import forget, written
from strataspark.operators.browse import top_per_group
from strataspark.operators.graph import merged, oriented, shortest_paths, widest_grades

LIKELY = 600_000


# What the two profiles follow, how far and how many.
PROFILES = {
    "default": {"kinds": ("calls", "references", "imports", "contains", "implements", "reads_schema"), "max_depth": 10, "budget": 1000, "file_transit": True},
    "callers": {"kinds": ("calls", "references"), "max_depth": 10, "budget": 1000, "file_transit": False},
}


def profile_impact(edges: DataFrame, seeds: DataFrame, profile: str, **changes) -> DataFrame:
    """`impact` by the settings of a named profile, some of them changed."""
    p = PROFILES[profile] | changes
    return impact(edges, seeds, p["kinds"], p["max_depth"], p["budget"], file_transit=p["file_transit"])


def impact(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...], max_depth: int = 10, budget: int = 1000, direction: str = "backward", file_transit: bool = True) -> DataFrame:
    """(id, hops, path, grade, tier) of the nodes that seeds(id) reach, seeds left out, over edges(src, dst, kind, grade).

    At most `budget` nodes, by hops and then id; `truncated` on every row tells whether some were left out. grade is
    the best over walks of the least edge grade; from LIKELY on the tier is `likely`, else `possible`."""
    kept = edges.where(F.col("kind").isin(*kinds))
    # a file node that is no seed is reached but not left again, unless file_transit
    leave = None if file_transit else ~F.col("id").cast("string").startswith("file::")
    paths = shortest_paths(kept, seeds, max_depth, direction, leave)
    grades = widest_grades(kept, paths.select("id"), seeds, direction)
    found = written(paths.where("hops > 0").join(grades, "id"), "impact")  # counted, ordered and read
    more = found.agg((F.count("*") > budget).alias("truncated"))
    tier = F.when(F.col("grade") >= LIKELY, "likely").otherwise("possible")
    return found.withColumn("tier", tier).orderBy("hops", "id").limit(budget).crossJoin(F.broadcast(more))


def summary(found: DataFrame, k: int = 5) -> DataFrame:
    """The first k of each tier: grade down, hops up, id up."""
    return top_per_group(found, "tier", [F.desc("grade"), F.asc("hops"), F.asc("id")], k)


def frontier(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): nodes one step before changed(id) that did not change themselves."""
    before = edges.join(changed.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return before.join(changed, "id", "left_anti")


def damaged_callers(edges: DataFrame, broken: DataFrame, max_depth: int = 64) -> DataFrame:
    """(broken, id, hops, severity): callers of each broken(id) node; `breaking_error` where they call it themselves,
    else `impact_path_unverified`. Every broken node walks back on its own, all in one frontier."""
    steps = written(oriented(edges, "backward").select("src", "dst").where("src <> dst").distinct(), "callers")
    front = written(broken.select(F.col("id").alias("broken"), "id", F.lit(0).alias("hops")).distinct(), "callers")
    parts = [front]
    for depth in range(1, max_depth + 1):
        met = front.join(steps, F.col("id") == F.col("src")).select("broken", F.col("dst").alias("id")).distinct()
        for seen in parts:
            met = met.join(seen.select("broken", "id"), ["broken", "id"], "left_anti")
        front = written(met.withColumn("hops", F.lit(depth)), "callers")
        if front.isEmpty():
            break
        parts = merged([*parts, front], "callers")
    forget(steps)
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    severity = F.when(F.col("hops") == 1, "breaking_error").otherwise("impact_path_unverified")
    return done.where("hops > 0").withColumn("severity", severity)
