"""Graph operators over edges(src, dst, ...) and nodes(id, ...).

Loops keep only a frontier or a label per node, write each step to the shared folder and stop when a count shows
that nothing changed; no adjacency is ever gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.storage import forget, written


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, degree) of every endpoint."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("dst").alias("id"), F.lit(1), F.lit(0))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count("*").alias("degree"))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges both of whose ends are in chosen(id)."""
    ids = chosen.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind = external) for endpoints without a node."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("kind", F.lit("external"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as walked: 'forward', 'backward' or 'both'."""
    if direction == "forward":
        return edges
    back = reversed_edges(edges)
    return back if direction == "backward" else edges.select(*back.columns).unionAll(back)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, direction: str = "forward", expandable: Column | None = None) -> DataFrame:
    """(id, hops) of all nodes within max_depth steps (None: all) of seeds(id), seeds at 0. `expandable` is a
    predicate on id that a node other than a seed must meet to be left again."""
    steps = written(oriented(edges, direction).select("src", "dst").where("src <> dst").distinct(), "steps")
    frontier = written(seeds.select("id", F.lit(0).alias("hops")).distinct(), "reach")
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        leave = frontier if depth == 1 or expandable is None else frontier.where(expandable)
        met = leave.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        for seen in parts:
            met = met.join(seen.select("id"), "id", "left_anti")
        frontier = written(met.withColumn("hops", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        parts = merged([*parts, frontier], "reach")
    forget(steps)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def merged(parts: list[DataFrame], tag: str, most: int = 4) -> list[DataFrame]:
    """parts, all but the last written as one table once there are more than `most`, so few tables are subtracted however
    deep the walk. The last is the frontier, which the next step reads."""
    if len(parts) <= most:
        return parts
    one = written(_union(parts[:-1]), tag)
    for p in parts[:-1]:
        forget(p)
    return [one, parts[-1]]


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "forward", expandable: Column | None = None) -> DataFrame:
    """(id, hops, path) with the shortest path from a seed, the least in order among equals; path is an array of ids.
    `expandable` is a predicate on id that a node other than a seed must meet to be left again."""
    steps = written(oriented(edges, direction).select("src", "dst").where("src <> dst").distinct(), "steps")
    frontier = written(seeds.select("id", F.lit(0).alias("hops"), F.array("id").alias("path")).distinct(), "paths")
    parts = [frontier]
    for depth in range(1, max_depth + 1):
        leave = frontier if depth == 1 or expandable is None else frontier.where(expandable)
        met = (
            leave.join(steps, F.col("id") == F.col("src"))
            .groupBy("dst")
            .agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
            .select(F.col("dst").alias("id"), F.lit(depth).alias("hops"), "path")
        )
        for seen in parts:
            met = met.join(seen.select("id"), "id", "left_anti")
        frontier = written(met, "paths")
        if frontier.isEmpty():
            break
        parts = merged([*parts, frontier], "paths")
    forget(steps)
    return _union(parts)


def widest_grades(edges: DataFrame, reached: DataFrame, seeds: DataFrame, direction: str = "forward", top: int = 1_000_000) -> DataFrame:
    """(id, grade): the best over all walks inside reached(id) of the least edge grade on the walk; seeds have `top`.

    edges(src, dst, grade). Exact max-min fixpoint: each round offers every node min(grade of neighbour, edge)."""
    inside = reached.select("id")
    steps = (
        oriented(edges, direction)
        .join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .groupBy("src", "dst")
        .agg(F.max("grade").alias("grade"))
    )
    steps = written(steps, "graded")
    start = seeds.select("id").distinct().withColumn("g", F.lit(top).cast("bigint"))
    now = written(inside.join(start, "id", "left").select("id", F.coalesce("g", F.lit(-1).cast("bigint")).alias("grade")), "grades")
    while True:
        offer = (
            now.where("grade >= 0")
            .select(F.col("id").alias("src"), F.col("grade").alias("from_grade"))
            .join(steps, "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.max(F.least("from_grade", "grade")).alias("offer"))
        )
        after = now.join(offer, "id", "left").select("id", F.greatest("grade", F.coalesce("offer", "grade")).alias("grade"), (F.coalesce("offer", "grade") > F.col("grade")).alias("moved"))
        after = written(after, "grades")
        moved = not after.where("moved").isEmpty()
        forget(now)
        now = after
        if not moved:
            return now.select("id", "grade")


def _with_least(sym: DataFrame, salts: int) -> DataFrame:
    """sym(u, v) with m, the least of u and all its v. The least goes to each (u, salt of v) first, so that a hub's
    rows, of which there are any number, meet it in `salts` keys and not in one."""
    salted = sym.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps. Each step is a partial aggregate and a join; with about the square root
    of the edges as salts a hub is at most so many rows to any task, once as its salts and once as the rows of a salt.
    Only a count and a checksum a step reach the driver."""
    both = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    salts = max(1, int(both.count() ** 0.5))
    state = None
    for _ in range(rounds):
        sym = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(sym, salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, salts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "stars")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(both)
        forget(large)
        both = after
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError("connected components did not settle")
    out = both.select(F.col("u").alias("node"), F.col("v").alias("component")).union(both.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._written_to = both._written_to
    return out


def _spread(start: DataFrame, steps: DataFrame, tag: str) -> DataFrame:
    """start(id, color) with every color raised to the greatest that steps(src, dst) carry to it."""
    now = written(start, tag)
    while True:
        offer = steps.join(now.select(F.col("id").alias("src"), F.col("color").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("c"))
        after = written(
            now.join(offer, "id", "left").select("id", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.coalesce("c", "color") > F.col("color")).alias("moved")), tag
        )
        moved = not after.where("moved").isEmpty()
        forget(now)
        now = after.drop("moved")
        now._written_to = after._written_to
        if not moved:
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every endpoint of edges(src, dst); component is the smallest member.

    Colouring: the greatest id that reaches a node is its color; nodes that reach the color's own node inside the
    color are its component. Nodes without both kinds of neighbours are cut off first, as components of one."""
    left = written(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    found: list[DataFrame] = []
    n = left.count()
    while n:
        while True:  # edges that lie on no cycle because an end has no way in or out
            core = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            core = written(core.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            before, n = n, core.count()
            forget(left)
            left = core
            if n in (0, before):
                break
        if not n:
            break
        nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        color = _spread(nodes.withColumn("color", F.col("id")), left, "colors")
        tinted = (
            left.join(color.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src")
            .join(color.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst")
            .where("cs = cd")
            .select("src", "dst")
        )
        members = written(reach(tinted, color.where("id = color").select("id"), None, "backward").select("id").join(color, "id"), "members")
        found.append(members)
        rest = left.join(members.select(F.col("id").alias("src")), "src", "left_anti").join(members.select(F.col("id").alias("dst")), "dst", "left_anti")
        rest = written(rest, "scc")
        forget(left)
        left, n = rest, rest.count()
    if not found:
        return ends.select("id", F.col("id").alias("component"))
    members = _union(found)
    least = members.groupBy("color").agg(F.min("id").alias("component"))
    return ends.join(members.join(least, "color").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members) of every strong component of two or more, and of every self-loop; members are sorted."""
    comp = strong_components(edges)
    big = comp.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    loops = edges.where("src = dst").select(F.col("src").alias("component")).distinct()
    return big.join(loops.withColumn("loop", F.lit(True)), "component", "left").where("size > 1 or loop").drop("loop")
