"""Commit graphs and line histories."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.storage import forget, written


def first_parent_walk(commits: DataFrame, start, limit: int) -> DataFrame:
    """(oid, step) of the first `limit` commits from start along first parents, by doubling: after k rounds every commit
    knows its 2**k-th ancestor, so a walk of n steps takes log n joins and not n."""
    jump = written(commits.select("oid", F.try_element_at("parents", F.lit(1)).alias("to")).where("to is not null"), "jump")
    walk = commits.where(F.col("oid") == start).select("oid", F.lit(0).cast("bigint").alias("step"))
    reach = 1
    while reach < limit:
        far = walk.join(jump, "oid").select(F.col("to").alias("oid"), (F.col("step") + reach).alias("step"))
        walk = written(walk.unionAll(far), "walk")
        if walk.count() < 2 * reach:
            break
        then = written(jump.join(jump.select(F.col("oid").alias("mid"), F.col("to").alias("next")), F.col("to") == F.col("mid")).select("oid", F.col("next").alias("to")), "jump")
        forget(jump)
        jump, reach = then, 2 * reach
    return walk.where(F.col("step") < limit)


def topological_levels(commits: DataFrame) -> DataFrame:
    """(oid, level): 0 for commits without parents, else one more than the highest parent. A distributed order of the
    commit graph: by level, then id. Peels level by level; commits on a cycle get no row."""
    edges = written(commits.select("oid", F.explode("parents").alias("parent")).distinct(), "parents")
    left = written(commits.select("oid").distinct(), "left")
    out, level = [], 0
    while True:
        blocked = edges.join(left.select(F.col("oid").alias("parent")), "parent", "left_semi").select("oid").distinct()
        now = written(left.join(blocked, "oid", "left_anti").withColumn("level", F.lit(level).cast("bigint")), "level")
        if now.isEmpty():
            break
        out.append(now)
        if len(out) > 8:
            merged = out[0]
            for o in out[1:]:
                merged = merged.unionAll(o)
            out = [written(merged, "levels")]
        rest = written(left.join(now, "oid", "left_anti").select("oid"), "left")
        forget(left)
        left, level = rest, level + 1
    merged = out[0]
    for o in out[1:]:
        merged = merged.unionAll(o)
    return merged


def decorate(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """commits with the sorted names of the refs(name, oid) that point at them."""
    names = refs.groupBy("oid").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("refs"))
    return commits.join(names, "oid", "left").withColumn("refs", F.coalesce("refs", F.lit("")))


def lanes(commits: DataFrame) -> DataFrame:
    """(oid, lane): 0 for linear commits, else 1 + idx % 3."""
    return commits.select("oid", F.when(F.size("parents") <= 1, F.lit(0)).otherwise(1 + F.col("idx") % 3).cast("bigint").alias("lane"))


def blame(versions: DataFrame) -> DataFrame:
    """(path, line, text, oid): for each line of the last of versions(path, idx, oid, content) the version that brought it.
    A file's versions are one sequence and are read one after the other in its task, two at a time."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lines, owner = [], []
        for oid, content in pdf.sort_values("idx")[["oid", "content"]].itertuples(index=False):
            new = (content or "").split("\n")
            by = [oid] * len(new)
            for block in difflib.SequenceMatcher(a=lines, b=new, autojunk=False).get_matching_blocks():
                by[block.b : block.b + block.size] = owner[block.a : block.a + block.size]
            lines, owner = new, by
        return pd.DataFrame({"path": key[0], "line": range(1, len(lines) + 1), "text": lines, "oid": owner})

    return versions.groupBy("path").applyInPandas(run, "path string, line int, text string, oid string")


def hunks(pairs: DataFrame) -> DataFrame:
    """(path, kind, old_start, old_lines, new_start, new_lines) of pairs(path, before, after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, before, after in pdf[["path", "before", "after"]].itertuples(index=False):
                a, b = ((t.split("\n") if isinstance(t, str) and t else []) for t in (before, after))
                rows += [(path, k, i + 1, j - i, m + 1, n - m) for k, i, j, m, n in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if k != "equal"]
            yield pd.DataFrame(rows, columns=["path", "kind", "old_start", "old_lines", "new_start", "new_lines"])

    return pairs.mapInPandas(run, "path string, kind string, old_start int, old_lines int, new_start int, new_lines int")
