"""Co-change mining over commits: window accounting, pair counts, integer metrics."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from strataspark.functions.ppm import ratio_ppm, wilson_ppm

#: Rows and pairs that two blocks of files hold at most, about, and pairs, or cells of counts, that are held at once.
PAIR_ROWS, PAIR_COUNTS, CELLS = 1_000_000, 50_000_000, 1 << 21


def account(commits: DataFrame, changes: DataFrame, window_seconds: int = 15_811_200, max_files: int = 30) -> DataFrame:
    """(oid, n_paths, reason) of every commit; reason is null for those considered, else the first that holds.

    commits(oid, n_parents, ts seconds); changes(oid, path). The window is closed at both ends and ends at the
    newest commit that is neither merge nor root and has a time."""
    sizes = changes.groupBy("oid").agg(F.countDistinct("path").alias("n_paths"))
    newest = commits.agg(F.max("ts").alias("newest"))
    all_ = commits.join(sizes, "oid", "left").crossJoin(F.broadcast(newest)).withColumn("n_paths", F.coalesce("n_paths", F.lit(0)).cast("bigint"))
    reason = (
        F.when(F.col("n_parents") > 1, "merge_commit")
        .when(F.col("n_parents") == 0, "root_commit")
        .when(F.col("ts").isNull(), "missing_timestamp")
        .when((F.col("ts") < F.col("newest") - window_seconds) | (F.col("ts") > F.col("newest")), "outside_window")
        .when(F.col("n_paths") > max_files, "mass_commit")
        .when(F.col("n_paths") == 0, "no_changed_paths")
    )
    return all_.select("oid", "n_paths", reason.alias("reason"))


def accounting(accounted: DataFrame) -> DataFrame:
    """(reason, n): commits by reason; the considered ones under `considered`."""
    return accounted.groupBy(F.coalesce("reason", F.lit("considered")).alias("reason")).agg(F.count("*").alias("n"))


def considered(accounted: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.select("oid", "path").distinct().join(accounted.where("reason is null").select("oid"), "oid", "left_semi")


def pair_counts(items: DataFrame) -> DataFrame:
    """(a, b, together) of paths a < b that change in the same commits. A commit holds max_files paths at most, so the
    self-join gives a bounded number of pairs for each row; counts are combined before the shuffle."""
    left, right = items.select("oid", F.col("path").alias("a")), items.select("oid", F.col("path").alias("b"))
    return left.join(right, "oid").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))


def cochange(items: DataFrame, min_pair_commits: int = 2, max_edges: int | None = 500) -> DataFrame:
    """Rows of pairs with support, confidences, Wilson bounds and lift in ppm, by lift, count and names."""
    total = items.agg(F.countDistinct("oid").alias("total"))
    of = items.groupBy("path").agg(F.count("*").alias("n"))
    pairs = pair_counts(items).where(F.col("together") >= min_pair_commits)
    rows = (
        pairs.join(of.select(F.col("path").alias("a"), F.col("n").alias("with_a")), "a")
        .join(of.select(F.col("path").alias("b"), F.col("n").alias("with_b")), "b")
        .crossJoin(F.broadcast(total))
    )
    low_ab, high_ab = wilson_ppm("together", "with_a")
    low_ba, high_ba = wilson_ppm("together", "with_b")
    out = rows.select(
        "a", "b", "together", "with_a", "with_b", "total",
        ratio_ppm(F.col("together"), F.col("total")).alias("support_ppm"),
        ratio_ppm(F.col("together"), F.col("with_a")).alias("conf_ab_ppm"), low_ab.alias("conf_ab_lower"), high_ab.alias("conf_ab_upper"),
        ratio_ppm(F.col("together"), F.col("with_b")).alias("conf_ba_ppm"), low_ba.alias("conf_ba_lower"), high_ba.alias("conf_ba_upper"),
        ratio_ppm(F.col("together") * F.col("total"), F.col("with_a") * F.col("with_b")).alias("lift_ppm"),
    ).orderBy(F.desc("lift_ppm"), F.desc("together"), "a", "b")
    return out if max_edges is None else out.limit(max_edges)


def never_coupled(items: DataFrame, min_pair_commits: int = 2) -> DataFrame:
    """(path) of the paths that are in no pair of at least min_pair_commits."""
    pairs = pair_counts(items).where(F.col("together") >= min_pair_commits)
    coupled = pairs.select(F.col("a").alias("path")).union(pairs.select("b"))
    return items.select("path").distinct().join(coupled, "path", "left_anti")


def _block_pair_counts(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(a, b, resources) of each block pair, from its rows (pair, first, resource, paths) one pair after the other."""

    def rows():
        for batch in batches:
            yield from zip(batch["pair"].to_pylist(), batch["first"].to_pylist(), batch["resource"].to_pylist(), batch["paths"], strict=True)

    for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
        number: dict = {}
        sides: tuple = ([], []), ([], [])  # resources and paths of both blocks
        alone = False
        for _, first, resource, paths in group:
            alone = first is None  # a block with itself
            k = number.setdefault(resource, len(number))
            for side in sides if alone else sides[:1] if first else sides[1:]:
                side[0].append(k)
                side[1].append(paths.values)
        if not (sides[0][0] and sides[1][0]):
            continue
        values = pa.concat_arrays(sides[0][1] + sides[1][1]).unique()
        values = values.take(pc.sort_indices(values))
        (r_a, code_a), (r_b, code_b) = ((np.repeat(np.array(r), [len(v) for v in p]), pc.index_in(pa.concat_arrays(p), value_set=values).to_numpy()) for r, p in sides)
        own_a, own_b = np.unique(code_a), np.unique(code_b)
        order = np.argsort(code_a, kind="stable")
        r_a, at_a = r_a[order], np.searchsorted(own_a, code_a[order])
        order = np.argsort(r_b, kind="stable")
        at_b, size = np.searchsorted(own_b, code_b[order]), np.bincount(r_b, minlength=len(number))
        start, width = np.cumsum(size) - size, len(own_b)
        ends = np.searchsorted(at_a, np.arange(1, len(own_a) + 1))  # rows up to each path
        met = np.concatenate(([0], np.cumsum(size[r_a])))[ends]  # pairs up to each path
        low = 0
        while low < len(own_a):  # as many paths at once as CELLS allows, one at least
            done = met[low - 1] if low else 0
            high = max(low + 1, min(int(np.searchsorted(met, done + CELLS, "right")), low + CELLS // width))
            part = slice(ends[low - 1] if low else 0, ends[high - 1])
            n = size[r_a[part]]
            b = at_b[np.repeat(start[r_a[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            count = np.bincount(np.repeat(at_a[part] - low, n) * width + b, minlength=1)
            hit = np.flatnonzero(count)
            x, y = own_a[hit // width + low], own_b[hit % width]
            if alone:  # each pair once
                hit, x, y = hit[x < y], x[x < y], y[x < y]
            a, b = values.take(pa.array(np.minimum(x, y))).cast(kind), values.take(pa.array(np.maximum(x, y))).cast(kind)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(count[hit].astype(np.int64))], ["a", "b", "resources"])
            low = high


def hidden_coupling(uses: DataFrame) -> DataFrame:
    """(a, b, resources): pairs of files that name the same resource, with how many they share.

    Files are dealt into blocks, and the rows of each two blocks meet in one task, which counts their pairs and returns
    each once: a row is shuffled once for each block, and no pair is. There are so many blocks that two hold about
    PAIR_ROWS rows and PAIR_COUNTS pairs, before these are combined, at most."""
    u = uses.select("resource", "path").where("resource is not null and path is not null").distinct()
    total = u.groupBy("resource").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    blocks = max(1, math.ceil((total[0] or 0) * 2 / PAIR_ROWS), math.ceil(math.sqrt((total[1] or 0) / PAIR_COUNTS)))
    kind = u.schema["path"].dataType
    lists = u.groupBy("resource", F.pmod(F.xxhash64("path"), F.lit(blocks)).alias("block")).agg(F.collect_list("path").alias("paths"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = lists.select("resource", "paths", F.col("block").cast("int").alias("block"), other)
    pair = F.least("block", "other") * F.lit(blocks) + F.greatest("block", "other")
    dealt = dealt.select(pair.alias("pair"), F.when(F.col("block") != F.col("other"), F.col("block") < F.col("other")).alias("first"), "resource", "paths")
    dealt = dealt.repartition(blocks * (blocks + 1) // 2, "pair").sortWithinPartitions("pair")
    arrow = to_arrow_type(kind)
    return dealt.mapInArrow(lambda batches: _block_pair_counts(batches, arrow), StructType([StructField("a", kind), StructField("b", kind), StructField("resources", LongType())]))
