"""Near-duplicates among embeddings by a robust-pruned flat graph.

1. Vectors with equal label and equal direction form a class and go on as one representative.
2. Each label is cut into overlapping cluster shards (centroids: spherical k-means over a bounded sample): every
   representative joins the shard of its nearest centroid and of each other one whose border is not farther than
   linked vectors lie apart, see `shards_of`. A shard over BLOCK members is dealt out in blocks.
3. Each block gets a graph: nearest neighbours, robust-pruned. Adjacency lists of all blocks that hold a vector are
   united.
4. In every shard each vector is a query: a greedy beam search from the block's medoids and from what the united lists
   say of the query itself, then range expansion around whatever lies within the threshold. Finds are verified by cosine in double precision. A pair that shares several
   shards counts in the least of them, so a shard returns a row for each member (links, root), never the pairs.
5. The recall is audited by brute force, query by query, for groups of each size apart; below the target in any of
   them the join runs again with wider borders and a wider beam. If the last setting still misses it, all pairs of a
   label are compared, block by block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.common import components, forget, written
from strataspark.llm.jaccard_join import block_pairs, by_run, roots_of

BLOCK, DEGREE, ALPHA, POOL, MEDOIDS = 500, 24, 1.2, 64, 16
#: Centroids keep a cosine below this.
APART = 0.9
#: Centroids that are fitted on the driver, and rows of the sample for each.
MAX_CENTROIDS, SAMPLE_EACH = 2048, 16
#: Bytes of the centroids that are fitted under these, and rows that those of one are fitted on.
LEAF_BYTES, LEAF_SAMPLE = 1 << 26, 4096
#: Audit queries: at least this many, and this many times the square root of the rows.
AUDIT_QUERIES, AUDIT_ROOTS, TARGET_RECALL = 200, 4, 0.99
#: (spread, beam) of the first and of the later tries. The distance of two linked vectors across a border is that many
#: times what it is for a random direction; without bound no linked pair can part.
SETTINGS = ((2.0, 32), (3.0, 64), (float("inf"), 128))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit binary float64, key) of the rows that can link: label, id and vector are not null, all
    components are finite and not all zero."""

    def run(batches):
        for pdf in batches:
            rows = []
            for vec_id, label, v in zip(pdf["vec_id"], pdf["label"], pdf["embedding"], strict=True):
                if v is None:
                    continue
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                top = np.abs(x).max(initial=0.0)
                if not np.isfinite(top) or not np.isfinite(x).all() or top == 0:
                    continue
                x = x / top
                x /= np.sqrt(x @ x)
                rows.append((int(vec_id), str(label), x.tobytes(), hashlib.md5(x.tobytes()).digest()))
            yield pd.DataFrame(rows, columns=["vec_id", "label", "unit", "key"])

    usable = vectors.where("vec_id is not null and label is not null and embedding is not null")
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")]
    return usable.select(*cols).mapInPandas(run, "vec_id long, label string, unit binary, key binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (m := near == j).any():
                s = x[m].sum(axis=0)
                c[j] = s / max(np.sqrt(s @ s), 1e-12)
    # two centroids within one dense group would part it; the group may rather fill a shard, which is cut into blocks
    apart: list[int] = []
    for j in range(len(c)):
        if not apart or (c[apart] @ c[j]).max() < APART:
            apart.append(j)
    return c[apart]


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = POOL) -> np.ndarray:
    """n x degree neighbours (-1: none) of unit rows x. From each row's `pool` nearest the closest left is kept, and
    those that lie `alpha` times nearer to it than to the row are struck out, until `degree` are kept."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1)
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    p = min(pool, n - 1)
    cand = np.argpartition(-sim, p - 1, axis=1)[:, :p]
    own = np.take_along_axis(sim, cand, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    far = 1 - own  # squared distance / 2
    open_, out, kept = np.ones((n, p), bool), np.full((n, degree), -1), np.zeros(n, np.int64)
    for r in range(p):
        take = np.flatnonzero(open_[:, r] & (kept < degree))
        if not len(take):
            continue
        star = cand[take, r]
        out[take, kept[take]] = star
        kept[take] += 1
        between = 1 - sim[star[:, None], cand[take]]
        open_[take] &= ~((alpha**2) * between <= far[take])
    return out


def with_reverse(near: np.ndarray) -> np.ndarray:
    """near with up to as many reverse edges again, a row's closest neighbours first, so that rows can be met too."""
    n, degree = near.shape
    src, rank = np.nonzero(near >= 0)
    dst = near[src, rank]
    order = np.lexsort((src, rank, dst))
    dst, src = dst[order], src[order]
    nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
    some = nth < degree
    back = np.full((n, degree), -1)
    back[dst[some], nth[some]] = src[some]
    return np.hstack([near, back])


def beam_search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, least: float, own: tuple = ((), ())) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with cosine >= least. All queries start at the entries, and each at its own (query, row)
    pairs, and walk together: in each step every query expands its best open row of the beam; a row within the range
    (less a little slack) is always expanded."""
    n, m = len(x), len(q)
    sim = np.full((m, n), -np.inf, np.float32)  # of the rows that a query has met
    opened = np.zeros((m, n), bool)
    xf, qf = x.astype(np.float32), q.astype(np.float32)
    sim[:, entries] = qf @ xf[entries].T
    qs, rows = (np.asarray(a, np.int64) for a in own)
    sim[qs, rows] = np.einsum("ij,ij->i", qf[qs], xf[rows])
    beam = min(beam, n)
    live = np.arange(m)
    while len(live):
        s = sim[live]
        cut = np.partition(s, n - beam, axis=1)[:, n - beam]
        allowed = (s >= np.minimum(cut, least - 0.01)[:, None]) & np.isfinite(s) & ~opened[live]
        best = np.where(allowed, s, -np.inf)
        row = best.argmax(axis=1)
        go = np.isfinite(best[np.arange(len(live)), row])
        live, row = live[go], row[go]
        opened[live, row] = True
        near = links[row]
        qi, at = np.nonzero(near >= 0)
        rows, qs = near[qi, at], live[qi]
        new = ~np.isfinite(sim[qs, rows])
        qs, rows = qs[new], rows[new]
        sim[qs, rows] = np.einsum("ij,ij->i", qf[qs], xf[rows])
    qi, row = np.nonzero(sim >= least - 1e-4)
    exact = np.einsum("ij,ij->i", q[qi], x[row])
    keep = exact >= least
    return qi[keep], row[keep]


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)


def _graphs(batches):
    for pdf in by_run(batches, ["label", "shard", "a"]):
        for _, same in pdf.groupby(pdf["unit"].map(len), sort=True):  # vectors of unequal length cannot link
            ids = same["rep"].to_numpy()
            near = with_reverse(robust_prune(_stack(same)))
            yield pd.DataFrame({"rep": ids, "near": [ids[r[r >= 0]] for r in near]})


def _searches(beam: int, least: float):
    def half(q, qid, q_near, x, xid, adjacency):
        """Index pairs of queries q in the graph over x."""
        order = np.argsort(xid)

        def places(ids):
            at = order[np.minimum(np.searchsorted(xid, ids, sorter=order), len(xid) - 1)]
            return at[xid[at] == ids]

        links = np.full((len(xid), max((len(a) for a in adjacency), default=0) + 1), -1)
        for k, a in enumerate(adjacency):
            at = places(a)
            links[k, : len(at)] = at
        known = [places(np.append(a, i)) for a, i in zip(q_near, qid, strict=True)]
        own = np.repeat(np.arange(len(qid)), [len(k) for k in known]), np.concatenate(known)
        entries = np.unique(np.argmax(x @ kmeans(x, MEDOIDS).T, axis=0))
        # rows that no list reaches become entries too, so that every row can be met
        reached = np.zeros(len(xid), bool)
        todo = entries
        while True:
            reached[todo] = True
            todo = np.unique(links[todo].ravel())
            todo = todo[(todo >= 0) & ~reached[todo]]
            if not len(todo):
                rest = np.flatnonzero(~reached)
                if not len(rest):
                    break
                todo = rest[:1]
                entries = np.append(entries, todo)
        return beam_search(x, links, entries, q, beam, least, own)

    def run(batches):
        for whole in by_run(batches, ["label", "shard", "a", "b"]):
            for _, pdf in whole.groupby(whole["unit"].map(len), sort=True):
                one = pdf["a"].iloc[0] == pdf["b"].iloc[0]
                ids, n, x = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), _stack(pdf)
                part = pdf["part"].to_numpy()
                sets = pdf["shards"].tolist()
                left = np.arange(len(ids)) if one else np.flatnonzero(part == 0)
                right = left if one else np.flatnonzero(part == 1)
                pairs = set()
                for a, b in [(left, right)] if one else [(left, right), (right, left)]:
                    if len(a) and len(b):
                        near = pdf["near"]
                        i, j = half(x[a], ids[a], near.iloc[a].tolist(), x[b], ids[b], near.iloc[b].tolist())
                        i, j = a[i], b[j]
                        ok = i != j
                        pairs.update(zip(np.minimum(i, j)[ok].tolist(), np.maximum(i, j)[ok].tolist(), strict=True))
                shard = int(pdf["shard"].iloc[0])
                pairs = [(i, j) for i, j in sorted(pairs) if shard == min(set(sets[i]) & set(sets[j]))]
                if not pairs:
                    continue
                yield _member_rows(ids, n, *np.array(pairs).T)

    return run


def _member_rows(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """(rep, links, root) of the members that index pairs (i, j), each given once, link."""
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][roots_of(len(ids), place[i], place[j])[place]]
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})


def all_links(reps: DataFrame, least: float) -> DataFrame:
    """(rep, links, root) from all pairs of a label: the exact way, quadratic in the label, in tasks of two blocks."""
    sizes = reps.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))

    def run(batches):
        for whole in by_run(batches, ["label", "a", "b"]):
            for _, pdf in whole.groupby(whole["unit"].map(len), sort=True):
                ids, n, x, part = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), _stack(pdf), pdf["part"].to_numpy()
                near = x @ x.T >= least
                one = pdf["a"].iloc[0] == pdf["b"].iloc[0]
                i, j = np.nonzero(np.triu(near, 1) if one else near & ((part == 0)[:, None] & (part == 1)[None, :]))
                if len(i):
                    yield _member_rows(ids, n, i, j)

    return (
        block_pairs(reps.select("label", "rep", "copies", "unit").join(sizes, "label"), "blocks", "rep")
        .select("label", "a", "b", "part", "rep", "copies", "unit")
        .repartition("label", "a", "b")
        .sortWithinPartitions("label", "a", "b", "rep")
        .mapInPandas(run, "rep long, links long, root long")
    )


def _centroids(reps: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of the labels that have more than BLOCK representatives, one for about half a block. Up to MAX_CENTROIDS in
    all are fitted here on a bounded sample. More are fitted under these, each one's on rows that are nearest to it, by
    tasks of at most LEAF_SAMPLE rows; all together they take LEAF_BYTES at most, beyond which shards grow."""
    big = reps.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).orderBy(F.desc("n"), "label").limit(MAX_CENTROIDS // 2).collect()
    if not big:
        return {}
    count = {r["label"]: r["n"] for r in big}
    wanted = {k: -(-n // (BLOCK // 2)) for k, n in count.items()}
    scale = min(1.0, MAX_CENTROIDS / sum(wanted.values()))
    first = {k: max(2, int(v * scale)) for k, v in wanted.items()}
    rows = _sampled(reps, {k: SAMPLE_EACH * first[k] / n for k, n in count.items()}).limit(2 * MAX_CENTROIDS * SAMPLE_EACH).collect()
    tops = {}
    for label in wanted:
        got = sorted((r["rep"], bytes(r["unit"])) for r in rows if r["label"] == label)
        if not got:
            continue
        usual = max({len(u) for _, u in got}, key=[len(u) for _, u in got].count)
        x = np.stack([np.frombuffer(u, np.float64) for _, u in got if len(u) == usual])
        tops[label] = kmeans(x.copy(), first[label])
    if scale == 1.0 or not tops:
        return tops
    leaves = LEAF_BYTES // (8 * max(c.shape[1] for c in tops.values()))
    room = min(1.0, leaves / sum(wanted.values()))
    under = {k: max(1, int(wanted[k] * room / len(c))) for k, c in tops.items()}  # centroids under each first one, on average
    shared = reps.sparkSession.sparkContext.broadcast(tops)

    def nearest(batches):
        for pdf in batches:
            top = [_nearest(shared.value.get(k), np.frombuffer(u, np.float64)) for k, u in zip(pdf["label"], pdf["unit"], strict=True)]
            yield pdf[["label", "rep", "unit"]].assign(top=top)

    def fit(batches):
        for pdf in by_run(batches, ["label", "top"]):
            x = _stack(pdf)
            for c in kmeans(x.copy(), max(1, min(len(x), -(-len(x) // SAMPLE_EACH)))):
                yield pd.DataFrame({"label": [pdf["label"].iloc[0]], "centroid": [c.tobytes()]})

    sample = _sampled(reps, {k: SAMPLE_EACH * under[k] * len(c) / count[k] for k, c in tops.items()})
    placed = sample.mapInPandas(nearest, "label string, rep long, unit binary, top long").where("top >= 0")
    order = F.row_number().over(Window.partitionBy("label", "top").orderBy(F.xxhash64("rep", F.lit(6)), "rep"))
    bounded = placed.withColumn("k", order).where(F.col("k") <= LEAF_SAMPLE).select("label", "top", "rep", "unit")
    fitted = bounded.repartition("label", "top").sortWithinPartitions("label", "top", "rep").mapInPandas(fit, "label string, centroid binary").limit(2 * leaves).collect()
    out: dict[str, list] = {}
    for label, c in sorted((r["label"], bytes(r["centroid"])) for r in fitted):
        out.setdefault(label, []).append(np.frombuffer(c, np.float64))
    return tops | {k: np.stack(v) for k, v in out.items()}


def _sampled(reps: DataFrame, share: dict[str, float]) -> DataFrame:
    """(label, rep, unit) of about that share of each label's rows, by a hash of rep; other labels give none."""
    rows = reps.sparkSession.createDataFrame([(k, min(1.0, v)) for k, v in share.items()], "label string, share double")
    place = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1_000_003)) / 1_000_003
    return reps.join(F.broadcast(rows), "label").where(place < F.col("share")).select("label", "rep", "unit")  # MAX_CENTROIDS / 2 rows at most


def _nearest(c: np.ndarray | None, v: np.ndarray) -> int:
    """The nearest of centroids c, -1 where there are none of v's length."""
    return int((c @ v).argmax()) if c is not None and c.shape[1] == len(v) else -1


def shards_of(v: np.ndarray, c: np.ndarray, least: float, spread: float) -> list[int]:
    """The centroids c whose shards the unit vector v joins: the nearest one, and each whose border with it is within
    the reach of a link. Vectors of cosine >= least lie at most chord = sqrt(2 - 2 * least) apart, so if v joined all
    borders within chord it would meet each of its links in that one's nearest shard. Across one border a random
    direction of that length goes chord / sqrt(dimension), `spread` times which is the reach, chord at most."""
    chord = np.sqrt(max(2 - 2 * least, 0.0))
    reach = chord * min(1.0, spread / np.sqrt(len(v)))
    near = c @ v
    best = int(near.argmax())
    close = np.flatnonzero(near[best] - near <= 2 * reach + 1e-9)  # unit vectors are 2 apart at most
    apart = np.sqrt(np.maximum(((c[close] - c[best]) ** 2).sum(axis=1), 0.0))
    return close[near[best] - near[close] <= reach * apart + 1e-9].tolist()


def _found(reps: DataFrame, centroids: dict[str, np.ndarray], least: float, spread: float, beam: int) -> DataFrame:
    """(rep, links, root) that the search finds, written."""
    members, links = _links(reps, centroids, least, spread, beam)
    found = written(links, "links")
    forget(members)
    return found


def _links(reps: DataFrame, centroids: dict[str, np.ndarray], least: float, spread: float, beam: int) -> tuple[DataFrame, DataFrame]:
    shared = reps.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for pdf in batches:
            shards = []
            for label, u in zip(pdf["label"], pdf["unit"], strict=True):
                c, v = shared.value.get(label), np.frombuffer(u, np.float64)
                if c is None or c.shape[1] != len(v):
                    shards.append([0])
                else:
                    shards.append(shards_of(v, c, least, spread))
            yield pdf.assign(shards=shards)

    placed = reps.select("label", "rep", "copies", "unit").mapInPandas(assign, "label string, rep long, copies long, unit binary, shards array<long>")
    members = placed.withColumn("shard", F.explode("shards"))
    sizes = placed.select("label", F.explode("shards").alias("shard")).groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = written(members.join(sizes, ["label", "shard"]), "members")
    graph = (
        members.withColumn("a", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .select("label", "shard", "a", "rep", "unit")
        .repartition("label", "shard", "a")
        .sortWithinPartitions("label", "shard", "a", "rep")
        .mapInPandas(_graphs, "rep long, near array<long>")
    )
    near = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list of 2 * DEGREE at most for each shard
    return members, (
        block_pairs(members.join(near, "rep"), "blocks", "rep")
        .select("label", "shard", "a", "b", "part", "rep", "copies", "unit", "shards", "near")
        .repartition("label", "shard", "a", "b")
        .sortWithinPartitions("label", "shard", "a", "b", "rep")
        .mapInPandas(_searches(beam, least), "rep long, links long, root long")
    )


def _size_class(n: Column) -> Column:
    """0 for none, else the number of decimal digits."""
    return F.when(n > 0, F.length(n.cast("string"))).otherwise(0)


def audit(reps: DataFrame, links: DataFrame, least: float, queries: int = AUDIT_QUERIES) -> dict[int, float]:
    """Mean recall of a representative's links by the number of decimal digits of its true links, which come from brute
    force over all rows of its label; a size that no query has is missing.

    At least `queries` queries are made, and AUDIT_ROOTS times the square root of the representatives; as many are
    taken from each size of found links (none, too), and count for the rows that they stand for."""
    found = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("label", "rep", "unit", "copies").join(found.withColumnRenamed("rep", "f"), F.col("rep") == F.col("f"), "left")
    known = known.select("label", "rep", "unit", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    known = known.withColumn("size", _size_class(F.col("links")))
    sizes = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}
    if not sizes:
        return {}
    each = -(-max(queries, int(AUDIT_ROOTS * sum(sizes.values()) ** 0.5)) // len(sizes))
    chosen = []
    for size in sorted(sizes):
        chosen += known.where(F.col("size") == size).orderBy(F.xxhash64("rep", F.lit(9)), "rep").limit(each).collect()
    by_label: dict[tuple[str, int], list] = {}
    for r in chosen:
        by_label.setdefault((r["label"], len(r["unit"])), []).append((r["rep"], np.frombuffer(bytes(r["unit"]), np.float64)))
    shared = reps.sparkSession.sparkContext.broadcast({k: ([i for i, _ in own], np.stack([v for _, v in own]).T) for k, own in by_label.items()})

    def run(batches):
        for pdf in batches:
            for (label, size), part in pdf.groupby([pdf["label"], pdf["unit"].map(len)]):
                own = shared.value.get((label, size))
                if own:
                    ids, q = own
                    mass = np.zeros(len(ids))
                    for at in range(0, len(part), 500):
                        some = part.iloc[at : at + 500]
                        mass += some["copies"].to_numpy() @ (_stack(some) @ q >= least)
                    yield pd.DataFrame({"rep": ids, "mass": mass.astype(np.int64)})

    true = reps.select("label", "copies", "unit").mapInPandas(run, "rep long, mass long").groupBy("rep").agg(F.sum("mass").alias("mass"))
    mass = {r["rep"]: r["mass"] for r in true.collect()}  # a row for each query
    taken = {size: min(each, n) for size, n in sizes.items()}
    got: dict[int, list[float]] = {}
    for r in chosen:
        links_there = mass[r["rep"]] - r["copies"]
        if links_there > 0:
            weight = sizes[r["size"]] / taken[r["size"]]
            total = got.setdefault(len(str(links_there)), [0.0, 0.0])
            total[0] += weight * min(1.0, r["links"] / links_there)
            total[1] += weight
    return {size: a / b for size, (a, b) in sorted(got.items())}


def near_duplicates(vectors: DataFrame, least: float = 0.98, target: float = TARGET_RECALL) -> DataFrame:
    """`near_duplicates_audited` without the recall."""
    return near_duplicates_audited(vectors, least, target)[0]


def near_duplicates_audited(vectors: DataFrame, least: float = 0.98, target: float = TARGET_RECALL) -> tuple[DataFrame, list[dict[int, float]]]:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label), and the recall of each
    try by the number of digits of true links (see `audit`); the last is that of the result.

    n_links: other vectors of the same label with cosine >= least. component_id: the smallest vec_id that links
    reach. Rows that share a vec_id are one vector (each row is returned; the least direction key counts). Rows
    without label or direction link with nothing; a null vec_id stays null and kept."""
    units = written(unit_rows(vectors), "units")
    one = units.groupBy("vec_id").agg(F.min(F.struct("key", "label", "unit")).alias("v")).select("vec_id", "v.*")
    # both ids of a class come from here, so a row finds its representative without the vector
    classes = one.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    reps = written(classes, "vectors")
    centroids, recall = _centroids(reps), []
    for spread, beam in [*SETTINGS, (None, None)]:
        if spread is None:
            found = written(all_links(reps, least), "links")
        else:
            found = _found(reps, centroids, least, spread, beam)
        recall.append(audit(reps, found, least))
        if spread is None or min(recall[-1].values(), default=1.0) >= target:
            break
        forget(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    component = linked.select(F.col("node").alias("rep"), "component")
    result = reps.join(links, "rep", "left").join(component, "rep", "left").select(
        F.col("label").alias("l"), F.col("key").alias("k"), F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    result = written(result, "result")
    for done in (found, linked, reps):
        forget(done)
    per_id = one.select("vec_id", "label", "key").join(result, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k"))).select(F.col("vec_id").alias("v"), "component", "links")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per_id, F.col("vec_id") == F.col("v"), "left")
    component = F.coalesce("component", "vec_id")
    out = out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
    return out, recall
