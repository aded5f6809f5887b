"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

1. Every text becomes its set of hashed word 5-grams (lower-cased, split at white space; a shorter text is one
   gram of all its words), a signature of TREES x DEPTH minima and a key of the whole set. Rows with equal sets form
   one class and go on as one representative; of representatives with equal signatures one stands in the forest.
2. The forest: in each tree a representative's label is the sequence of that tree's DEPTH minima, and the sorted labels
   are a trie whose nodes are the runs of equal prefixes. Matching starts at the full depth, the longest prefixes. The
   pairs that meet in a node are compared by their signatures; from the similarity of those that look like links, and
   the known chance of such a pair to meet at this depth, follows how many were missed (`forest_recall`). While the
   recall is below the target all prefixes are shortened by one; at the shortest, see `prefix_for`, a pair at the
   threshold itself meets with that probability.
3. Pairs that meet in the last round are joined into candidate clusters (connected components of star edges). Within a
   cluster every pair is verified exactly, on the gram sets themselves, in blocks of bounded size, so a cluster of
   thousands is many block pairs. A block pair returns a row for each member (its number of links and the root of its
   component there), never the pairs.

Nodes and clusters are measured before they are grouped; a large one is dealt out by block pairs. Nothing is dropped.
Null texts and texts without words have no grams and link with nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import columns_of, components, forget, fresh, may_hold, memo, trim, written

WORDS, TREES, DEPTH, TARGET_RECALL = 5, 16, 6, 0.9995
#: Members of a block of a trie node, and members and grams of a block of a cluster.
NODE_BLOCK, CLUSTER_BLOCK, GRAM_BLOCK = 300, 400, 200_000
#: A pair in a node goes on if its signature similarity is at most this many standard errors below the threshold.
SLACK = 4.0
#: The recall is estimated as if so many pairs at the threshold itself had been met besides those of the data, so few
#: matches (or none) are no reason to stop early.
PRIOR = 100.0

_MUL = np.random.default_rng(20240117).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(20240118).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_PLACE = np.random.default_rng(20240119).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_WORD_LIMIT = 250_000


def meets(similarity, prefix: int, trees: int = TREES):
    """The chance that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_for(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with probability >= target."""
    k = depth
    while k > 1 and meets(threshold, k, trees) < target:
        k -= 1
    return k


def forest_recall(found: float, expected: float, threshold: float, prefix: int, prior: float = PRIOR) -> float:
    """Estimated share of links met at this prefix. `found` is how many likely links met; `expected` is the sum of
    1 / meets(their similarity), the number of links that so many finds stand for."""
    return (found + prior) / (expected + prior / meets(threshold, prefix))


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = memo("grams")
    trim(known, _WORD_LIMIT)
    get, h = known.get, []
    for w in words:
        v = get(w)
        if v is None:
            v = known[w] = xxhash.xxh64_intdigest(w)
        h.append(v)
    h = np.array(h, np.uint64)
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(" ".join(words), 1)], np.uint64)
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        part = h[k : len(h) - n + 1 + k]
        g = (g ^ (part >> np.uint64(31)) ^ part) * _PLACE[k]
    g ^= g >> np.uint64(32)
    return np.unique(g * _PLACE[0])


def signature(g: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of a non-empty gram set."""
    out = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 512):  # so that a very long text needs no large table
        part = g[at : at + 512, None] * _MUL + _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, set_key, n_grams, labels) of docs(doc_id, text); labels holds the leading 16 bits of the minima of all
    trees, one tree after the other. set_key is null where there is no gram."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part, rows = pdf.iloc[at : at + 1000], []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    g = grams(text if isinstance(text, str) else None)
                    if not len(g):
                        rows.append((doc_id, None, 0, None))
                        continue
                    rows.append((doc_id, xxhash.xxh128_digest(g.tobytes()), len(g), (signature(g) >> np.uint64(48)).astype(">u2").tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "set_key", "n_grams", "labels"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, set_key binary, n_grams int, labels binary"
    )


def block_pairs(members: DataFrame, blocks: str, member: str) -> DataFrame:
    """members once for each pair of blocks (a <= b) that holds theirs, with columns a, b and part (0: it is in a, 1: in b).
    A group of one block gives the pair (0, 0)."""
    mine = F.pmod(F.xxhash64(member), F.col(blocks))
    with_block = members.withColumn("__mine", mine)
    other = with_block.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return (
        other.withColumn("a", F.least("__mine", "__other"))
        .withColumn("b", F.greatest("__mine", "__other"))
        .withColumn("part", (F.col("__mine") != F.col("a")).cast("int"))
        .drop("__mine", "__other")
    )


def by_run(batches, keys: list[str]):
    """Whole runs of equal keys from batches that come sorted by them."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = [pdf[c].to_numpy() for c in keys]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        cuts = [0, *change.tolist()]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield pdf.iloc[s:e]
        held = pdf.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of 0..n-1's component under the given index pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _node_edges(least: float, threshold: float, prefix: int):
    """Star edges (a, b) between members of a node whose signatures agree in at least that share of places; and a row
    without ends for the likely links (similarity >= threshold) of all nodes: how many there are, and how many they
    stand for. A pair that meets in several trees counts in each by its share."""

    def run(batches):
        out_a, out_b, n_out, found, expected = [], [], 0, 0.0, 0.0
        for pdf in by_run(batches, ["node", "a", "b"]):
            ids = pdf["rep"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["labels"]), ">u2").astype(np.uint16).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, sig = ids[order], sig[order]
            part = pdf["part"].to_numpy()[order]
            whole = pdf["a"].iloc[0] == pdf["b"].iloc[0]
            rows = range(len(ids) - 1) if whole else np.flatnonzero(part == 0)
            right_all = np.arange(len(ids)) if whole else np.flatnonzero(part == 1)
            left, right = [], []
            for i in rows:
                cand = np.arange(i + 1, len(ids)) if whole else right_all
                agree = sig[cand] == sig[i]
                share = agree.mean(axis=1)
                near = share >= least
                left.append(np.full(near.sum(), i))
                right.append(cand[near])
                likely = share >= threshold
                if likely.any():
                    trees = agree[likely].reshape(-1, TREES, DEPTH)[:, :, :prefix].all(axis=2).sum(axis=1)
                    weight = 1 / np.maximum(trees, 1)
                    found += weight.sum()
                    expected += (weight / meets(share[likely], prefix)).sum()
            if left:
                root = roots_of(len(ids), np.concatenate(left), np.concatenate(right))
                moved = root != np.arange(len(ids))
                out_a.append(ids[moved])
                out_b.append(ids[root[moved]])
                n_out += int(moved.sum())
            if n_out > 20_000:
                yield edges(out_a, out_b)
                out_a, out_b, n_out = [], [], 0
        if n_out:
            yield edges(out_a, out_b)
        if found:
            yield pd.DataFrame({"a": [None], "b": [None], "found": [found], "expected": [expected]}).astype({"a": "Int64", "b": "Int64"})

    def edges(a, b):
        a = np.concatenate(a)
        return pd.DataFrame({"a": a, "b": np.concatenate(b), "found": np.zeros(len(a)), "expected": np.zeros(len(a))})

    return run


def _matches(reps: DataFrame, threshold: float, prefix: int) -> DataFrame:
    """What `_node_edges` gives for all trie nodes of two or more at this prefix length."""
    width = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keys = reps.select("rep", "labels", tree).select("rep", F.xxhash64("tree", F.expr(f"substring(labels, tree * {width} + 1, {2 * prefix})")).alias("node"))
    # of nodes with the same members (count, least and sum of hashes) one is enough
    mass = F.sum(F.xxhash64("rep").cast("decimal(38,0)"))
    nodes = keys.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low"), mass.alias("mass")).where("n >= 2")
    nodes = nodes.groupBy("n", "low", "mass").agg(F.min("node").alias("node")).select("node", F.ceil(F.col("n") / NODE_BLOCK).alias("blocks"))
    members = keys.join(nodes, "node").join(reps.select("rep", "labels"), "rep")
    least = threshold - SLACK * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    return (
        block_pairs(members, "blocks", "rep")
        .select("node", "a", "b", "part", "rep", "labels")
        .repartition("node", "a", "b")
        .sortWithinPartitions("node", "a", "b")
        .mapInPandas(_node_edges(least, threshold, prefix), "a long, b long, found double, expected double")
    )


def forest_edges(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """Edges (a, b) that hold the candidate clusters of reps(rep, labels) together, written; see the module's step 2."""
    floor = prefix_for(threshold, target=target)
    for prefix in range(DEPTH, floor - 1, -1):
        got = written(_matches(reps, threshold, prefix), "matches")
        if prefix == floor:
            break
        found, expected = got.agg(F.coalesce(F.sum("found"), F.lit(0.0)), F.coalesce(F.sum("expected"), F.lit(0.0))).first()
        if forest_recall(found, expected, threshold, prefix) >= target:
            break
        forget(got)
    return got


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right, i < j where left is right) with Jaccard similarity >= num / den."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets])
    _, inv = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    right_inv = np.concatenate([inv[start[j] : start[j + 1]] for j in right])
    right_at = np.concatenate(([0], np.cumsum(size[right])[:-1]))
    mark, li, lj = np.zeros(inv.max() + 1, np.int32), [], []
    same = np.array_equal(left, right)
    for i in left:
        mark[inv[start[i] : start[i + 1]]] = 1
        both = np.add.reduceat(mark[right_inv], right_at)
        mark[inv[start[i] : start[i + 1]]] = 0
        hit = both * den >= num * (size[i] + size[right] - both)
        if same:
            hit &= right > i
        j = right[hit]
        li.append(np.full(len(j), i))
        lj.append(j)
    return np.concatenate(li), np.concatenate(lj)


def _cluster_links(num: int, den: int):
    def run(batches):
        for pdf in by_run(batches, ["cluster", "a", "b"]):
            pdf = pdf.drop_duplicates("rep")  # repeated rows
            ids, n = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
            sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
            part = pdf["part"].to_numpy()
            everyone = np.arange(len(ids))
            whole = pdf["a"].iloc[0] == pdf["b"].iloc[0]
            i, j = verify(sets, everyone if whole else np.flatnonzero(part == 0), everyone if whole else np.flatnonzero(part == 1), num, den)
            if len(i):
                links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = everyone
                root = ids[order][roots_of(len(ids), place[i], place[j])[place]]
                some = links > 0
                yield pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of thousandths, for exact comparison."""
    return round(threshold * 1000), 1000


def _documents(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    """(doc_id, set_key, rows, class_id, n_links, kept): one row for each distinct pair of doc_id and gram set."""
    num, den = ratio(threshold)
    sig = written(signatures(docs), "signatures")
    one = written(sig.groupBy("doc_id", "set_key").agg(F.count("*").alias("rows")), "documents")
    usable = "set_key is not null and doc_id is not null"
    classes = one.where(usable).groupBy("set_key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    same = [F.first(c).alias(c) for c in ("n_grams", "labels")]  # functions of the set
    reps = sig.where(usable).groupBy("set_key").agg(*same).join(classes, "set_key")
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    forget(sig)

    heads = written(reps.groupBy("labels").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "heads")
    edges = forest_edges(heads, threshold, target)
    alike = reps.select("rep", "labels").join(heads.where("rep <> other").select(F.col("rep").alias("b"), "labels"), "labels").select(F.col("rep").alias("a"), "b")
    joined = components(edges.select("a", "b").unionAll(alike))
    clusters = joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    size = written(reps.select("set_key", "rep", "low", "copies", "n_grams").join(clusters, "rep"), "clusters")
    for done in (heads, edges, joined):
        forget(done)
    blocks = size.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n_grams") / GRAM_BLOCK)).alias("blocks"))
    wanted = written(size.join(blocks, "cluster").select("rep", "low", "cluster", "copies", "blocks", "set_key"), "wanted")
    forget(size)

    def gram_sets(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                raw = [grams(t).tobytes() for t in part["text"]]
                own = [xxhash.xxh128_digest(g) == k for g, k in zip(raw, part["set_key"], strict=True)]
                yield part[["cluster", "rep", "copies", "blocks"]].assign(grams=raw)[own]

    texts = docs.select(F.col("doc_id").cast("long").alias("low"), F.col("text").cast("string").alias("text"))
    texts = may_hold(texts, "low", wanted, "low", "wanted").where("wanted").join(wanted, "low")
    sets = texts.select("cluster", "rep", "copies", "blocks", "set_key", "text").mapInPandas(
        gram_sets, "cluster long, rep long, copies long, blocks long, grams binary"
    )
    found = written(
        block_pairs(sets, "blocks", "rep")
        .select("cluster", "a", "b", "part", "rep", "copies", "grams")
        .repartition("cluster", "a", "b")
        .sortWithinPartitions("cluster", "a", "b", "rep")
        .mapInPandas(_cluster_links(num, den), "rep long, links long, root long"),
        "links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    group = linked.select(F.col("node").alias("rep"), F.col("component").alias("group"))
    known = reps.select("set_key", "rep", "low", "copies").join(links, "rep", "left").join(group, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    first = known.groupBy("group").agg(F.min(F.struct("low", "set_key")).alias("first"))
    result = known.join(first, "group").select(
        F.col("set_key").alias("key"),
        F.col("first.low").alias("class"),
        F.col("first.set_key").alias("class_set"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    result = written(result, "result")
    for done in (wanted, reps, found, linked):
        forget(done)
    known_id = F.col("doc_id").isNotNull()
    class_id = F.when(known_id, F.coalesce("class", "doc_id"))
    return one.join(result, F.col("set_key") == F.col("key"), "left").select(
        "doc_id",
        "set_key",
        "rows",
        class_id.alias("class_id"),
        F.when(known_id, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.coalesce((class_id == F.col("doc_id")) & (F.col("class_set").isNull() | (F.col("class_set") == F.col("set_key"))), F.lit(True)).alias("kept"),
    )


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of every row of docs(doc_id, text).

    A document is a doc_id with a gram set: rows equal in both are one document (each row is returned, with the same
    values), and rows that share a doc_id only are documents of their own. n_links: the other documents whose sets
    have Jaccard similarity >= threshold (equal sets included). class_id: the smallest doc_id that links reach, the
    row's own without links. kept: it is the first document, by doc_id and set key, of its class. A null doc_id is
    compared with nothing: its class_id is null, it has no links and is kept."""
    rows, step = F.col("rows"), 10_000  # rows of a document, in arrays of bounded length
    out = _documents(docs, threshold, target).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((rows - 1) / step))))
    out = out.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), rows - F.col("__k") * step))))
    return out.select("doc_id", "class_id", "n_links", "kept")


def keep_one(docs: DataFrame, threshold: float = 0.8, target: float = TARGET_RECALL) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that `jaccard_classes` keeps, each document once: of rows with equal doc_id
    and gram set the least by text and then by all columns stays. Rows without doc_id or without words all stay."""
    documents = written(_documents(docs, threshold, target), "classes")
    many = documents.where("doc_id is not null").groupBy("doc_id").agg(F.sum("rows").alias("rows")).where("rows > 1").select("doc_id")
    many = written(many, "repeated")
    gone = documents.where(~F.col("kept")).select("doc_id").distinct()
    touched = written(gone.union(many).distinct().select(F.col("doc_id").alias("__touched")), "touched")
    columns, maybe, key_name = columns_of(docs), fresh(docs, "maybe"), fresh(docs, "set_key")
    flagged = may_hold(docs, "doc_id", touched, "__touched", maybe)
    open_ = flagged.where(F.col(maybe)).select(*columns)
    untouched = open_.join(touched, open_["doc_id"].cast("long") == F.col("__touched"), "left_anti")
    plain = flagged.where(~F.col(maybe)).select(*columns).unionAll(untouched)
    if many.isEmpty():
        return plain
    # ids of several rows: which of them go is told by the gram set of each row
    ids = many.select(F.col("doc_id").alias("__many"))
    again = open_.join(ids, open_["doc_id"].cast("long") == F.col("__many"), "left_semi").withColumn(key_name, _set_key(F.col("text").cast("string")))
    kept = documents.where(F.col("kept") & F.col("set_key").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("set_key").alias("__set"))
    wordless = again.where(F.col(key_name).isNull()).select(*columns)
    again = again.where(F.col(key_name).isNotNull()).join(kept, (again["doc_id"].cast("long") == F.col("__id")) & (F.col(key_name) == F.col("__set")), "left_semi")
    whole = F.struct(*columns)
    least = again.groupBy(F.col("doc_id").alias("__id"), F.col(key_name).alias("__set")).agg(
        F.min_by(whole, F.struct(F.col("text").cast("string").alias("text"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("row"))).alias("__whole")
    )
    least = least.select("__whole.*")
    return plain.unionAll(wordless).unionAll(least)


def _set_key(text: Column) -> Column:
    """The key of a text's gram set; null for a text without words."""

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        sets = [grams(t if isinstance(t, str) else None) for t in texts]
        return pd.Series([xxhash.xxh128_digest(g.tobytes()) if len(g) else None for g in sets], dtype=object)

    return key(text)
