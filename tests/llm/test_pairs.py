import random

import numpy as np
import pytest

from strataspark.llm import jaccard_join as jj
from strataspark.llm import neardup


def brute(groups, linked):
    """{id: (class, links)} by all pairs."""
    ids = sorted(groups)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(groups[a], groups[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near(a, b):
    return bool(a) and bool(b) and 1000 * len(a & b) >= 800 * len(a | b)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    texts = {}
    for k in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 60, 200]))]
        for c in range(rnd.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(c % 3):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            texts[k * 10 + c] = " ".join(words)
    return texts


@pytest.mark.parametrize("blocks", [(1000, 400), (3, 2)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jj, "NODE_BLOCK", blocks[0])
    monkeypatch.setattr(jj, "CLUSTER_BLOCK", blocks[1])
    texts = corpus(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.jaccard_classes(docs).collect()}
    assert got == brute({k: set(jj.grams(t).tolist()) for k, t in texts.items()}, near)


def test_jaccard_join_odd_documents(odd_docs, no_docs):
    rows = jj.jaccard_classes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and jj.jaccard_classes(no_docs).count() == 0
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in rows}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[7] == (6, 1, False)
    assert got[3] == (3, 0, True) and got[4] == (4, 0, True) and got[5] == (5, 0, True) and got[None] == (None, 0, True)


def test_prefix_shortens_until_the_target():
    assert jj.prefix_for(0.8, 16, 6, 0.995) == 5
    assert jj.prefix_for(0.95, 16, 6, 0.9) == 6
    assert jj.prefix_for(0.1, 2, 6, 0.999) == 1
    # many pairs of equal texts are all met at once; pairs at the threshold are not
    assert jj.forest_recall(10_000, 10_000, 0.8, 6) > 0.9995
    assert jj.forest_recall(10_000, 10_000 / jj.meets(0.8, 6), 0.8, 6) < 0.995
    assert jj.forest_recall(0, 0, 0.8, 5) == pytest.approx(jj.meets(0.8, 5))


def edges_at(seed, n):
    """n pairs of gram sets with a similarity of 0.80 to 0.85, as representatives 2k and 2k + 1."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        both = rng.integers(100, 400)
        own = int(both * rng.uniform(0.176, 0.25))
        all_ = rng.integers(0, 1 << 63, both + own, dtype=np.uint64)
        cut = both + own // 2
        for rep, s in ((2 * k, all_[:cut]), (2 * k + 1, np.concatenate([all_[:both], all_[cut:]]))):
            yield rep, (jj.signature(s) >> np.uint64(48)).astype(">u2").tobytes()


def test_forest_meets_pairs_at_the_threshold(spark):
    reps = spark.createDataFrame(list(edges_at(2, 2000)), "rep long, labels binary")
    met = {(r["b"], r["a"]) for r in jj.forest_edges(reps, 0.8, 0.9995).where("a is not null").collect()}
    assert sum((2 * k, 2 * k + 1) in met for k in range(2000)) >= 1996


def test_keep_one_goes_by_rows(spark):
    """One id with two texts, repeated rows, copies under other ids."""
    t, other = "one two three four five six seven", "another text that says something else entirely"
    rows = [(1, t, "a"), (1, t, "a"), (2, t, "b"), (3, other, "c"), (3, t, "d"), (4, t.upper(), "e"), (5, None, "f"), (5, None, "f"), (None, t, "g"), (6, other + " too", "h"), (7, other, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["a.b"]) for r in out.collect())
    assert got == [(0, "g"), (1, "a"), (3, "c"), (5, "f"), (5, "f"), (6, "h")]
    assert jj.keep_one(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(200, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    agree = (jj.signature(a) == jj.signature(b)).mean()
    assert abs(agree - 800 / 1200) < 0.2
    assert (jj.signature(a[:700]) == np.minimum(jj.signature(a[:300]), jj.signature(a[300:700]))).all()


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        if k % 4 and rows and rows[-1][1] is not None:
            v = np.array(rows[-1][1]) + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3])
        rows.append((k, v.tolist(), int(k // 40 % 3)))
    rows.append((n, rows[5][1], rows[5][2]))
    rows.append((n + 1, [2 * x for x in rows[5][1]], rows[5][2]))
    return rows


@pytest.mark.parametrize("block", [500, 20])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in neardup.near_duplicates(df, 0.98).collect()}
    want = brute({k: (np.array(v) / np.linalg.norm(v), label) for k, v, label in rows}, lambda a, b: a[1] == b[1] and a[0] @ b[0] >= 0.98)
    assert got == want


def test_near_duplicates_on_two_levels_of_centroids(spark, monkeypatch):
    for name, value in {"BLOCK": 20, "MAX_CENTROIDS": 8, "LEAF_SAMPLE": 60}.items():
        monkeypatch.setattr(neardup, name, value)
    rows = vectors(9, 400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    units = neardup.unit_rows(df).selectExpr("label", "vec_id as rep", "unit")
    centroids = neardup._centroids(units)
    assert 12 < sum(map(len, centroids.values())) <= 60
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in neardup.near_duplicates(df, 0.98).collect()}
    assert got == brute({k: (np.array(v) / np.linalg.norm(v), label) for k, v, label in rows}, lambda a, b: a[1] == b[1] and a[0] @ b[0] >= 0.98)


def test_near_duplicates_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "b"), (3, [1.0, 0.0], 2, None), (4, [1.0, 0.0], None, None), (5, None, 1, None), (6, [0.0, 0.0], 1, None),
        (7, [float("nan"), 1.0], 1, None), (8, [None, 1.0], 1, None), (9, [float("inf"), 1.0], 1, None), (10, [], 1, None), (11, [1.0, 0.0, 0.0], 1, None),
        (1, [1.0, 0.0], 1, "a"), (None, [1.0, 0.0], 1, None), (12, [1e-200, 0.0], 1, None), (13, [1e200, 0.0], 1, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")
    out = neardup.near_duplicates(df).collect()
    got = {r["vec_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (1, 3, True) and got[2] == (1, 3, False) and got[12] == (1, 3, False) and got[13] == (1, 3, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert got[k] == (k, 0, True)
    assert got[None] == (None, 0, True)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_graph_search_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[1::2] = x[::2] + 0.05 * rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = neardup.with_reverse(neardup.robust_prune(x))
    entries = np.unique(np.argmax(x @ neardup.kmeans(x, 16).T, axis=0))
    i, j = neardup.beam_search(x, links, entries, x, 48, 0.98)
    want = {tuple(p) for p in np.argwhere(x @ x.T >= 0.98)}
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_audit_judges_small_groups_apart(spark):
    """One group of 300 that is found whole, and 20 pairs of which none is found."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=24) + 0.001 * rng.normal(size=(300, 24))
    pairs = rng.normal(size=(20, 24)).repeat(2, axis=0) + 0.001 * rng.normal(size=(40, 24))
    x = np.vstack([hot, pairs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([("a", k, 1, v.tobytes()) for k, v in enumerate(x)], "label string, rep long, copies long, unit binary")
    links = spark.createDataFrame([(k, 299, 0) for k in range(300)], "rep long, links long, root long")
    assert neardup.audit(reps, links, 0.98) == {1: 0.0, 3: 1.0}


def test_linked_vectors_share_a_shard():
    """Nearest centroids by count (two) lose 3 to 6 in 100 of these pairs."""
    rng = np.random.default_rng(0)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    c = neardup.kmeans(unit(rng.normal(size=(4096, 32))), 256)
    x = unit(rng.normal(size=(1000, 32)))
    e = rng.normal(size=x.shape)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * unit(e - (e * x).sum(axis=1)[:, None] * x)
    for spread, _ in neardup.SETTINGS:
        assert all(set(neardup.shards_of(a, c, 0.98, spread)) & set(neardup.shards_of(b, c, 0.98, spread)) for a, b in zip(x, y, strict=True))


def test_missed_recall_ends_in_brute_force(spark, monkeypatch):
    """A search that finds nothing is replaced, after the last setting, by all pairs of a label in blocks."""
    monkeypatch.setattr(neardup, "beam_search", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(neardup, "BLOCK", 30)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, recall = neardup.near_duplicates_audited(df, 0.98)
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in out.collect()}
    assert min(recall[-2].values()) < 0.5 and min(recall[-1].values()) == 1.0 and len(recall) == len(neardup.SETTINGS) + 1
    assert got == brute({k: (np.array(v) / np.linalg.norm(v), label) for k, v, label in rows}, lambda a, b: a[1] == b[1] and a[0] @ b[0] >= 0.98)
