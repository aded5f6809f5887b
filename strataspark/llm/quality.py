"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text are hashed counts of word 1- and 2-grams and of 1- to 3-grams of word shapes (case class,
digits, the punctuation run itself, and whether a word repeats the one before), so noise made of unseen words
is still recognised. Values are square roots of relative frequencies, so every text has unit length. Scoring
is a sparse dot product of a text's own features with the weight table (2**BITS float32).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import fold, labelled_sample, memo, one_text_each, release, trim

BITS = 18
#: Rows learned from, at most, of each label.
TRAIN_ROWS = {0: 2500, 1: 4000}
THRESHOLD = 0.7
#: Fold (crc32 of the id modulo 4) that is never learned from.
PARTS, HELD = 4, 2

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KNOWN_LIMIT = 200_000
#: Low bits of a remembered token that number its shape; the rest are the token's own hash.
_SHAPE_BITS = 16


def _shape(tok: str) -> str:
    if tok[0].isdigit():
        return "9"
    if not (tok[0].isalpha() or tok[0] == "_"):
        return tok
    return "U" if len(tok) > 1 and tok.isupper() else "W" if tok[0].isupper() else "w"


def _learn(tok: str, known: dict[str, int]) -> int:
    word, shape = xxhash.xxh64_intdigest(tok) >> (_SHAPE_BITS + 1), xxhash.xxh64_intdigest(_shape(tok), 7) >> (64 - _SHAPE_BITS)
    known[tok] = word << _SHAPE_BITS | shape
    return known[tok]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text, buckets ascending; both empty for a text without tokens."""
    toks = _TOKEN.findall(text)
    if not toks:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    known = memo("quality")
    trim(known, _KNOWN_LIMIT)
    get = known.get
    both = np.array([get(t) or _learn(t, known) for t in toks], np.uint64)
    w, s = both >> np.uint64(_SHAPE_BITS), (both & np.uint64((1 << _SHAPE_BITS) - 1)) * _M2
    s[1:] += (w[1:] == w[:-1]).astype(np.uint64) * _M3
    streams = [w, w[1:] * _M2 + w[:-1], s + _M3, s[1:] * _M2 + s[:-1] + _M1, s[2:] * _M2 + s[1:-1] * _M3 + s[:-2] + _M2]
    idx, n = np.unique(np.concatenate([_mix(x) for x in streams]), return_counts=True)
    return idx, np.sqrt(n / (5.0 * len(toks))).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates over rows of (bucket, value, label).
    Classes are weighted to equal mass. Without rows of both classes nothing is learned: all weights are zero, and
    every score one half."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    count = np.bincount([y for *_, y in rows], minlength=2)
    if not count.all():
        return np.zeros(size, np.float32)
    weight = len(rows) / (2 * count)
    rng = np.random.default_rng(seed)

    def current(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            idx, val, y = rows[k]
            i, x = np.append(idx.astype(np.int64), size - 1), np.append(val, 0.3)
            w = current(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * weight[y] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return current(np.arange(size)).astype(np.float32)


def score_text(text: str, weights: np.ndarray) -> float:
    idx, val = features(text)
    return float(1 / (1 + np.exp(-np.clip(weights[idx] @ val + 0.3 * weights[-1], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: dict[int, int] = TRAIN_ROWS) -> np.ndarray:
    """Train on a bounded sample of labelled docs(doc_id, text) outside the held-out fold, one text for each id (the
    least of several). Features are made on the executors; the driver gets at most sum(rows) sparse vectors, each of
    2**BITS entries at most."""
    sample = labelled_sample(labels, label, PARTS, HELD, rows)

    def run(batches):
        for pdf in batches:
            got = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "idx": [i.astype("<i4").tobytes() for i, _ in got], "val": [v.tobytes() for _, v in got]})

    picked = one_text_each(docs, sample).select("doc_id", "label", "text").mapInPandas(run, "doc_id long, label int, idx binary, val binary").collect()
    picked.sort(key=lambda r: r["doc_id"])  # an id comes once
    # the vectors stay the 4-byte numbers that came; a row is widened while it is learned from
    weights = train_ftrl([(np.frombuffer(r["idx"], "<i4"), np.frombuffer(r["val"], np.float32), r["label"]) for r in picked])
    del picked
    release()
    return weights


def quality_score(text: Column, weights: np.ndarray, spark) -> Column:
    """Score column in 0..1; null counts as empty text, whose score is the bias alone."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([score_text(t if isinstance(t, str) else "", shared.value) for t in s], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text); repeated rows are scored each."""
    return docs.select("doc_id", quality_score(F.col("text"), weights, docs.sparkSession).alias("score")).select(
        "doc_id", (fold(F.col("doc_id"), PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
