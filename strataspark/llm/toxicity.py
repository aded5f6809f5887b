"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word boundary marks) and of itself as a whole,
all hashed into one table; a window of WINDOW words is the mean of its words and of SMOOTH neutral ones; two classes
are scored by a linear softmax, and a text of any length by its worst window, in training as in use. Words that were
never seen share the n-gram vectors of those that were.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import fold, labelled_sample, memo, one_text_each, release, trim

BUCKETS, DIM = 1 << 17, 4
#: Neutral words that every text gets besides its own, so that a word weighs less in a text of a few words.
SMOOTH = 20
#: Words of a window; windows overlap by half.
WINDOW = 200
#: Rows learned from, at most, of each label.
TRAIN_ROWS = {0: 4000, 1: 2500}
#: Mini-batches of training, whatever the rows.
STEPS = 750
THRESHOLD = 0.5
#: Fold (crc32 of the id modulo 5) that is never learned from.
PARTS, HELD = 5, 0

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Hashed buckets of the word and of its 3- to 5-grams."""
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


class Model:
    """Subword table and softmax; word_margin(w) is the word's share in (toxic - clean) of a text's logits."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray, learned: bool = True):
        self.learned = learned
        self.margin = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def word_margin(self, word: str) -> float:
        return float(self.margin[subwords(word)].mean())


def bags(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, weight) of every window of a text's word ids, in the order of `window_starts`."""
    out = []
    for at in window_starts(len(ids)):
        own, n = np.unique(ids[at : at + WINDOW], return_counts=True)
        out.append((own, (n / (SMOOTH + n.sum())).astype(np.float32)))
    return out


def window_starts(n: int) -> range:
    """First words of the half-overlapping windows of a text of n words; a text of up to WINDOW words is one."""
    return range(0, max(1, n - WINDOW // 2), WINDOW // 2)


def _runs(lens: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these lengths begins."""
    return np.cumsum(lens) - lens


def _gather(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start[k] .. start[k] + lens[k] - 1 of all runs k, one after the other."""
    return np.repeat(start - _runs(lens), lens) + np.arange(lens.sum())


def train(texts: Iterable[list[str]], labels: list[int], steps: int = STEPS, rate: float = 0.12, decay: float = 1e-3, min_texts: int = 5, parts: int = 8, batch: int = 512, warm: int = 2, seed: int = 11) -> Model:
    """Joint training of table and softmax by Adam with weight decay on mini-batches of texts (lists of words).

    Each round takes one window of each text: a clean text's worst one under the model so far, for that is what it is
    scored by, and a random one of a toxic text (and of all texts in the first `warm` rounds), for nobody tells
    which of its windows are toxic. Every part of a clean text is clean, so small bags of its words
    (`parts` a text) are learned as clean too; that keeps unseen words, and texts that repeat one, from being judged by
    chance. Buckets that occur in fewer than min_texts texts do not move, lest rare words be learned by heart: a rare
    word learns, and is scored, by those of its n-grams that others share. Without texts of both classes the model is
    indifferent (`learned` is false)."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    names: dict[str, int] = {}
    bag_ids, bag_x, windows, lone = [], [], [], []
    for t in texts:  # one by one, so that only numbers are held of all texts
        ids = np.array([names.setdefault(w, len(names)) for w in t], np.int32)
        own = bags(ids)
        windows.append(len(own))
        bag_ids += [i for i, _ in own]
        bag_x += [x for _, x in own]
        lone.append(np.unique(ids))
    labels = np.array(labels, np.int64)  # read after the texts, for `fit` learns them together
    if len(set(labels.tolist())) < 2:
        return Model(table, out, bias, learned=False)
    buckets, sizes = array("i"), array("i")
    for w in names:  # one after the other, for as Python numbers they would fill the driver
        own = subwords(w)
        buckets.extend(own)
        sizes.append(len(own))
    del names
    n_sub = np.array(sizes, np.int64)
    flat = np.frombuffer(buckets, np.int32) if len(buckets) else np.zeros(0, np.int32)
    start = _runs(n_sub)
    in_texts = np.zeros(BUCKETS, np.int64)
    for own in lone:
        in_texts[np.unique(flat[_gather(start[own], n_sub[own])])] += 1
    moving = in_texts >= min(min_texts, in_texts.max(initial=1))
    table[moving] = rng.normal(0, 0.01, (int(moving.sum()), DIM))
    for own, y in zip(lone, labels.tolist(), strict=True):
        if y == 0 and len(own):
            for n in rng.integers(1, 5, parts):
                part = np.unique(own[rng.integers(0, len(own), n)])
                bag_ids.append(part)
                bag_x.append(np.full(len(part), 1 / (SMOOTH / 4 + len(part)), np.float32))
    # a word moves by its moving buckets only; its vector is still the mean over all of them
    moves = moving[flat]
    kept = np.add.reduceat(moves, start) if len(start) else n_sub
    flat, m_start = flat[moves], _runs(kept)
    bag_len = np.array([len(i) for i in bag_ids], np.int64)
    all_ids, all_x, bag_at = np.concatenate(bag_ids), np.concatenate(bag_x), _runs(bag_len)
    del bag_ids, bag_x, lone
    windows = np.array(windows, np.int64)
    first, n_windows = _runs(windows), int(windows.sum())
    small = np.arange(n_windows, len(bag_len))
    y_all = np.concatenate([np.repeat(labels, windows), np.zeros(len(small), np.int64)])
    text_of = np.repeat(np.arange(len(labels)), windows)

    def sums(values: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sums of runs of rows, none for runs of no row."""
        got = np.zeros((len(lens), *values.shape[1:]), np.float64)
        some = lens > 0
        if some.any():
            got[some] = np.add.reduceat(values, at[some], axis=0)
        return got

    def worst() -> np.ndarray:
        """The window of each text with the greatest margin."""
        margin = sums((table @ (out[:, 1] - out[:, 0]))[flat], m_start, kept) / np.maximum(n_sub, 1)
        size = int(bag_len[:n_windows].sum())
        logit = sums(margin[all_ids[:size]] * all_x[:size], bag_at[:n_windows], bag_len[:n_windows])
        order = np.lexsort((-logit, text_of))
        return order[first]

    m_t, v_t = np.zeros_like(table), np.zeros(BUCKETS, np.float32)  # what Adam keeps of each parameter
    mo, vo, mb, vb = np.zeros_like(out), np.zeros_like(out), np.zeros_like(bias), np.zeros_like(bias)
    met, place = np.zeros(len(n_sub), bool), np.zeros(len(n_sub), np.int64)
    step, turn = 0, -1
    while step < steps:
        turn += 1
        chosen = first + rng.integers(0, windows)
        if turn >= warm:
            chosen = np.where(labels == 0, worst(), chosen)
        some = np.concatenate([chosen, small])
        order = rng.permutation(some[bag_len[some] > 0])
        if not len(order):
            break
        for at in range(0, len(order), batch):
            ks = order[at : at + batch]
            step += 1
            lens = bag_len[ks]
            pos = _gather(bag_at[ks], lens)
            x = all_x[pos]
            own = all_ids[pos]
            met[own] = True
            uniq = np.flatnonzero(met)
            met[uniq] = False
            place[uniq] = np.arange(len(uniq))
            inv = place[own]
            cnt = kept[uniq]
            g_ids = flat[_gather(m_start[uniq], cnt)]
            wv = sums(table[g_ids], _runs(cnt), cnt) / n_sub[uniq][:, None]
            h = np.add.reduceat(wv[inv] * x[:, None], _runs(lens), axis=0)
            logit = h @ out + bias
            g = np.exp(logit - logit.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(ks)), y_all[ks]] -= 1
            g /= len(ks)
            g_out, g_bias, g_h = h.T @ g, g.sum(0), g @ out.T
            per_bag = np.repeat(g_h, lens, axis=0) * x[:, None]
            g_w = np.stack([np.bincount(inv, per_bag[:, d], len(uniq)) for d in range(DIM)], 1) / n_sub[uniq][:, None]
            touched = np.flatnonzero(np.bincount(g_ids, minlength=BUCKETS))
            spread = np.repeat(g_w, cnt, axis=0)
            g_t = np.stack([np.bincount(g_ids, spread[:, d], BUCKETS)[touched] for d in range(DIM)], 1)
            now = rate * max(0.05, 1 - step / steps)  # smaller steps towards the end, so that the result is settled
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            m_t[touched] = 0.9 * m_t[touched] + 0.1 * g_t
            v_t[touched] = 0.999 * v_t[touched] + 0.001 * (g_t * g_t).mean(1)
            table[touched] -= now * decay * table[touched] + now * (m_t[touched] / c1) / (np.sqrt(v_t[touched] / c2)[:, None] + 1e-7)
            for par, grad, m, v in ((out, g_out, mo, vo), (bias, g_bias, mb, vb)):
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.999 * v + 0.001 * grad * grad
                par -= now * (m / c1) / (np.sqrt(v / c2) + 1e-8)
    return Model(table, out, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: dict[int, int] = TRAIN_ROWS) -> Model:
    """Train on a bounded sample of labelled docs(doc_id, text) outside the held-out fold, one text for each id (the
    least of several); texts come to the driver one by one and stay there as numbers."""
    sample = labelled_sample(labels, label, PARTS, HELD, rows)
    picked = one_text_each(docs, sample)
    got: list[int] = []

    def texts():
        for r in picked.coalesce(1).sortWithinPartitions("doc_id").toLocalIterator():
            got.append(r["label"])
            yield words_of(r["text"])

    model = train(texts(), got)
    release()
    return model


_LIMIT = 400_000


def score_text(text: str, model: Model) -> float:
    known = memo("toxicity")
    if known.get("") is not model:  # no word is empty, so that place tells whose margins these are
        known.clear()
        known[""] = model
    trim(known, _LIMIT)
    words, get, margins = words_of(text), known.get, []
    for w in words:
        m = get(w)
        if m is None:
            m = known[w] = model.word_margin(w)
        margins.append(m)
    n = len(words)
    if n <= WINDOW:  # its one window
        logit = sum(margins) / (SMOOTH + n)
    else:
        run = np.concatenate(([0.0], np.cumsum(margins, dtype=np.float64)))
        start = np.array(window_starts(n))
        end = np.minimum(start + WINDOW, n)
        logit = ((run[end] - run[start]) / (SMOOTH + end - start)).max()
    return float(1 / (1 + np.exp(-np.clip(logit + model.bias, -30, 30))))


def toxicity_score(text: Column, model: Model, spark) -> Column:
    """Score column in 0..1; null counts as empty text, whose score is the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([score_text(t if isinstance(t, str) else "", shared.value) for t in s], dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text); repeated rows are scored each."""
    return docs.select("doc_id", toxicity_score(F.col("text"), model, docs.sparkSession).alias("score")).select(
        "doc_id", (fold(F.col("doc_id"), PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
