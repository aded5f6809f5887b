"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent 1- to 3-grams of letters (words padded by a blank), most frequent
first. A text goes to the language whose profile has the least out-of-place distance to its own: the sum over the
text's n-grams of how far their ranks lie apart, and the profile's length for one that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.common import fold, forget, written

PROFILE = 300
#: About so many rows of each language are learned from, at most.
TRAIN_ROWS = 1000
#: The table of languages is broadcast up to so many rows; with more (a dirty column) it is joined by a shuffle.
MANY_LANGS = 10_000
#: Fold (crc32 of the id modulo 4) that is never learned from.
PARTS, HELD = 4, 2

_LETTER: np.ndarray | None = None


def _letters(text: str) -> np.ndarray:
    """Codes of the lowered text: code point + 2 for letters, one 1 for each run of others, 1 at both ends."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    ok = _LETTER[cp]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of each run of others stays, as a blank
    codes = np.where(ok, cp + 2, 1)[keep]
    return np.concatenate(([1], codes, [1] if len(codes) and codes[-1] != 1 else np.zeros(0, np.int64)))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of all 1- to 3-grams that hold a letter, codes ascending; empty if the text has no letter."""
    c = _letters(text)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 1]  # a blank in the middle joins two words
    return np.unique(np.concatenate((c[c != 1], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The `size` most frequent codes, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.sorted, self.ranks = [], []
        for lang in self.langs:
            codes = np.array(by_lang[lang], np.int64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). The score is 1 - best / second best distance, moved to 1/2..1 (1 when there is one
        language); `und` with score 0 for null, for no letter, and where nothing was learned. Ties: by name."""
        codes = ranked(*ngram_counts(text)) if text else ()
        if not len(codes) or not self.langs:
            return "und", 0.0
        mine, far = np.arange(len(codes)), []
        for known, rank in zip(self.sorted, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            far.append(int(np.where(known[at] == codes, np.abs(rank[at] - mine), PROFILE).sum()))
        order = np.argsort(far, kind="stable")
        best = far[order[0]]
        second = far[order[1]] if len(far) > 1 else PROFILE * len(codes)
        return self.langs[order[0]], float(1 - 0.5 * best / second) if second else 0.5


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Profiles:
    """Learn a profile for each non-null lang of docs(doc_id, text, lang) outside the held-out fold, from a sample
    by a hash of doc_id of about `rows` texts a language. The driver gets the languages and their profiles."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), PARTS) != HELD)).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang")
    )
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    share = written(share, "languages")  # a row for each language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    few = share.limit(MANY_LANGS + 1).count() <= MANY_LANGS
    sample = usable.join(F.broadcast(share) if few else share, "lang").where(place < F.col("share"))

    def run(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                got = [ngram_counts(t) for t in texts]
                codes, inv = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                n = np.bincount(inv, np.concatenate([n for _, n in got]), len(codes)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counts = sample.select("lang", "text").mapInPandas(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place_of = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # an alphabet's n-grams
    top = counts.withColumn("rank", place_of).where(F.col("rank") <= PROFILE).collect()
    forget(share)
    by_lang: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        by_lang.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_lang)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text); repeated rows are judged each."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([shared.value.predict(t if isinstance(t, str) else None) for t in s], columns=["lang_pred", "score"])

    return docs.select("doc_id", predict(F.col("text")).alias("p")).select(
        "doc_id", (fold(F.col("doc_id"), PARTS) == HELD).alias("held_out"), "p.lang_pred", "p.score"
    )
