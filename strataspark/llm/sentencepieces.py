"""SentencePiece encoding and decoding with a vocabulary file read here.

An Aho-Corasick automaton over the pieces yields, at every position of a text, all pieces that end there (its output
links); one pass relaxes the best path to that position. For a unigram model the best path has the highest sum of
scores. For a BPE model a piece may follow another only if merging their characters gives just these two pieces; of
all paths that obey this there is one, and it is what merging the whole text gives, so the pass stays exact.

No piece goes on from another character to the blank mark, so a text falls into segments that begin with blank marks,
and a segment's ids do not depend on its neighbours: each is solved once and remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import memo, trim

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4- or 8-byte strings of fixed fields, bytes of the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and settings of a .model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.model_type, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.model_type, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if charsmap:
            raise ValueError("only the identity normaliser is supported")
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unk = self.types.index(UNKNOWN)


class Codec:
    def __init__(self, path: str, limit: int = 400_000):
        with open(path, "rb") as f:
            self.v = v = Vocabulary(f.read())
        self.limit, self.known = limit, {}
        self.id_of = {p: i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t in (NORMAL, USER)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == BYTE}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            self.segments = None
        else:
            self.segments = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        # marks that no piece has after a letter or digit: a final one is encoded by itself
        after = {b for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        self.apart = {c for c in ",.!?;:|\n" if c not in after}
        self.singles = {p for p in self.id_of if len(p) == 1}
        self.worst = min(v.scores, default=0.0) - 10.0  # of a character without a piece
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.surface = [self._surface(i) for i in range(len(v.pieces))]

    def _surface(self, i: int) -> bytes:
        kind, piece = self.v.types[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(BLANK, " ").encode()

    def merges(self, text: str) -> list[str]:
        """What merging neighbours by the best score, leftmost first, makes of a short text."""
        s, score, id_of = list(text), self.v.scores, self.id_of
        while len(s) > 1:
            best, where = None, -1
            for k in range(len(s) - 1):
                i = id_of.get(s[k] + s[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], k
            if where < 0:
                break
            s[where : where + 2] = [s[where] + s[where + 1]]
        return s

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.pairs.get(key)
        if got is None:
            a, b = self.v.pieces[left], self.v.pieces[right]
            got = self.pairs[key] = self.merges(a + b) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return got

    def stands(self, i: int) -> bool:
        got = self.whole.get(i)
        if got is None:
            got = self.whole[i] = self.merges(self.v.pieces[i]) == [self.v.pieces[i]]
        return got

    def _merged(self, text: str) -> list[int]:
        """viterbi() for a BPE model and a segment each of whose characters is a piece, so that every place is reached:
        one piece may end there, the only one that stands behind the path so far, and the rest of the matches is skipped."""
        n, score, pairs, follows = len(text), self.v.scores, self.pairs, self.follows
        best: list[float | None] = [None] * (n + 1)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at, (size, i) in self.auto.iter(text):
            at += 1
            if best[at] is not None:
                continue
            start = at - size
            if start:
                left = last[start]
                ok = pairs.get(left << 32 | i)
                if ok is None:
                    ok = follows(left, i)
            else:
                ok = self.stands(i)
            if ok:
                best[at], last[at], back[at] = best[start] + score[i], i, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def viterbi(self, text: str) -> list[int]:
        """Ids of a segment (-1 - code point for a character without a piece), by one pass over the matches."""
        if self.v.model_type == BPE and self.singles.issuperset(text):
            return self._merged(text)
        n, score, bpe = len(text), self.v.scores, self.v.model_type == BPE
        best: list[float | None] = [None] * (n + 1)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        worst = self.worst
        at, matches = 0, self.auto.iter(text)
        nxt = next(matches, None)
        for at in range(1, n + 1):
            lone = True
            while nxt is not None and nxt[0] == at - 1:
                size, i = nxt[1]
                start = at - size
                lone = lone and size > 1
                if best[start] is not None:
                    value = best[start] + score[i]
                    if best[at] is None:  # in a BPE model one piece at most may end here, so the first to stand is best
                        if not bpe or (self.stands(i) if start == 0 else last[start] < 0 or self.follows(last[start], i)):
                            best[at], last[at], back[at] = value, i, start
                    elif not bpe and value > best[at]:
                        best[at], last[at], back[at] = value, i, start
                nxt = next(matches, None)
            if lone and best[at - 1] is not None:
                value = best[at - 1] + worst
                if best[at] is None or (not bpe and value > best[at]):
                    best[at], last[at], back[at] = value, -1 - ord(text[at - 1]), at - 1
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _bytes(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            full: list[int] = []
            for i in ids:
                if i >= 0:
                    full.append(i)
                elif self.v.byte_fallback:
                    full += [self.byte_id[b] for b in chr(-1 - i).encode()]
                elif not full or full[-1] != self.v.unk:
                    full.append(self.v.unk)
            ids = full
        return np.array(ids, "<u4").tobytes()

    def learn(self, segment: str) -> bytes:
        if len(segment) > 2 and segment[-1] in self.apart and segment[-2].isalnum():
            base = self.known.get(segment[:-1]) or self.learn(segment[:-1])
            got = base + (self.known.get(segment[-1]) or self.learn(segment[-1]))
        else:
            got = self._bytes(self.viterbi(segment))
        self.known[segment] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes."""
        if not text:
            return b""
        if self.v.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = (" " + text if self.v.dummy_prefix else text).replace(" ", BLANK)
        trim(self.known, self.limit)
        get = self.known.get
        return b"".join([get(s) or self.learn(s) for s in (self.segments(text) if self.segments else [text])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte pieces that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


def codec(path: str) -> Codec:
    held = memo("sentencepieces")
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary) of docs(doc_id, text): little-endian uint32 ids; null text counts as empty (no ids)."""

    @F.pandas_udf("binary")
    def enc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in texts:
            yield pd.Series([c.encode(t if isinstance(t, str) else "") for t in s], dtype=object)

    return docs.select("doc_id", enc(F.col("text").cast("string")).alias("ids"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids binary)."""

    @F.pandas_udf("string")
    def dec(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in ids:
            yield pd.Series([c.decode(bytes(b)) if b is not None else "" for b in s], dtype=object)

    return encoded.select("doc_id", dec("ids").alias("text"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, lossless): every text encoded, and its ids decoded again. A text that
    holds the blank mark itself comes back with a blank in its place and is not lossless."""

    def run(batches):
        c = codec(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text if isinstance(text, str) else ""
                ids = c.encode(text)
                back = c.decode(ids)
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "lossless"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean"
    )
