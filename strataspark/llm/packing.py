"""Best-fit decreasing packing of tokenised documents into fixed-size sequences.

The whole corpus is packed by one exact best-fit-decreasing run, yet the driver sees only the histogram of
piece lengths (at most `capacity` rows): bins with the same remaining room are interchangeable, so the run
moves groups of equal bins at a time. A segment tree over remaining capacities finds the tightest open group
in logarithmic time. The resulting plan (bounded by the capacity, not by the corpus) is joined back to pieces
that are ranked within (length, salt) blocks, so no length is gathered into one task.
"""

from __future__ import annotations

import re
import zlib
from itertools import filterfalse
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.common import memo, trim, written

#: ids: little-endian uint32 token ids.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

_RUN_END = re.compile(r"[.,](?<=[^\w\s].|_.)[ \n]")
#: Marks that may end a chunk; after a letter they are one run of their own to the tokenizer.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class ChunkEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The tokenizer never joins characters over a blank, so a text's ids are those of its blank-separated chunks in
    order; chunks are encoded once and remembered (`limit` of them at most, the earliest and so commonest stay).
    A chunk of letters that ends in a run of marks is the word's ids and that run's, for the tokenizer splits there; new words are encoded many in a call and parted at the tokens that end a word."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.known = Tokenizer.from_file(path), limit, {"": b""}
        ends = [i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[ends] = True

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Blank-separated chunks with the same ids as the text. Where lower case is beyond doubt and no comma or
        full stop ends a run of other marks, the text is lowered and those marks are parted from their words first,
        which makes many chunks alike."""
        low = text.lower()
        sure = text.isascii() or ("\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low))
        if sure and not _RUN_END.search(low):
            return low.replace("\n", " ").replace(", ", " , ").replace(". ", " . ").split(" ")
        return text.replace("\n", " ").split(" ")

    @staticmethod
    def plain(word: str) -> str | None:
        """The word as the tokenizer normalises it, if that is beyond doubt."""
        if not word.isalpha():
            return None
        low = word.lower()
        if word.isascii() or ("\u03a3" not in word and is_normalized("NFC", word) and is_normalized("NFC", low)):
            return low if low.isalpha() else None
        return None

    def learn(self, new: list[str]) -> None:
        known, words, parts, rest = self.known, [], [], []
        for c in new:
            if c.isalpha() and c.isascii() and c.islower():
                words.append(c)
                continue
            word = c.rstrip(_MARKS)
            end = c[len(word) :]
            base = self.plain(word)
            if base is None:
                rest.append(c)
            else:
                parts.append((c, base, end))
        there = known.__contains__  # a set minus all keys would walk the whole memory
        words += filterfalse(there, {w for _, w, _ in parts}.difference(words))
        rest += filterfalse(there, {end for *_, end in parts}.difference(rest))
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                rest += part
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            known.update(zip(part, [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)], strict=True))
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, dtype="<u4").tobytes()
        for c, base, end in parts:
            known[c] = known[base] + known[end] if end else known[base]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        get, out, open_, new = known.get, [], [], set()
        for k, t in enumerate(texts):
            chunks = self.chunks(t)
            ids = list(map(get, chunks))
            holes = [i for i, x in enumerate(ids) if x is None]
            out.append(b"" if holes else b"".join(ids))
            if holes:
                open_.append((k, ids, holes, chunks))
                new.update([chunks[i] for i in holes])
        if new:
            self.learn(list(new))
        for k, ids, holes, chunks in open_:
            for i in holes:
                ids[i] = known[chunks[i]]
            out[k] = b"".join(ids)
        trim(known, self.limit)
        return out


#: Chunks that a worker remembers; about 200 bytes each.
REMEMBER = 1_300_000


def encoder(path: str, remember: int = REMEMBER) -> ChunkEncoder:
    held = memo("packing")
    if path not in held:
        held[path] = ChunkEncoder(path, remember)
    return held[path]


def cut(ids: bytes, capacity: int, end_id: int) -> list[tuple[int, int, int, int, bytes]]:
    """(piece, start, length, crc32, ids) of a document: its ids, then end_id, cut every `capacity` ids."""
    ids += int(end_id).to_bytes(4, "little")
    step = 4 * capacity
    return [(k, k * capacity, len(p := ids[at : at + step]) // 4, zlib.crc32(p), p) for k, at in enumerate(range(0, len(ids), step))]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, remember: int = REMEMBER) -> DataFrame:
    """PIECES of every document of docs(doc_id, text). Null text counts as empty and gives one piece with the
    end id alone; a row with a null doc_id keeps it; repeated rows are packed each."""

    def run(batches):
        enc = encoder(tokenizer_path, remember)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                rows = [(d, *p) for d, ids in zip(part["doc_id"], enc.encode(texts), strict=True) for p in cut(ids, capacity, end_id)]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf is on while an open group has that much room."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.on = bytearray(2 * self.n)

    def put(self, room: int, value: bool) -> None:
        k = room + self.n
        self.on[k] = value
        while k > 1:
            k //= 2
            self.on[k] = self.on[2 * k] | self.on[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """The least room >= need that is on."""
        k = need + self.n
        if self.on[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.on[k + 1]:
                k += 1
                while k < self.n:
                    k = 2 * k if self.on[2 * k] else 2 * k + 1
                return k - self.n
            k //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}. Rows (length, lo, hi, first_bin, each, base): the pieces of that
    length with ranks lo <= r < hi go to bin first_bin + (r - lo) // each, at base + ((r - lo) % each) * length.

    A bin that takes one piece of a length and still has room for another is the tightest bin for it, so a bin
    takes as many as fit before the next one is touched; that is what one-by-one best fit does too."""
    tree, groups, plan, bins = CapacityTree(capacity), {}, [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            groups.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
                each = room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if rest:
                plan.append((length, rank, rank + rest, first + full, rest, capacity - room))
                add(room - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
            add(room, first + full + bool(rest), count - full - bool(rest))
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (PIECES; any columns besides doc_id, piece, length and ids_crc32 go along) with sequence_id and offset.
    Every piece is placed; lengths must be 1..capacity.
    Ties (equal lengths) are ranked by (doc_id, piece, ids_crc32); rows equal in all are interchangeable."""
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # n pieces of a length are ranked in about sqrt(n) blocks of sqrt(n), so that neither a block nor their list is long
    salts = F.ceil(F.sqrt("n_length")).cast("long")
    lengths = spark.createDataFrame(sorted(sizes.items()), "s_length long, n_length long")  # `capacity` rows at most
    plan = spark.createDataFrame(
        best_fit_plan(sizes, capacity), "p_length long, lo long, hi long, first_bin long, each long, base long"
    )
    salted = pieces.join(F.broadcast(lengths), F.col("length") == F.col("s_length"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts)).drop("s_length", "n_length")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("length").alias("b_length"),
            F.col("salt").alias("b_salt"),
            (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
        )
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        salted.withColumn("within", within)
        .join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    # the plan has some thousands of rows at most, whatever the corpus: see best_fit_plan
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    at = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(at / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, remember: int = REMEMBER) -> DataFrame:
    """Tokenise docs(doc_id, text) and pack all pieces, token ids with them; an empty table gives no rows. ids_crc32 is
    that of the ids as placed."""
    placed = pack(written(tokenised_pieces(docs, tokenizer_path, capacity, end_id, remember), "pieces"), capacity)
    return placed.withColumn("ids_crc32", F.crc32("ids"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of placed pieces (`pack_documents`): the token ids of each sequence, in order. A
    sequence's pieces hold `capacity` ids at most."""
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", "length", F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r["ids"])).alias("ids"))
