import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from strataspark.llm import media, packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 16, 50])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 90))]
    bins: dict[int, list] = {}
    for length, lo, hi, first, each, base in packing.best_fit_plan(dict(Counter(lengths)), capacity):
        for r in range(lo, hi):
            bins.setdefault(first + (r - lo) // each, []).append((base + (r - lo) % each * length, length))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == brute_best_fit(lengths, capacity)


def test_chunked_ids_equal_whole_ids():
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    alphabet = "abcDEF .,.,!?'’_\n\t12éÉßΣσςÀ̀İ  日本Ǆ-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["don't we'll I'm.", "a!, b?. c_. d", "Word. word, WORD", "<|endoftext|> a<|startoftext|>b", "", " ", "x y z", "Ώ. é, É"]
    got = packing.ChunkEncoder(PATH, 1000).encode(texts)
    tok = Tokenizer.from_file(PATH)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_odd_documents(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd_docs, PATH, 64, 0).collect()
    want = Counter()
    for d in odd_docs.collect():
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(d["doc_id"], k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in by.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == len(brute_best_fit([r["length"] for r in rows], 64))
    assert packing.pack_documents(no_docs, PATH, 64, 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4607, 4608, 60_000])
def test_media_round_trip(n):
    payload = media.pad(random.Random(n).randbytes(n))
    blob = media.mux(payload)
    (track,) = media.probe(blob)
    assert media.samples(blob, track) == payload
    assert (track.codec, track.width, track.height, track.timescale) == ("raw ", 24, 24, 25)
    assert track.duration == len(track.sizes) == len(payload) // 576
    assert track.keys.tolist() == list(range(track.duration))
    assert [media.pad(payload)[k : k + media.FRAME] for k in range(0, len(media.pad(payload)), media.FRAME)] == [blob[a:b] for a, b in media.key_ranges(track)]


def test_probe_of_foreign_layouts():
    payload = bytes(range(200))
    # sizes of their own, two chunks in reverse file order, 64-bit offsets, version 1 times, a box of 64-bit size
    import struct

    sizes, chunks = [50, 70, 80], [(120, 80), (0, 120)]
    free = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    def moov(base):
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
            media.full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)), media.full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 2, 1)),
            media.full(b"co64", struct.pack(">I2Q", 2, base + 120, base)))
        mdhd = media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 1000, 3000, 0), version=1)
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl))))
    head = len(free) + len(moov(0)) + 8
    blob = free + moov(head) + media.box(b"mdat", payload)
    (t,) = media.probe(blob)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 1000, 3000)
    assert t.starts.tolist() == [head + 120, head, head + 70] and t.sizes.tolist() == sizes and t.keys.tolist() == [0, 1, 2]
    assert media.probe(b"") == [] and media.probe(b"junk" * 9) == []
    media.probe(blob[: len(free) + 30])


def test_damaged_files_are_read_as_far_as_the_bytes_go():
    rnd = random.Random(5)
    for _ in range(1000):
        blob = bytearray(media.mux(media.pad(rnd.randbytes(rnd.choice([0, 10, 5000])))))
        for _ in range(rnd.randint(1, 6)):
            at = rnd.randrange(min(len(blob), 760))
            blob[at : at + rnd.choice([1, 4])] = rnd.choice([b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\0\0\0\0", b"\1", rnd.randbytes(1)])
        if rnd.random() < 0.3:
            del blob[rnd.randrange(len(blob)) :]
        for t in media.probe(bytes(blob)):
            got = media.samples(bytes(blob), t)
            assert len(got) == t.sizes.sum() <= len(blob)
            assert all(0 <= a <= b <= len(blob) for a, b in media.key_ranges(t)) and media.describe(t)


def test_media_columns(spark, odd_docs, no_docs):
    import hashlib

    rows = media.media_columns(odd_docs).collect()
    assert len(rows) == odd_docs.count() and media.media_columns(no_docs).count() == 0
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in odd_docs.collect()}
    for r in rows:
        p = media.pad(raw[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw[r["doc_id"]]), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
        blob = media.mux(p)
        assert r["codec"] == "raw" and r["seconds"] == len(p) / 576 / 25 and b"".join(blob[k["first"] : k["end"]] for k in r["keyframes"]) == p
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 2, None)}) == 1


def test_sharding_against_brute_force(spark, odd_docs, no_docs):
    import hashlib

    rows = [(k, f"text {k}" if k % 9 else None, None if k % 4 == 0 else "hot" if k % 3 else f"s{k % 5}") for k in range(997)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in sharding.shard(docs, 24).collect()}
    by: dict = {}
    for k, _, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    order = []
    for s, members in by.items():
        for rank, (_, k) in enumerate(sorted(members), 1):
            order.append(((2 * rank - 1) / (2 * len(members)), s is not None, s or "", rank, k))
    order = [k for *_, k in sorted(order)]
    for at, k in enumerate(order):
        shard = at * 24 // len(order)
        first = -(-shard * len(order) // 24)
        assert (got[k]["shard"], got[k]["slot"]) == (shard, at - first)
        text = rows[k][1] or ""
        assert (got[k]["size"], got[k]["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    mixed = Counter((got[k]["shard"], s) for k, _, s in rows)
    hot = [mixed[(j, "hot")] for j in range(24)]
    assert max(hot) - min(hot) <= 2
    assert sharding.shard(odd_docs, 24).count() == odd_docs.count() and sharding.shard(no_docs, 24).count() == 0


def test_sharding_with_many_buckets(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "'t' as text", "cast(id % 3 as string) as source")
    whole = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 7).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 7).collect()} == whole


def test_pack_ranks_over_many_blocks(spark):
    """Each length has 55 pieces, in eight blocks."""
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "id % 9 + 1 as length", "id as ids_crc32")
    rows = packing.pack(pieces, 10).collect()
    by: dict[int, int] = {}
    for r in rows:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert len(rows) == 500 and max(by.values()) <= 10
    assert sorted(10 - v for v in by.values()) == brute_best_fit([k % 9 + 1 for k in range(500)], 10)


def test_packed_sequences_hold_the_token_ids(spark, odd_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    placed = packing.pack_documents(odd_docs, PATH, 64, 0).cache()
    rows = placed.collect()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(placed).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    texts = {d["doc_id"]: d["text"] or "" for d in odd_docs.collect()}
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    for r in rows:
        want = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == want
