"""Documents stored in, and probed from, ISO base media files.

`mux` stores a payload as uncompressed 8-bit grey frames in an ISO base media container; `probe` walks the nested
boxes of any such file, decodes its sample tables and reports codec, duration, sample and keyframe byte ranges
without decoding a payload byte. Both work on one document at a time, so memory is bounded by the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import written

SIDE, FPS, PER_CHUNK = 24, 25, 8
FRAME = SIDE * SIDE
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<first: long, end: long>>"
)
NAMES = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature codec seconds keyframes".split()


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to the next positive multiple of a frame."""
    return payload + b"\xff" * (max(1, -(-len(payload) // FRAME)) * FRAME - len(payload))


def mux(payload: bytes) -> bytes:
    """payload (a positive multiple of FRAME bytes) as one grey video track, one frame per sample. All frames are raw,
    so each is a keyframe and there is no table of them."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(
        b"raw ",
        bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1),
    )
    stsc = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        stsc.append((chunks, n % PER_CHUNK, 1))
    wide = len(payload) > 0xF0000000

    def head(first: int) -> bytes:
        offsets = [first + k * PER_CHUNK * FRAME for k in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FPS, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FPS, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = len(head(0)) + (16 if len(payload) + 8 > 0xFFFFFFFF else 8)
    return head(start) + box(b"mdat", payload)


def walk(data: memoryview, at: int, end: int, path: tuple = ()):
    """(path, start of body, end) of every box from at to end, nested ones included. A box that claims more than
    its parent holds, or less than its header, ends the walk of that level."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield (*path, kind), body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))


def _table(data: memoryview, body: int, end: int, kind: str, per: int, head: int = 4) -> np.ndarray:
    """Rows of `per` numbers behind a count; of a count that claims more than the box holds, those that are there."""
    if body + head + 4 > end:
        return np.zeros((0, per), "i8")
    width = per * np.dtype(kind).itemsize
    n = min(struct.unpack_from(">I", data, body + head)[0], (end - body - head - 4) // width)
    return np.frombuffer(data, kind, n * per, body + head + 4).astype("i8").reshape(n, per)


def _sample_map(sizes: np.ndarray, chunks: np.ndarray, stsc: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the samples that the tables place, up to the first that does not lie within 0..end or makes
    them longer than the file. Runs of
    chunks that are not in rising order, or begin after the last chunk, end the map."""
    first, per = stsc[:, 0], stsc[:, 1]
    good = (first >= 1) & (first <= len(chunks)) & (np.diff(first, prepend=0) > 0) & (per >= 0)
    stop = len(good) if good.all() else int(np.argmin(good))
    first, per = first[:stop], per[:stop]
    if not stop or not len(sizes):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    per = np.minimum(per, len(sizes))  # no chunk holds more samples than there are
    per_chunk = np.repeat(per, np.diff(np.append(first, len(chunks) + 1)))
    before = np.minimum(np.cumsum(per_chunk), len(sizes))
    per_chunk = np.diff(before, prepend=0)
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk) + int(first[0]) - 1
    if not len(chunk_of):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    sizes = sizes[: len(chunk_of)]
    run = np.cumsum(sizes) - sizes
    head = np.concatenate(([0], before[:-1]))  # first sample of each chunk
    starts = chunks[chunk_of] + run - run[np.minimum(head, len(run) - 1)][chunk_of - (int(first[0]) - 1)]
    inside = (starts >= 0) & (starts <= end) & (sizes <= end - starts) & (np.cumsum(sizes) <= end)
    stop = len(inside) if inside.all() else int(np.argmin(inside))
    return starts[:stop], sizes[:stop]


def probe(media: bytes) -> list[Track]:
    """The tracks of an ISO base media file. Foreign bytes give none; of truncated or damaged tables what the bytes
    hold is read, and samples are given up to the first that lies outside the file. No claimed count or size is
    believed beyond the bytes that are there, so memory is bounded by a few times the file's length."""
    data, tracks, raw = memoryview(media), [], []
    for path, body, end in walk(data, 0, len(data)):
        kind, room = path[-1], end - body
        if kind == b"trak":
            tracks.append(Track())
            raw.append({})
        elif not tracks or b"trak" not in path:
            continue
        elif kind == b"mdhd" and room >= (36 if data[body : body + 1] == b"\1" else 24):
            v = data[body] == 1
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if v else ">II", data, body + (20 if v else 12))
        elif kind == b"hdlr" and room >= 12:
            tracks[-1].handler = bytes(data[body + 8 : body + 12]).decode("latin-1")
        elif kind == b"stsd" and room >= 16:
            tracks[-1].codec = bytes(data[body + 12 : body + 16]).decode("latin-1")
            if tracks[-1].handler == "vide" and room >= 44:
                tracks[-1].width, tracks[-1].height = struct.unpack_from(">HH", data, body + 40)
        elif kind == b"stsz" and room >= 12:
            same, n = struct.unpack_from(">II", data, body + 4)
            # samples of one size lie in the file: there are no more of them than bytes
            raw[-1]["sizes"] = np.full(min(n, len(data) // same), same, "i8") if same else _table(data, body, end, ">u4", 1, 8)[:, 0]
        elif kind == b"stsc":
            raw[-1]["stsc"] = _table(data, body, end, ">u4", 3)
        elif kind == b"stss":
            raw[-1]["keys"] = _table(data, body, end, ">u4", 1)[:, 0] - 1
        elif kind in (b"stco", b"co64"):
            raw[-1]["chunks"] = _table(data, body, end, ">u4" if kind == b"stco" else ">i8", 1)[:, 0]
    for t, r in zip(tracks, raw, strict=True):
        if {"sizes", "stsc", "chunks"} <= r.keys():
            t.starts, t.sizes = _sample_map(r["sizes"], r["chunks"], r["stsc"], len(data))
            keys = r.get("keys", np.arange(len(t.sizes)))  # without such a table every sample is a keyframe
            t.keys = keys[(keys >= 0) & (keys < len(t.sizes))]
    return tracks


def samples(media: bytes, track: Track) -> bytes:
    """The stored bytes of a track, in sample order."""
    data = memoryview(media)
    return b"".join([data[a : a + n] for a, n in zip(track.starts.tolist(), track.sizes.tolist(), strict=True)])


def key_ranges(track: Track) -> list[tuple[int, int]]:
    """(first byte, byte behind the last) of every keyframe, in the order of the table."""
    start = track.starts[track.keys]
    return list(zip(start.tolist(), (start + track.sizes[track.keys]).tolist(), strict=True))


def describe(track: Track) -> str:
    """A line of codec, size, duration and counts; the keyframe ranges are given as a digest of their list."""
    ranges = ",".join(f"{a}-{b}" for a, b in key_ranges(track))
    return (
        f"codec={track.codec.strip()};size={track.width}x{track.height};timescale={track.timescale};duration={track.duration};"
        f"samples={len(track.sizes)};keyframes={len(track.keys)};keyframe_ranges={hashlib.md5(ranges.encode()).hexdigest()}"
    )


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as MEDIA rows; null text is an empty payload (one frame of padding)."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                raw = [t.encode() if isinstance(t, str) else b"" for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in raw], "media": [mux(pad(x)) for x in raw]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of MEDIA rows, from the stored bytes: the first track's codec, duration in seconds and keyframe byte
    ranges, by which a frame can be read from the media column, and digests of what is stored. Bytes without a track
    give an empty payload, an empty feature and nulls."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, n, blob in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                blob = bytes(blob)
                tracks = probe(blob)
                t = tracks[0] if tracks else None
                payload = samples(blob, t) if t else b""
                stored = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest())
                seconds = t.duration / t.timescale if t and t.timescale else None
                said = (describe(t), t.codec.strip(), seconds, [{"first": a, "end": b} for a, b in key_ranges(t)]) if t else ("", None, None, None)
                rows.append((doc_id, n, *stored, *said))
            out = pd.DataFrame(rows, columns=NAMES)
            yield out.astype({"doc_id": "Int64"})

    return media.mapInPandas(run, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every document of docs(doc_id, text) as a media column of a table in the shared folder, read it back and
    probe it. Null text is an empty payload; repeated rows are stored each; a missing column is an analysis error."""
    return media_features(written(to_media(docs), "media"))
