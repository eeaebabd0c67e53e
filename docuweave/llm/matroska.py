"""Matroska: write payloads as laced audio blocks, and parse files into packet tables.

A file is a tree of EBML elements: an identifier and a size, both of variable length, then the
content.  The parser walks Segment, Info, Tracks, Clusters, SimpleBlocks, BlockGroups and Cues,
unpacks the three kinds of lacing (Xiph, fixed size, EBML) and gives one packet for each frame
with its track, its timestamp in nanoseconds and the byte range that it has in the file.

Defined results: null and empty media have no packets; an element that runs past the end of the
file is cut there and what it holds so far is parsed; unknown elements are skipped; elements of
unknown size end where their parent ends, and a cluster of unknown size also at the next
cluster or cues; a lacing whose sizes don't add up gives no packets for that block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

#: Fixed values of the Matroska format: element identifiers.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {CLUSTER, CUES, INFO, TRACKS}

UNIT = 576
RATE = 8000
#: Frames in a laced block, blocks in a cluster.
LACE = 8
BLOCKS = 16


# ------------------------------------------------------------------------------------ writing


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A number of variable length: as many leading zero bits as there are further bytes."""
    width = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, content: bytes) -> bytes:
    return _id(ident) + vint(len(content)) + content


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    import struct

    return element(ident, struct.pack(">d", x))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The sizes and frames of a block's body: ``none``, ``xiph``, ``fixed`` or ``ebml``."""
    if kind == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == "ebml" and len(frames) > 1:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            width = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_LACING = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}


def simple_block(track: int, relative: int, frames: list[bytes], kind: str) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | _LACING[kind]]) + lace(frames, kind))


def mux(payload: bytes, unit: int = UNIT, lace_frames: int = LACE, cluster_blocks: int = BLOCKS) -> bytes:
    """One track of 8-bit PCM: a frame for each ``unit`` bytes, laced blocks, clusters and cues."""
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    ms = unit * 1000 // RATE
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, float(len(frames) * ms)))
    audio = element(AUDIO, _float(SAMPLING_FREQUENCY, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = info + track, b""
    per = lace_frames * cluster_blocks
    for c in range(0, len(frames), per):
        at, blocks = c * ms, []
        for b in range(c, min(c + per, len(frames)), lace_frames):
            some = frames[b : b + lace_frames]
            kind = "none" if len(some) == 1 else ("fixed", "xiph", "ebml")[(b // lace_frames) % 3]
            if kind == "fixed" and len({len(f) for f in some}) > 1:
                kind = "ebml"
            blocks.append(simple_block(1, (b - c) * ms, some, kind))
        cues += element(CUE_POINT, _uint(CUE_TIME, at) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, len(body))))
        body += element(CLUSTER, _uint(TIMESTAMP, at) + b"".join(blocks))
    return head + element(SEGMENT, body + element(CUES, cues))


# ------------------------------------------------------------------------------------ parsing


def _read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        return 0, end
    n = 9 - data[at].bit_length()
    return (int.from_bytes(data[at : at + n], "big"), at + n) if n <= 4 and at + n <= end else (0, end)


def read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """The number at a place, None where all its bits are set (unknown), and the place after it."""
    if at >= end or not data[at]:
        return None, end
    n = 9 - data[at].bit_length()
    if at + n > end:
        return None, end
    x = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if x == (1 << 7 * n) - 1 else x), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, start and end of the content) of the elements in a range, one level deep."""
    while at < end:
        ident, at = _read_id(data, at, end)
        if not ident or at >= end and ident in _MASTERS:
            return
        size, at = read_vint(data, at, end)
        stop = end if size is None else min(end, at + size)
        if size is None and ident == CLUSTER:
            inner = at
            while inner < end:
                k, b = _read_id(data, inner, end)
                if k in _TOP or not k:
                    break
                n, b = read_vint(data, b, end)
                inner = end if n is None else min(end, b + n)
            stop = inner
        yield ident, at, stop
        at = stop


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges) of a Block or SimpleBlock."""
    track, at = read_vint(data, at, end)
    if track is None or at + 3 > end:
        return 0, 0, 0, []
    relative, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    kind = flags & 6
    if not kind:
        return track, relative, flags, [(at, end)]
    if at >= end:
        return track, relative, flags, []
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 4:
        sizes = [(end - at) // n] * (n - 1)
        if (end - at) % n:
            return track, relative, flags, []
    elif kind == 2:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                return track, relative, flags, []
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            before = at
            x, at = read_vint(data, at, end)
            if x is None and at >= end:
                return track, relative, flags, []
            x = (1 << 7 * (at - before)) - 1 if x is None else x
            sizes.append(x if not k else sizes[-1] + x - ((1 << 7 * (at - before) - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        return track, relative, flags, []
    ranges = []
    for size in [*sizes, last]:
        ranges.append((at, at + size))
        at += size
    return track, relative, flags, ranges


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def parse(data: bytes) -> dict:
    """Packets, tracks and cues of a file; see the module's text for damaged ones."""
    packets, tracks, cues, clusters = [], {}, [], []
    for ident, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        scale = 1_000_000
        for top, c, d in elements(data, a, b):
            if top == INFO:
                scale = next((_number(data, x, y) for k, x, y in elements(data, c, d) if k == TIMESTAMP_SCALE), scale)
            elif top == TRACKS:
                for k, x, y in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        e = {i: (p, q) for i, p, q in elements(data, x, y)}
                        number = _number(data, *e.get(TRACK_NUMBER, (0, 0)))
                        tracks[number] = {"codec": data[slice(*e.get(CODEC_ID, (0, 0)))].decode("ascii", "replace"), "duration": _number(data, *e.get(DEFAULT_DURATION, (0, 0)))}
            elif top == CLUSTER:
                clusters.append(c)
                base = 0
                for k, x, y in elements(data, c, d):
                    if k == TIMESTAMP:
                        base = _number(data, x, y)
                        continue
                    if k == BLOCK_GROUP:
                        found = [(p, q) for i, p, q in elements(data, x, y) if i == BLOCK]
                    else:
                        found = [(x, y)] if k == SIMPLE_BLOCK else []
                    for p, q in found:
                        track, relative, flags, ranges = frames_of(data, p, q)
                        step = tracks.get(track, {}).get("duration", 0)
                        for j, (u, v) in enumerate(ranges):
                            packets.append((len(packets), track, (base + relative) * scale + j * step, u, v - u, bool(flags & 0x80), ("none", "xiph", "fixed", "ebml")[(flags & 6) >> 1]))
            elif top == CUES:
                for k, x, y in elements(data, c, d):
                    if k == CUE_POINT:
                        time, positions = 0, []
                        for i, p, q in elements(data, x, y):
                            if i == CUE_TIME:
                                time = _number(data, p, q) * scale
                            elif i == CUE_TRACK_POSITIONS:
                                e = {i2: (p2, q2) for i2, p2, q2 in elements(data, p, q)}
                                positions.append((_number(data, *e.get(CUE_TRACK, (0, 0))), a + _number(data, *e.get(CUE_CLUSTER_POSITION, (0, 0)))))
                        cues.extend((time, t, at) for t, at in positions)
    return {"packets": packets, "tracks": tracks, "cues": cues, "clusters": len(clusters)}


# ---------------------------------------------------------------------------------- operators

PACKETS = T.ArrayType(
    T.StructType(
        [
            T.StructField("packet", T.LongType()),
            T.StructField("track", T.LongType()),
            T.StructField("timestamp_ns", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("bytes", T.LongType()),
            T.StructField("key", T.BooleanType()),
            T.StructField("lacing", T.StringType()),
        ]
    )
)


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw)), len(raw)


def media_column(text: Column) -> Column:
    """Matroska files that hold the texts' UTF-8, padded by bytes 255 to whole units."""

    @F.pandas_udf("binary")
    def media(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([mux(payload_of(t)[0]) for t in part], dtype=object)

    return media(text)


def packet_table(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """One row for each packet of the files in a binary column, with the columns ``keep`` of its row."""

    @F.pandas_udf(PACKETS)
    def packets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[dict(zip(("packet", "track", "timestamp_ns", "start", "bytes", "key", "lacing"), x, strict=True)) for x in parse(bytes(d or b""))["packets"]] for d in part])

    kept = [F.col(c) for c in keep]
    return df.select(*kept, F.explode(packets(F.col(media))).alias("_p")).select(*kept, "_p.*")


DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """Store a text's payload as Matroska, parse the stored bytes, and describe what came back."""
    payload, n = payload_of(text)
    stored = mux(payload)
    found = parse(stored)
    back = b"".join(stored[s : s + k] for _, _, _, s, k, _, _ in found["packets"])
    if back != payload:
        raise ValueError("a payload did not come back from its Matroska file")
    packets = found["packets"]
    kinds = {k: sum(p[6] == k for p in packets) for k in ("none", "xiph", "fixed", "ebml")}
    energy = int(np.frombuffer(back, np.uint8).sum(dtype=np.uint64)) / len(back)
    feature = f"tracks={len(found['tracks'])};clusters={found['clusters']};cues={len(found['cues'])};packets={len(packets)};last_ns={packets[-1][2]};" + ";".join(f"{k}={v}" for k, v in kinds.items()) + f";mean={energy:.3f}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text): see ``digest``.  Null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = [digest(t.as_py()) for t in texts]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(DIGEST)[1:], strict=True))], schema=DIGEST)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST_DDL)
