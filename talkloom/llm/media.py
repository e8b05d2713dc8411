"""MPEG audio columns: byte payloads stored losslessly in MPEG-1 Layer III streams, and a reader of MPEG audio.

The writer makes a valid variable-bitrate stream: an ID3v2 tag with the payload's length, a frame with a
Xing table (frames, bytes, 100 seek points), then silent frames, each with a CRC and all side information
zero, whose ancillary bytes are the payload; an ID3v1 tag ends it.

The reader skips tags, resynchronises on frame headers (a header counts if the next one, the end or a tag
follows where its length says, or if it directly follows a frame of its kind), reads Xing/Info and VBRI tables with their seek points,
verifies the CRC of frames that have one (all layers), and returns exact durations (samples over rate) and the byte offset of every frame for seeking.

Defined results: a null payload is stored as an empty one; junk without any frame has 0 frames and duration
0; a damaged frame counts as a bad CRC and keeps its place; equal payloads give equal streams; an empty
table gives an empty table; clashing columns are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES, add_column, small_batches

# Fixed values of the format (ISO 11172-3, 13818-3).
KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

#: Bits of each band's allocation in Layer II, by table: two tables of 27 and 30 bands, two of 8 and 12, and that of the lower rates.
LAYER2_ALLOCATION = [
    [4] * 11 + [3] * 12 + [2] * 4,
    [4] * 11 + [3] * 12 + [2] * 7,
    [4] * 2 + [3] * 6,
    [4] * 2 + [3] * 10,
    [4] * 4 + [3] * 7 + [2] * 19,
]

RATE = 44100
SIDE = 32
LENGTH_TAG = b"payload-length\0"


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int  # bytes of the whole frame
    samples: int
    side: int  # bytes of side information (Layer III)


@lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """The frame header in these four bytes, None if they are none (free format counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, pad = KBPS[1 if version == 3 else 2, layer][bitrate], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    channels = 1 if four[3] >> 6 == 3 else 2
    side = (32 if channels == 2 else 17) if version == 3 else (17 if channels == 2 else 9)
    return Header(version, layer, not four[1] & 1, kbps, hz, channels, size, samples, side if layer == 3 else 0)


CRC_TABLE = []
for _n in range(256):
    _c = _n << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    CRC_TABLE.append(_c)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ CRC_TABLE[c >> 8 ^ b]
    return c


def head(bitrate: int, pad: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, bitrate << 4 | pad << 1, 0x00])


@lru_cache(maxsize=64)
def opening(bitrate: int) -> tuple[bytes, int]:
    """(header, CRC and silent side information of a frame, bytes it can carry)."""
    h = head(bitrate, 0, True)
    side = bytes(SIDE)
    return h + struct.pack(">H", crc16(h[2:] + side)) + side, parse_header(h).size - 6 - SIDE


def syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def write_mpeg(payload: bytes) -> bytes:
    """A stream that carries the payload."""
    full, room = opening(14)
    frames = [full + payload[k:k + room] for k in range(0, len(payload) // room * room, room)]
    if rest := payload[len(payload) // room * room:]:
        front, most = next(x for x in map(opening, range(1, 15)) if x[1] >= len(rest))
        frames.append(front + rest + bytes(most - len(rest)))
    sizes = [len(f) for f in frames]
    table = head(9, 0, False)
    size = parse_header(table).size
    total, ends, at = size + sum(sizes), [], size
    for s in sizes:
        ends.append(at)
        at += s
    toc = bytes(min(255, (ends[min(len(ends) - 1, k * len(ends) // 100)] if ends else 0) * 256 // total) for k in range(100))
    xing = (table + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), total & 0xFFFFFFFF) + toc + struct.pack(">I", 0)).ljust(size, b"\0")
    tag = b"PRIV" + syncsafe(len(LENGTH_TAG) + 8) + b"\0\0" + LENGTH_TAG + struct.pack(">Q", len(payload))
    ms = str(len(frames) * 1152 * 1000 // RATE).encode()
    tag += b"TLEN" + syncsafe(len(ms) + 1) + b"\0\0\x03" + ms
    return b"".join([b"ID3\x04\0\0" + syncsafe(len(tag)) + tag, xing, *frames, b"TAG".ljust(127, b"\0") + b"\xff"])


@dataclass
class Audio:
    """What the reader finds."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    channels: int = 0
    kbps_min: int = 0
    kbps_max: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    points: list[int] = field(default_factory=list)
    seek: list[int] = field(default_factory=list)
    tags: dict[str, bytes] = field(default_factory=dict)
    payload: bytes = b""

    def seconds(self) -> tuple[int, int]:
        """The exact duration as a reduced fraction."""
        d = gcd(self.samples, self.rate) or 1
        return self.samples // d, max(1, self.rate // d)


def read_tag(data: bytes, at: int) -> tuple[int, dict[str, bytes]]:
    """(end, frames) of the ID3v2 tag at this place; end == at if there is none."""
    if data[at:at + 3] != b"ID3" or len(data) < at + 10 or any(b & 128 for b in data[at + 6:at + 10]):
        return at, {}
    number = lambda b, safe: b[0] << (21 if safe else 24) | b[1] << (14 if safe else 16) | b[2] << (7 if safe else 8) | b[3]
    end = at + 10 + number(data[at + 6:at + 10], True)
    k, found, safe = at + 10, {}, data[at + 3] >= 4
    while k + 10 <= min(end, len(data)) and data[k]:
        n = number(data[k + 4:k + 8], safe)
        found[data[k:k + 4].decode("latin-1")] = data[k + 10:min(k + 10 + n, end)]
        k += 10 + n
    return min(end + 10 * (data[at + 5] >> 4 & 1), len(data)), found


def read_table(data: bytes, at: int, h: Header) -> tuple[str, int, int, list[int]]:
    """(kind, frames, bytes, seek points as byte offsets from the frame) of a Xing, Info or VBRI table in this frame; 0 and none where it doesn't say."""
    number = lambda k, n=4: int.from_bytes(data[k:k + n], "big")
    if h.layer != 3:
        return "", 0, 0, []
    for k in (at + 4 + h.side, at + 6 + h.side):
        if data[k:k + 4] in (b"Xing", b"Info") and k + 8 <= len(data):
            flags, p, found = number(k + 4), k + 8, []
            for bit in (1, 2):
                found.append(number(p) if flags & bit else 0)
                p += 4 if flags & bit else 0
            points = [found[1] * b // 256 for b in data[p:p + 100]] if flags & 4 and p + 100 <= at + h.size else []
            return data[k:k + 4].decode(), *found, points
    k = at + 36
    if data[k:k + 4] == b"VBRI" and k + 26 <= len(data):
        entries, scale, width = number(k + 18, 2), number(k + 20, 2), number(k + 22, 2)
        points, place = [], h.size
        if 1 <= width <= 4 and k + 26 + entries * width <= at + h.size:
            for e in range(entries):  # each entry is the size of the frames up to the next point
                points.append(place)
                place += number(k + 26 + e * width, width) * scale
        return "VBRI", number(k + 14), number(k + 10), points
    return "", 0, 0, []


def layer12_bits(data: bytes, at: int, h: Header) -> int | None:
    """How many bits after the CRC it covers in Layers I and II: bit allocation, and in Layer II scale-factor selection; None for a reserved combination."""
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    bound = 4 * extension + 4 if mode == 1 else 32
    if h.layer == 1:
        return 4 * (min(bound, 32) * h.channels + max(0, 32 - bound)) if h.channels == 2 else 4 * 32
    lsf = h.version != 3
    each = h.kbps // h.channels
    table = 4 if lsf else 0 if (h.rate == 48000 and each >= 56) or 56 <= each <= 80 else 1 if h.rate != 48000 and each >= 96 else 2 if h.rate != 32000 and each <= 48 else 3
    bits, start = LAYER2_ALLOCATION[table], at + 6
    bound = min(bound, len(bits)) if mode == 1 else len(bits)
    place, used = 0, 0

    def read(n: int) -> int:
        nonlocal place
        whole = int.from_bytes(data[start + place // 8:start + (place + n + 7) // 8 + 1].ljust(3, b"\0")[:3], "big")
        place += n
        return whole >> (24 - n - (place - n) % 8) & (1 << n) - 1

    for band, n in enumerate(bits):
        for _ in range(h.channels if band < bound else 1):
            value = read(n)
            used += (value != 0) * (1 if band < bound else h.channels)
    return place + 2 * used


def covered(data: bytes, at: int, h: Header) -> int:
    """The CRC-16 over a frame's header and what else its layer protects."""
    if h.layer == 3:
        return crc16(data[at + 2:at + 4] + data[at + 6:at + 6 + h.side])
    n = layer12_bits(data, at, h)
    c = crc16(data[at + 2:at + 4] + data[at + 6:at + 6 + n // 8])
    for k in range(n % 8):
        bit = data[at + 6 + n // 8] >> 7 - k & 1 if at + 6 + n // 8 < len(data) else 0
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ bit else 0)
    return c


def read_mpeg(data: bytes) -> Audio:
    """Parses a stream; never fails on damaged ones."""
    a, at, n, first, parts = Audio(), 0, len(data), True, []
    lost, after = False, -1
    while at < n:
        if data[at:at + 3] == b"ID3":
            end, tags = read_tag(data, at)
            if end > at:
                a.tags |= tags
                at = end
                continue
        if data[at:at + 3] == b"TAG" and n - at == 128:
            break
        h = parse_header(data[at:at + 4])
        if h and at + h.size <= n:
            end = at + h.size
            sure = end == n or data[end:end + 3] in (b"ID3", b"TAG") or parse_header(data[end:end + 4]) is not None
            # in step, a header of the same kind needs no second one after it
            sure = sure or at == after and (h.version, h.layer, h.rate) == (a.version, a.layer, a.rate)
        else:
            sure = False
        if not sure:
            if not lost:
                a.resyncs += 1
                lost = True
            k = data.find(b"\xff", at + 1)
            k = n if k < 0 else k
            tag = data.find(b"ID3", at + 1, k)
            k = tag if tag >= 0 else k
            if n - 128 > at and data[n - 128:n - 125] == b"TAG":
                k = min(k, n - 128)
            a.skipped += k - at
            at = k
            continue
        lost = False
        if first:
            first = False
            a.version, a.layer, a.rate, a.channels = h.version, h.layer, h.rate, h.channels
            a.table, a.table_frames, a.table_bytes, points = read_table(data, at, h)
            a.points = [at + p for p in points]
            if a.table:
                at = after = end
                continue
        if h.protected:
            good = covered(data, at, h) == data[at + 4] << 8 | data[at + 5]
            a.crc_good, a.crc_bad = a.crc_good + good, a.crc_bad + (not good)
        a.frames += 1
        a.samples += h.samples
        a.kbps_min = min(a.kbps_min or h.kbps, h.kbps)
        a.kbps_max = max(a.kbps_max, h.kbps)
        a.seek.append(at)
        parts.append(data[at + 4 + 2 * h.protected + h.side:end])
        at = after = end
    length = a.tags.get("PRIV", b"")
    a.payload = b"".join(parts)
    if length.startswith(LENGTH_TAG):
        a.payload = a.payload[:int.from_bytes(length[len(LENGTH_TAG):len(LENGTH_TAG) + 8], "big")]
    return a


def feature(a: Audio) -> str:
    num, den = a.seconds()
    version = {3: "1", 2: "2", 0: "2.5"}[a.version] if a.rate else "-"
    return f"mpeg{version}-layer{a.layer} {a.rate}Hz {a.channels}ch frames={a.frames} seconds={num}/{den} kbps={a.kbps_min}-{a.kbps_max} crc={a.crc_good}/{a.crc_good + a.crc_bad} table={a.table or '-'}:{a.table_frames} resyncs={a.resyncs} last={a.seek[-1] if a.seek else -1}"


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to runs of about 4 MB of a binary column (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces the binary column ``payload`` by ``media``, the stream that carries it."""
    keep = [c for c in df.columns if c not in (payload, media)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(media, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, payload):
            yield add_column(batch.select(keep), media, streams(batch, payload))

    return small_batches(df).mapInArrow(run, schema)


def streams(batch: pa.RecordBatch, payload: str) -> pa.Array:
    return pa.array([write_mpeg(p or b"") for p in batch.column(payload).to_pylist()], pa.binary())


FOUND = [("frames", T.LongType()), ("duration_num", T.LongType()), ("duration_den", T.LongType()), ("seek", T.ArrayType(T.LongType(), False)), ("crc_good", T.LongType()), ("crc_bad", T.LongType()), ("resyncs", T.LongType()), ("feature", T.StringType()), ("payload", T.BinaryType())]
ARROW = {"seek": pa.list_(pa.int64()), "feature": pa.string(), "payload": pa.binary()}


def with_found(batch: pa.RecordBatch, media: str, out: pa.RecordBatch) -> pa.RecordBatch:
    found = [read_mpeg(m or b"") for m in batch.column(media).to_pylist()]
    rows = [(a.frames, *a.seconds(), a.seek, a.crc_good, a.crc_bad, a.resyncs, feature(a), a.payload) for a in found]
    for (name, _), values in zip(FOUND, zip(*rows)):
        out = add_column(out, name, pa.array(values, ARROW.get(name, pa.int64())))
    return out


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the reader finds: frames, duration (exact fraction), seek offsets, CRC counts, feature and the payload."""
    keep = [c for c in df.columns if c not in dict(FOUND)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(k, t, False) for k, t in FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, media):
            yield with_found(batch, media, batch.select(keep))

    return small_batches(df).mapInArrow(run, schema)


def store_and_read(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``read(store(df))`` in one pass: the streams as stored, and what the reader finds in them."""
    keep = [c for c in df.columns if c not in {payload, media, *dict(FOUND)}]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(media, T.BinaryType(), False)] + [T.StructField(k, t, False) for k, t in FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, payload):
            stored = add_column(batch.select(keep), media, streams(batch, payload))
            yield with_found(stored, media, stored)

    return small_batches(df).mapInArrow(run, schema)
