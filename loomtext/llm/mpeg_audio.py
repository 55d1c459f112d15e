"""MPEG audio columns: a frame parser, and a container that holds any bytes in the main data of Layer III frames.

`parse` finds frames by their headers, those of free bitrate by the distance to the next one, resynchronises after
foreign bytes, reads ID3v2 (2.2 to 2.4, with extended headers and unsynchronisation) and ID3v1 tags and the tables of
variable bitrate (Xing, Info, VBRI), verifies the CRC-16 of protected frames of all layers, and gives exact durations
(each frame's samples over its own sampling rate, summed as fractions) and the offset of every frame for seeking. `encode` writes a variable-bitrate
file: an ID3v2 tag with the payload's length, a Xing frame with frame count, byte count and seek table, and
protected frames of 320 kbit/s with the payload behind zero side information, the last of the smallest bitrate that
holds the rest.

Defined results: null counts as empty; the payload of a text is its UTF-8 with zero bytes up to a positive multiple
of 64, so an empty text has 64 bytes; equal texts give equal values; a frame that the input cuts off, and bytes that
are no frame, count as skipped and never raise; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import column_bytes, freeing, text_chunks
from loomtext.session import stored

# Fixed values of the format: kbit/s by (MPEG-1 or not, layer), sampling rates by version, samples by layer.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
POLYNOMIAL = 0x8005
# Layer II: bits of the allocation of each subband, as (bits, subbands), by table.
ALLOCATION = {"a": [(4, 11), (3, 12), (2, 4)], "b": [(4, 11), (3, 12), (2, 7)], "c": [(4, 2), (3, 6)], "d": [(4, 2), (3, 10)], "lsf": [(4, 4), (3, 7), (2, 19)]}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int  # with the pad slot; 0 where the bitrate is free
    samples: int
    pad: int = 0

    def alike(self, other: Header | None) -> bool:
        """Whether two frames can follow one another in a stream."""
        return other is not None and (self.version, self.layer, self.rate, not self.kbps) == (other.version, other.layer, other.rate, not other.kbps)

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """What a frame header says; None if it is not one. Frames of free bitrate have size 0."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, pad = BITRATES[1 if version == 3 else 2, layer][bits], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    slot = 4 if layer == 1 else 1
    size = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, size if kbps else 0, samples, pad * slot)


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ POLYNOMIAL if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


@lru_cache(65_536)
def crc16(data: bytes) -> int:
    """As frames have it: from 0xFFFF, most significant bit first."""
    table, c = _crc_table(), 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    return c


def crc16_bits(c: int, data: bytes, bits: int) -> int:
    """A CRC-16 that goes on over the first bits of data."""
    for i in range(bits):
        top = c >> 15 ^ data[i >> 3] >> 7 - (i & 7) & 1
        c = (c << 1 & 0xFFFF) ^ (POLYNOMIAL if top else 0)
    return c


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in Layer II, by version, rate and bitrate of a channel."""
    each = h.kbps if h.mono else h.kbps // 2
    if h.version != 3:
        name = "lsf"
    elif h.kbps and each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or h.kbps and each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[name] for _ in range(n)]


def _layer2_bits(frame: bytes, h: Header) -> int:
    """Bits behind the CRC that it covers: the allocations, and two for each subband of a channel that has one."""
    word, at, used = int.from_bytes(frame[6:], "big"), 0, 0
    total, mode = 8 * (len(frame) - 6), frame[3] >> 6
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    channels = 1 if h.mono else 2
    for band, bits in enumerate(_allocation(h)):
        for _ in range(channels if band < bound else 1):
            at += bits
            if word >> max(0, total - at) & (1 << bits) - 1:
                used += 1 if band < bound else channels
    return at + 2 * used


def checked(frame: bytes, h: Header) -> bool | None:
    """Whether the CRC of a protected frame is right; None where the frame is too short to hold what it covers."""
    stated = frame[4] << 8 | frame[5]
    if h.layer == 3:
        return crc16(bytes(frame[2:4]) + bytes(frame[6 : 6 + h.side])) == stated if len(frame) >= 6 + h.side else None
    if h.layer == 2:
        bits = _layer2_bits(frame, h)
        return crc16_bits(crc16(bytes(frame[2:4])), frame[6:], bits) == stated if bits <= 8 * (len(frame) - 6) else None
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    bound = 4 * (extension + 1) if mode == 1 else 32
    values = 32 if mode == 3 else 2 * bound + (32 - bound)
    return crc16(bytes(frame[2:4]) + bytes(frame[6 : 6 + values // 2])) == stated if len(frame) >= 6 + values // 2 else None


def _free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a frame of free bitrate without its pad slot: the least distance at which a like frame follows, and another one behind it (or the end); 0 if there is none."""
    slot = 4 if h.layer == 1 else 1
    nxt = at + 24
    while 0 <= (nxt := data.find(b"\xff", nxt, min(end, at + MOST_FREE))):
        n = header(data[nxt : nxt + 4])
        size = nxt - at - h.pad
        if n is not None and h.alike(n) and size % slot == 0:
            third = nxt + size + n.pad
            if third == end or (m := header(data[third : third + 4])) is not None and h.alike(m):
                return size
        nxt += 1
    return 0


#: Bytes of a frame of free bitrate at most: a bitrate beyond the tables' largest, at the lowest rate of each layer.
MOST_FREE = 1 << 13


@dataclass
class Audio:
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    #: Samples and sampling rate of each frame.
    counts: list[int] = field(default_factory=list)
    rates: list[int] = field(default_factory=list)
    version: int = 0
    layer: int = 0
    kbps: set[int] = field(default_factory=set)
    checked: int = 0
    crc_errors: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)

    @property
    def samples(self) -> int:
        return sum(self.counts)

    @property
    def rate(self) -> int:
        """The sampling rate of all frames; 0 if they have several, or there are none."""
        return self.rates[0] if len(set(self.rates)) == 1 else 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return sum((Fraction(n, r) for r, n in self._by_rate().items()), Fraction(0))

    def _by_rate(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for n, r in zip(self.counts, self.rates, strict=True):
            out[r] = out.get(r, 0) + n
        return out

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample."""
        ends = list(accumulate(self.counts))
        return self.offsets[min(len(self.offsets) - 1, bisect_right(ends, sample))]

    def seek_time(self, seconds: float | Fraction) -> int:
        """Offset of the frame that plays at a time."""
        ends = list(accumulate(Fraction(n, r) for n, r in zip(self.counts, self.rates, strict=True)))
        return self.offsets[min(len(self.offsets) - 1, bisect_right(ends, Fraction(seconds)))]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(code, "replace").replace("\x00", "\n").rstrip("\n")


def _id3v2(data: bytes, out: Audio) -> int:
    """Reads the tag at the start; returns its size, 0 if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4) or any(b & 0x80 for b in data[6:10]):
        return 0
    version, flags = data[3], data[5]
    end = min(len(data), 10 + _syncsafe(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header; its size counts itself in 2.4 alone
        at = _syncsafe(body[:4]) if version == 4 else 4 + struct.unpack(">I", body[:4])[0]
    letters, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at] != 0:
        name = body[at : at + letters].decode("latin-1")
        size = _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + letters : at + 2 * letters], "big")
        value = body[at + head : at + head + size]
        if version == 4 and body[at + 9] & 0x02:
            value = value.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[at + 9] & 0x01:  # a length stands before the value
            value = value[4:]
        if name[0] == "T":
            text = _text(value)
            key, _, text = text.partition("\n") if name in ("TXXX", "TXX") else (name, "", text)
            out.tags[key] = text
        at += head + size
    return min(len(data), end + 10) if version == 4 and flags & 0x10 else end


def _vbr(frame: bytes, h: Header, out: Audio) -> bool:
    """Whether a first frame holds a table in place of sound."""
    for at in (4 + h.side, 6 + h.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, at, v = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= at + 4:
                    v[name] = struct.unpack(">I", frame[at : at + 4])[0]
                    at += 4
            if flags & 4 and len(frame) >= at + 100:
                v["toc"] = list(frame[at : at + 100])
            out.vbr = v
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        table = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n + 1)] if width else []
        out.vbr = {"kind": "VBRI", "frames": frames, "bytes": size, "per": per, "table": table}
        return True
    return False


def parse(data: bytes) -> Audio:
    out = Audio()
    at, end = _id3v2(data, out), len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].rstrip(b"\x00 ").decode("latin-1"):
                out.tags.setdefault(f"id3v1.{name}", text)
    last: Header | None = None
    free = 0  # bytes of the stream's frames of free bitrate
    while at < end:
        h = header(data[at : at + 4])
        size = 0 if h is None else h.size
        if h is not None and not h.kbps:
            free = free if h.alike(last) and free else _free_size(data, at, end, h)
            size = free + h.pad if free else 0
        fits = size > 4 and at + size <= end
        if fits and (nxt := at + size) < end and not h.alike(header(data[nxt : nxt + 4])):
            # No frame follows. In step, this may be the last one before foreign bytes, if it is like those before it.
            fits = h.alike(last) and h.protected == last.protected and (not h.protected or checked(data[at:nxt], h) is not False)
        if not fits:
            if last is not None:
                out.resyncs += 1
                last = None
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        last = h
        frame = data[at : at + size]
        if h.protected and (right := checked(frame, h)) is not None:
            out.checked += 1
            out.crc_errors += not right
        if out.offsets or out.vbr or not (h.layer == 3 and _vbr(frame, h, out)):
            out.offsets.append(at)
            out.sizes.append(size)
            out.counts.append(h.samples)
            out.rates.append(h.rate)
            out.kbps.add(h.kbps)
            out.version, out.layer = h.version, h.layer
        at += size
    return out


SIDE, RATE_INDEX = 32, 2  # MPEG-1 Layer III, 32 kHz, two channels: 144 * kbit/s / 32 bytes a frame
LENGTHS = [144 * k // 32 for k in BITRATES[1, 3]]
DATA = 6 + SIDE


@lru_cache(32)
def _start(bits: int) -> bytes:
    """Header, CRC and zero side information of a frame."""
    head = bytes([0xFF, 0xFA, bits << 4 | RATE_INDEX << 2, 0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


def encode(payload: bytes) -> bytes:
    """An audio file whose frames hold payload."""
    room = LENGTHS[14] - DATA
    n = max(1, -(-len(payload) // room))
    rest = len(payload) - (n - 1) * room
    small = next(i for i in range(1, 15) if LENGTHS[i] - DATA >= rest)
    start = _start(14)
    frames = [start + payload[i * room : (i + 1) * room] for i in range(n - 1)]
    frames.append((_start(small) + payload[(n - 1) * room :]).ljust(LENGTHS[small], b"\x00"))
    body = b"".join(frames)
    table_bits = next(i for i in range(1, 15) if LENGTHS[i] >= 4 + SIDE + 116)
    total = LENGTHS[table_bits] + len(body)
    toc = bytes(min(255, 256 * (LENGTHS[table_bits] + LENGTHS[14] * (p * n // 100)) // total) for p in range(100))
    table = bytes([0xFF, 0xFB, table_bits << 4 | RATE_INDEX << 2, 0]) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, n, total) + toc
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + size + tag + table.ljust(LENGTHS[table_bits], b"\x00") + body


def payload(data: bytes, audio: Audio) -> bytes:
    """What `encode` stored."""
    out = b"".join([data[a + DATA : a + n] for a, n in zip(audio.offsets, audio.sizes, strict=True)])
    return out[: int(audio.tags["payload_bytes"])]


def feature(a: Audio) -> str:
    """All but the offsets themselves, as JSON: the duration in whole samples, and a checksum of the offsets."""
    seek = zlib.crc32(np.array(a.offsets, "<u8").tobytes())
    return json.dumps({"layer": a.layer, "rate": a.rate, "seconds": [a.duration.numerator, a.duration.denominator], "frames": len(a.offsets), "samples": a.samples, "kbps": sorted(a.kbps), "vbr": a.vbr.get("kind"), "vbr_frames": a.vbr.get("frames"), "crc_checked": a.checked, "crc_errors": a.crc_errors, "skipped": a.skipped, "resyncs": a.resyncs, "seek_crc32": seek}, separators=(",", ":"))


def encode_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            buf, offsets = column_bytes(t["text"])
            raw, ends = buf.tobytes(), offsets.tolist()
            media = [encode(raw[a:b].ljust(max(64, -(-(b - a) // 64) * 64), b"\x00")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield from pa.table({"doc_id": t["doc_id"], "n_bytes": np.diff(offsets), "media": pa.array(media, pa.binary())}).to_batches()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads media columns back: the payload's and the file's digests, duration and frame offsets."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "duration_s", "frame_offsets"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, n, m in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist(), strict=True):
                a = parse(m)
                p = payload(m, a)
                rows.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(a), a.samples, a.rate, float(a.duration), a.offsets))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate long, duration_s double, frame_offsets array<long>"
    return media.mapInArrow(freeing(run), ddl)


def stored_media(docs: DataFrame) -> DataFrame:
    """Writes each text as an audio file to a table in the shared folder, and reads the table back."""
    return features(stored(encode_texts(docs), "media"))
