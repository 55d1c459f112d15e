"""Frames, tags and checksums of MPEG audio."""

import hashlib
import json
import os
import struct
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import mpeg_audio as ma


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_round_trip_of_any_bytes(data):
    m = ma.encode(data)
    a = ma.parse(m)
    assert ma.payload(m, a) == data
    assert (a.crc_errors, a.skipped, a.resyncs, a.checked) == (0, 0, 0, len(a.offsets))
    assert a.vbr["frames"] == len(a.offsets) and a.samples == 1152 * len(a.offsets) and a.rate == 32000
    assert a.vbr["bytes"] == len(m) - ma._id3v2(m, ma.Audio())


def test_known_headers():
    assert ma.header(bytes([0xFF, 0xFB, 0x90, 0x64])).size == 417  # 128 kbit/s at 44.1 kHz
    assert ma.header(bytes([0xFF, 0xFB, 0x92, 0x64])).size == 418
    assert ma.header(bytes([0xFF, 0xF3, 0x80, 0xC4])).size == 208  # MPEG-2, 64 kbit/s at 22.05 kHz
    assert ma.header(bytes([0xFF, 0xFF, 0xE8, 0x00])).layer == 1
    assert ma.header(bytes([0xFF, 0xFF, 0xE8, 0x00])).size == 672  # Layer I, 448 kbit/s at 32 kHz
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xeb\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb\x9c\x00", b"\xff\xfb"):
        assert ma.header(bad) is None


def test_crc_by_bits():
    data, c = b"\x90\x64" + bytes(range(32)), 0xFFFF
    for b in data:
        for i in range(7, -1, -1):
            top = (c >> 15) ^ (b >> i & 1)
            c = (c << 1 & 0xFFFF) ^ (ma.POLYNOMIAL if top else 0)
    assert ma.crc16(data) == c


def test_resynchronises_and_finds_damage():
    m = ma.encode(os.urandom(20_000))
    a = ma.parse(m)
    cut = a.offsets[5]
    b = ma.parse(m[:cut] + b"\xff\xfbjunk\xff\xff" + m[cut:] + b"TAG" + b"A title".ljust(125, b"\x00"))
    assert len(b.offsets) == len(a.offsets) and b.resyncs == 1 and b.skipped == 8 and b.tags["id3v1.title"] == "A title"
    bad = bytearray(m)
    bad[a.offsets[3] + 10] ^= 1
    assert ma.parse(bytes(bad)).crc_errors == 1
    assert a.seek(0) == a.offsets[0] and a.seek(1152 * 4 + 5) == a.offsets[4]
    assert len(ma.parse(m[:-1]).offsets) == len(a.offsets) - 1 and ma.parse(b"").offsets == [] and ma.parse(b"\xff" * 999).offsets == []


def test_vbri_table():
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1000, 2, 1, 1, 2, 1) + struct.pack(">HH", 417, 418)
    a = ma.parse(frame.ljust(417, b"\x00") + bytes([0xFF, 0xFB, 0x90, 0x64]).ljust(417, b"\x00") * 2)
    assert a.vbr == {"kind": "VBRI", "frames": 2, "bytes": 1000, "per": 1, "table": [417, 418]} and len(a.offsets) == 2


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 50, "c"), (3, "é" * 50, "c"), (None, "x" * 64, "d"), (5, "y" * 100_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    out = ma.stored_media(df).collect()
    assert len(out) == len(rows)
    for d, t, _ in rows:
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = next(r for r in out if r.doc_id == d and r.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        f = json.loads(r.feature)
        assert f["crc_errors"] == f["skipped"] == 0 and len(r.frame_offsets) == f["frames"] and r.duration_s == r.samples / 32000
        assert r.media_bytes > len(p)
    assert len({(r.media_sha256, r.feature) for r in out if r.doc_id == 3}) == 1
    assert ma.stored_media(df.limit(0)).count() == 0


def frames(head, size, n):
    return bytes(head).ljust(size, b"\x00") * n


def test_durations_of_streams_with_several_rates():
    """Five frames of 44.1 kHz, then five of 22.05 kHz (MPEG-2: 576 samples each)."""
    high, low = frames([0xFF, 0xFB, 0x90, 0x64], 417, 5), frames([0xFF, 0xF3, 0x80, 0xC4], 208, 5)
    a = ma.parse(high + low)
    assert (len(a.offsets), a.skipped, a.rate) == (10, 0, 0)
    assert a.duration == Fraction(5 * 1152, 44100) + Fraction(5 * 576, 22050) and round(float(a.duration), 3) == 0.261
    assert [a.seek(x) for x in (0, 1151, 1152, 5 * 1152, 5 * 1152 + 576, 10**9)] == [a.offsets[i] for i in (0, 0, 1, 5, 6, 9)]
    assert a.seek_time(0) == a.offsets[0] and a.seek_time(0.2) == a.offsets[7] and a.seek_time(99) == a.offsets[9]


def test_free_bitrate():
    """Frames whose header has no bitrate are as long as the distance to the next one."""
    a = ma.parse(b"junk" + frames([0xFF, 0xFB, 0x00, 0x64], 700, 4) + frames([0xFF, 0xFB, 0x02, 0x64], 701, 3))
    assert a.sizes == [700] * 4 + [701] * 3 and a.skipped == 4 and a.kbps == {0} and a.duration == Fraction(7 * 1152, 44100)
    assert ma.parse(frames([0xFF, 0xFB, 0x00, 0x64], 700, 1)).offsets == []


def tag(version, flags, body):
    return b"ID3" + bytes([version, 0, flags, *(len(body) >> s & 0x7F for s in (21, 14, 7, 0))]) + body


def test_tags_of_all_versions():
    sound = frames([0xFF, 0xFB, 0x90, 0x64], 417, 3)
    two = tag(2, 0, b"TT2\x00\x00\x06\x00Title" + b"TXX\x00\x00\x06\x00k\x00val")
    three = tag(3, 0xC0, b"\x00\x00\x00\x06" + bytes(6) + b"TIT2\x00\x00\x00\x07\x00\x00\x01\xff\x00\xfeA\x00B\x00")
    four = tag(4, 0x50, b"\x00\x00\x00\x06\x01\x00" + b"TIT2\x00\x00\x00\x0a\x00\x01\x00\x00\x00\x05\x03Title"[:21]) + b"3DI" + bytes(7)
    for data, key, value in ((two, "TT2", "Title"), (two, "k", "val"), (three, "TIT2", "AB"), (four, "TIT2", "Title")):
        a = ma.parse(data + sound)
        assert a.tags[key] == value and len(a.offsets) == 3 and a.skipped == 0 and a.offsets[0] == len(data)


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def second_crc(frame, bits):
    """The checksum by polynomial division of a string of bits."""
    c = 0xFFFF
    for x in bits_of(frame[2:4]) + bits_of(frame[6:])[:bits]:
        c = (c << 1) ^ (0x18005 if (c >> 15 & 1) != int(x) else 0)
    return c & 0xFFFF


def test_layer_two_checksums():
    """Stereo, 44.1 kHz, 192 kbit/s (96 a channel: table b): 30 subbands of 4, 3 and 2 bits, and 2 bits for each that is used."""
    body = bytearray(os.urandom(620))
    widths = [4] * 11 + [3] * 12 + [2] * 7
    bits, at, used = bits_of(body), 0, 0
    for w in widths:
        for _ in range(2):
            used += "1" in bits[at : at + w]
            at += w
    frame = bytes([0xFF, 0xFC, 0xA0, 0x04, 0, 0]) + bytes(body)
    frame = frame[: ma.header(frame[:4]).size]
    c = second_crc(frame, at + 2 * used)
    good = frame[:4] + bytes([c >> 8, c & 255]) + frame[6:]
    a = ma.parse(good * 3)
    assert (a.layer, a.checked, a.crc_errors, len(a.offsets)) == (2, 3, 0, 3)
    bad = bytearray(good * 3)
    bad[len(good) + 8] ^= 0x10
    assert ma.parse(bytes(bad)).crc_errors == 1


def second_parser(data):
    """Offsets and payload of what encode writes, by the format's own formulas: no tables, no classes of the module."""
    at = 10 + sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    out, payload = [], b""
    while at < len(data):
        word = int.from_bytes(data[at : at + 4], "big")
        assert word >> 21 == 0x7FF and word >> 19 & 3 == 3 and word >> 17 & 3 == 1 and word >> 10 & 3 == 2
        kbps = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][(word >> 12 & 15) - 1]
        size = 144_000 * kbps // 32_000
        if not word >> 16 & 1:
            assert second_crc(data[at : at + size], 8 * 32) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.append(at)
            payload += data[at + 38 : at + size]
        else:
            assert data[at + 36 : at + 40] == b"Xing"
        at += size
    return out, payload


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_a_second_parser_agrees(data):
    m = ma.encode(data)
    a = ma.parse(m)
    offsets, payload = second_parser(m)
    assert offsets == a.offsets and payload[: len(data)] == data
    f = json.loads(ma.feature(a))
    assert f["seek_crc32"] == zlib.crc32(struct.pack(f"<{len(offsets)}Q", *offsets)) and f["frames"] == len(offsets)
    assert f["samples"] == 1152 * len(offsets) and Fraction(*f["seconds"]) == Fraction(1152 * len(offsets), 32000)
