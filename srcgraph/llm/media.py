"""Media columns: MPEG audio streams as binary columns.

write_stream() puts bytes into a valid MPEG-1 Layer III stream: an ID3v2 tag, a Xing frame with
counts and a seek table, then frames with header checksums whose granules are empty and whose
ancillary data hold the bytes, so the stream is lossless. read_stream() takes any MPEG audio
(versions 1, 2, 2.5; layers I to III; free format): it reads tags (ID3v2.3 and 2.4, with or without
unsynchronisation), finds the next frame where a header is damaged, parses the variable-bitrate table (Xing, Info or
VBRI), verifies the checksums of all layers and gives exact durations and the frames' offsets for seeking.

Defined cases: null and empty texts give 64 zero bytes of payload; any length works, a very long text is one
stream, built and read in pieces of one frame; bytes that are not audio give no frames; equal texts give
equal values; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from .base import map_texts

# Bitrates in kbit/s by (MPEG-1?, layer), sampling rates by version (fixed values of the format).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Bits of the allocation of each subband in Layer II: runs of (subbands, bits), by table (fixed values of the format).
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}
#: The longest free-format frame that is looked for.
LONGEST = 8192
SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE
PAD = 64


class Header(NamedTuple):
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int  # 0: free format, known from the next header only
    samples: int
    bound: int  # subbands that joint stereo keeps apart


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """A frame header, or None where these four bytes are none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    index, rate_index = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index == 15 or rate_index == 3:
        return None
    bitrate, rate = BITRATES[version == 1.0, min(layer, 3)][index], RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1.0 else 1152
    pad = word[2] >> 1 & 1
    size = (samples // 32 * bitrate * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate * 1000 // rate + pad
    bound = 4 * (1 + (word[3] >> 4 & 3)) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, bitrate, rate, word[3] >> 6 == 3, size if index else 0, samples, bound)


def bits_of(data: bytes, start: int, count: int) -> int:
    """`count` bits from bit `start` on, those behind the end as zeros."""
    first, last = start >> 3, (start + count + 7) >> 3
    return int.from_bytes(data[first:last].ljust(last - first, b"\0")) >> (8 * last - start - count) & ((1 << count) - 1)


def covered_bits(h: Header, body: bytes) -> int:
    """Bits behind header and checksum that the checksum of a Layer I or II frame covers: the allocation and, in
    Layer II, two bits for each subband and channel that has any."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else h.bound + 32)
    each = h.bitrate // channels
    low = h.version == 1.0 and each < 56
    table = "lsf" if h.version != 1.0 else ("d" if h.rate == 32000 else "c") if low else "b" if each >= 96 and h.rate != 48000 else "a"
    widths = [bits for n, bits in ALLOCATION[table] for _ in range(n)]
    at, chosen = 0, 0
    for band, width in enumerate(widths):
        apart = channels if band < h.bound else 1
        for _ in range(apart):
            chosen += (channels // apart) * (bits_of(body, at, width) > 0)
            at += width
    return at + 2 * chosen


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, all ones at the start."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


def crc16_bits(head: bytes, body: bytes, count: int) -> int:
    """The checksum of two bytes of the header and the first `count` bits of the body."""
    value = crc16(head + body[: count // 8])
    for i in range(count // 8 * 8, count):
        top = (value >> 15) ^ bits_of(body, i, 1)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def side_bytes(h: Header) -> int:
    return {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[h.version == 1.0, h.mono] if h.layer == 3 else 0


@lru_cache(maxsize=32)
def _frame_start(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a 48 kHz mono frame; bytes of room behind."""
    word = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 3 << 6))
    side = bytes(SIDE)
    return word + crc16(word[2:] + side).to_bytes(2) + side, header(word).size - HEAD


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _tag(payload_bytes: int) -> bytes:
    text = b"\0payload_bytes\0" + str(payload_bytes).encode()
    frame = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text
    return b"ID3\x03\0\0" + _syncsafe(len(frame)) + frame


def write_stream(payload: bytes) -> bytes:
    rooms = [(_frame_start(i)[1], i) for i in range(1, 15)]
    most, top = rooms[-1]
    bodies, at = [], 0
    while at < len(payload):
        room, index = (most, top) if len(payload) - at >= most else next(r for r in rooms if r[0] >= len(payload) - at)
        bodies.append(_frame_start(index)[0] + payload[at : at + room].ljust(room, b"\0"))
        at += room
    tag = _tag(len(payload))
    xing_start, xing_room = _frame_start(5)
    total = xing_room + len(xing_start) + sum(map(len, bodies))
    table = bytes(min(255, 256 * sum(map(len, bodies[: len(bodies) * p // 100])) // total) for p in range(100)) if len(bodies) < 100 else _even_table(bodies, total)
    xing = b"Xing" + (7).to_bytes(4) + len(bodies).to_bytes(4) + total.to_bytes(4) + table
    return b"".join([tag, xing_start, xing.ljust(xing_room, b"\0"), *bodies])


def _even_table(bodies: list[bytes], total: int) -> bytes:
    """All frames but the last have one size."""
    return bytes(min(255, 256 * (len(bodies) * p // 100 * len(bodies[0])) // total) for p in range(100))


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: tuple[int, int, bytes] | None = None
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    bitrates: int = 0


def _safe(data: bytes) -> int:
    return sum(b << shift for b, shift in zip(data, (21, 14, 7, 0), strict=True))


def _read_tag(data: bytes, out: Stream) -> int:
    """Length of an ID3v2 tag at the start; its user text goes to out.tags."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    version, flags, end = data[3], data[5], 10 + _safe(data[6:10])
    held = data[10:end]
    if flags & 0x80 and version < 4:
        held = held.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and len(held) >= 4:  # an extended header
        at = _safe(held[:4]) if version >= 4 else 4 + int.from_bytes(held[:4])
    while at + 10 <= len(held) and held[at] != 0:
        size = _safe(held[at + 4 : at + 8]) if version >= 4 else int.from_bytes(held[at + 4 : at + 8])
        body = held[at + 10 : at + 10 + size]
        if version >= 4:
            body = body[4:] if held[at + 9] & 1 else body  # its length before unsynchronisation
            body = body.replace(b"\xff\0", b"\xff") if held[at + 9] & 2 else body
        if held[at : at + 4] == b"TXXX":
            name, _, value = body[1:].lstrip(b"\0").partition(b"\0")
            out.tags[name.decode("latin-1")] = value.rstrip(b"\0").decode("latin-1")
        at += 10 + size
    return end + 10 * (version >= 4 and bool(flags & 0x10))


def free_size(data: bytes, at: int) -> int:
    """Length of a free-format frame: up to the next header of its kind, or the end where there is none; 0 where
    neither is near."""
    word = data[at : at + 4]
    place = data.find(word[:2], at + 24)
    while 0 <= place <= at + LONGEST:
        if len(data) >= place + 4 and data[place + 2] & 0xFC == word[2] & 0xFC and data[place + 3] >> 6 == word[3] >> 6:
            return place - at
        place = data.find(word[:2], place + 1)
    return len(data) - at if len(data) - at <= LONGEST else 0


def _table(data: bytes, at: int, body: int) -> tuple[int, int, bytes] | None:
    """(frames, bytes, seek table) of a variable-bitrate table in a frame."""
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags, place = int.from_bytes(data[body + 4 : body + 8]), body + 8
        counts = [0, 0]
        for bit in (0, 1):
            if flags >> bit & 1:
                counts[bit] = int.from_bytes(data[place : place + 4])
                place += 4
        return counts[0], counts[1], data[place : place + 100] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda start, n: int.from_bytes(data[at + 36 + start : at + 36 + start + n])
        return number(14, 4), number(10, 4), data[at + 62 : at + 62 + number(18, 2) * number(22, 2)]
    return None


def read_stream(data: bytes) -> Stream:
    out = Stream()
    at, end = _read_tag(data, out), len(data)
    synced = True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        size = h.size or free_size(data, at) if h else 0
        # Out of step, a header counts only if another one, or the end, follows its frame.
        if not size or at + size > end or not (synced or at + size == end or header(data[at + size : at + size + 4])):
            if end - at == 128 and data[at : at + 3] == b"TAG":
                break
            following = data.find(b"\xff", at + 1)
            following = end if following < 0 else following
            out.skipped += following - at
            at, synced = following, False
            continue
        synced = True
        start = 4 + 2 * h.protected
        side = side_bytes(h)
        if h.protected:
            out.checked += 1
            stored, rest = int.from_bytes(data[at + 4 : at + 6]), data[at + 6 : at + size]
            made = crc16(data[at + 2 : at + 4] + rest[:side]) if h.layer == 3 else crc16_bits(data[at + 2 : at + 4], rest, covered_bits(h, rest))
            out.bad += made != stored
        body = at + start + side
        table = _table(data, at, body) if out.vbr is None and not out.offsets and h.layer == 3 else None
        if table:
            out.vbr = table
        else:
            out.offsets.append(at)
            out.bodies.append(data[body : at + size])
            out.samples += h.samples
            out.rate = h.rate
            out.bitrates += h.bitrate or size * 8 * h.rate // h.samples // 1000
        at += size
    return out


def payload_of(stream: Stream) -> bytes:
    return b"".join(stream.bodies)[: int(stream.tags.get("payload_bytes", -1))] if "payload_bytes" in stream.tags else b"".join(stream.bodies)


def padded(data: bytes) -> bytes:
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def to_media(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, n_bytes and the media column of each text."""

    def one(text: str) -> tuple:
        data = text.encode()
        return len(data), write_stream(padded(data))

    return map_texts(df, keys, column, one, "n_bytes long, media binary")


def media_features(df: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """Read the stored bytes back: payload digests, exact duration and seek offsets."""

    def one(media: bytes) -> tuple:
        s = read_stream(media)
        payload = payload_of(s)
        listed = s.vbr is not None and s.vbr[0] == len(s.offsets)
        feature = f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};kbit={s.bitrates};crc={s.checked - s.bad}/{s.checked};table={'ok' if listed else 'no'};skipped={s.skipped}"
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature,
            len(s.offsets), s.samples, s.rate, s.offsets,
        )

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_samples long, sample_rate long, seek_offsets array<long>"
    return map_texts(df, keys, column, one, schema)
