"""MPEG audio columns: write a stream of Layer I frames, and read any MPEG audio stream back.

``parse`` resynchronises on frame headers, reads ID3 tags and Xing, Info and
VBRI tables, verifies CRC-16 checksums and gives exact durations and the
offset of every frame.  ``encode`` stores bytes losslessly as the 8-bit
quantised subband samples of Layer I frames: 32 subbands of 12 samples make a
frame of 384 payload bytes, 16 subbands one of 192.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import scan, tune

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, and Hz by sampling index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}

UNIT = 192
RATE = 32000
WIDE, NARROW = b"\xff\xfe\x98\xc0", b"\xff\xfe\x58\xc0"  # 288 and 160 kbit/s, 32 kHz, mono, with checksum
WIDE_BYTES, NARROW_BYTES = 432, 240


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    checked: bool
    kbits: int
    hertz: int
    mono: bool
    length: int
    samples: int


@dataclass
class Stream:
    headers: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] | None = None
    samples: int = 0

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as samples over samples a second."""
        return self.samples, self.headers[0].hertz if self.headers else 1


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """A frame header's fields, or None where the four bytes are not one (free format included)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] < 0xE0:
        return None
    version = {3: "1", 2: "2", 0: "2.5"}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    rate, freq, pad = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version is None or layer == 4 or rate in (0, 15) or freq == 3:
        return None
    kbits, hertz = KBITS[1 if version == "1" else 2, layer][rate], HERTZ[version][freq]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    length = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    return Header(version, layer, not raw[1] & 1, kbits, hertz, raw[3] >> 6 == 3, length, samples)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int) -> int:
    """The standard's checksum, polynomial 0x8005, over the first ``bits`` bits."""
    crc = 0xFFFF
    for i in range(bits):
        top = crc >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


# Fixed values of the standard: bits of the allocation of each subband in Layer II, by table.
LOW_RATE = [4] * 2 + [3] * 10
HIGH_RATE = [4] * 11 + [3] * 12 + [2] * 7
HALF_RATE = [4] * 4 + [3] * 7 + [2] * 19


def allocation_bits(h: Header) -> list[int]:
    """Layer II: the bits of each subband's allocation; version, bit rate a channel and sampling rate choose the table and its length."""
    each = h.kbits // (1 if h.mono else 2)
    if h.version != "1":
        return HALF_RATE
    if each < 56:
        return LOW_RATE[: 12 if h.hertz == 32000 else 8]
    return HIGH_RATE[: 30 if each >= 96 and h.hertz != 48000 else 27]


def covered_bits(blob: bytes, at: int, h: Header) -> int:
    """Bits after the checksum that it covers, beside the header's last 16: allocations, side information, and Layer II's selection of scale factors."""
    if h.layer == 3:
        return 8 * ((17 if h.mono else 32) if h.version == "1" else (9 if h.mono else 17))
    joint = blob[at + 3] >> 6 == 1
    bound = 4 * (blob[at + 3] >> 4 & 3) + 4 if joint else 32  # from here on channels share an allocation
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (channels * min(bound, 32) + max(0, 32 - bound)) if not h.mono else 128
    body = int.from_bytes(blob[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big")
    place = selections = 0
    for band, width in enumerate(allocation_bits(h)):
        own = channels if h.mono or band < bound else 1
        for _ in range(own):
            if body >> (512 - place - width) & ((1 << width) - 1):
                selections += 2 * channels // own
            place += width
    return place + selections


def checksum(blob: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame's checksum fits; None where it has none."""
    if not h.checked:
        return None
    bits = covered_bits(blob, at, h)
    cover = blob[at + 2 : at + 4] + blob[at + 6 : at + 6 + (bits + 7) // 8]
    if len(cover) * 8 < 16 + bits:
        return False
    return crc16(cover, 16 + bits) == int.from_bytes(blob[at + 4 : at + 6], "big")


def _text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").rstrip("\0")


def _id3v2(blob: bytes, tags: dict[str, str]) -> int:
    """Read a leading ID3v2.3 or 2.4 tag; returns where the audio begins."""
    if len(blob) < 10 or blob[:3] != b"ID3" or max(blob[6:10]) > 127:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at = 10 + safe(blob[6:10]), 10
    while at + 10 <= min(end, len(blob)) and blob[at]:
        size = safe(blob[at + 4 : at + 8]) if blob[3] == 4 else int.from_bytes(blob[at + 4 : at + 8], "big")
        name = blob[at : at + 4].decode("latin-1")
        if name[0] == "T":
            tags[name] = _text(blob[at + 10 : at + 10 + size])
        at += 10 + size
    return end + 10 * bool(blob[5] & 16)


def _table(blob: bytes, at: int, h: Header) -> dict[str, object] | None:
    """The Xing, Info or VBRI table in the frame at ``at``, or None."""
    body = blob[at : at + h.length]
    x = 4 + ((17 if h.mono else 32) if h.version == "1" else (9 if h.mono else 17))
    for start in (x, x + 2 * h.checked):
        if body[start : start + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(body[start + 4 : start + 8], "big"), start + 8
            out: dict[str, object] = {"kind": body[start : start + 4].decode()}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(body[p : p + n]) if n == 100 else int.from_bytes(body[p : p + n], "big")
                    p += n
            return out
    if body[36:40] == b"VBRI" and len(body) >= 62:
        _, _, _, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", body[40:62])
        toc = [int.from_bytes(body[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per}
    return None


def parse(blob: bytes) -> Stream:
    """Read an MPEG audio stream.

    A header counts where the next header (same version, layer and rate)
    stands at its end, or the stream ends there; else the search goes on one
    byte later and the bytes passed are counted in ``skipped``.  A last frame
    that is cut off is skipped as well.  Empty input gives an empty Stream.
    """
    out = Stream()
    end = len(blob)
    if end >= 128 and blob[-128:-125] == b"TAG":
        end -= 128
        out.tags |= {k: v for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)) if (v := blob[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))}
    at, synced, first = _id3v2(blob, out.tags), False, True
    while at + 4 <= end:
        h = header(blob[at : at + 4])
        fits = h is not None and at + h.length <= end
        if fits and not synced and at + h.length + 4 <= end:
            after = header(blob[at + h.length : at + h.length + 4])
            fits = after is not None and (after.version, after.layer, after.hertz) == (h.version, h.layer, h.hertz)
        if not fits:
            nxt = blob.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if (good := checksum(blob, at, h)) is not None:
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        if first and (table := _table(blob, at, h)):
            out.table = table
        else:
            out.headers.append(h)
            out.offsets.append(at)
            out.samples += h.samples
        first = False
        at += h.length
    out.skipped += max(0, end - at)
    return out


def _framed(head: bytes, allocation: bytes, rest: bytes, length: int) -> bytes:
    crc = crc16(head[2:] + allocation, 16 + 128)
    return (head + crc.to_bytes(2, "big") + allocation + rest).ljust(length, b"\0")


_WIDE_HEAD = _framed(WIDE, b"\x77" * 16, b"\0" * 24, 46)
_NARROW_HEAD = _framed(NARROW, b"\x77" * 8 + b"\0" * 8, b"\0" * 12, 34)


def encode(payload: bytes) -> bytes:
    """Store bytes, a multiple of 192 of them, as MPEG-1 Layer I audio at variable bitrate.

    The all-ones sample code is not allowed in Layer I, so byte 255 (which
    UTF-8 never has) raises ValueError.
    """
    if len(payload) % UNIT or b"\xff" in payload:
        raise ValueError("the payload must be a multiple of 192 bytes without byte 255")
    full = len(payload) // (2 * UNIT)
    frames = [_WIDE_HEAD + payload[k * 384 : k * 384 + 384] + b"\0\0" for k in range(full)]
    if len(payload) % (2 * UNIT):
        frames.append((_NARROW_HEAD + payload[full * 384 :]).ljust(NARROW_BYTES, b"\0"))
    n = len(frames)
    per = max(1, -(-n // 100))
    sizes = [sum(map(len, frames[k : k + per])) for k in range(0, n, per)]
    scale = max(1, -(-max(sizes, default=0) // 65535))
    table = struct.pack(">HHHIIHHHH", 1, 0, 75, WIDE_BYTES + sum(map(len, frames)), n, len(sizes), scale, 2, per) + b"".join((s // scale).to_bytes(2, "big") for s in sizes)
    info = _framed(WIDE, b"\0" * 16, b"\0" * 14 + b"VBRI" + table, WIDE_BYTES)
    millis = str(n * 384 * 1000 // RATE).encode()
    tag = b"TLEN" + (len(millis) + 1).to_bytes(4, "big") + b"\0\0\0" + millis
    k = len(tag)
    lead = b"ID3\x03\0\0" + bytes((k >> 21 & 127, k >> 14 & 127, k >> 7 & 127, k & 127)) + tag
    return lead + info + b"".join(frames) + b"TAG".ljust(128, b"\0")


def decode(blob: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream that ``encode`` wrote, from its frames' sample codes."""
    parts = []
    stream = stream or parse(blob)
    for at, h in zip(stream.offsets, stream.headers, strict=True):
        bands = 2 * blob[at + 6 : at + 22].count(0x77)
        start = at + 22 + bands * 6 // 8
        parts.append(blob[start : start + 12 * bands])
    return b"".join(parts)


def feature(stream: Stream) -> str:
    """What a stream holds, in one line; equal streams give equal lines."""
    n, rate = stream.seconds
    seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    kind = (stream.table or {}).get("kind", "none")
    return f"frames={len(stream.offsets)};samples={n};hertz={rate};table={kind};crc={stream.crc_good}/{stream.crc_good + stream.crc_bad};skipped={stream.skipped};seek={seek:08x}"


INFO = "frames long, samples long, hertz int, crc_good long, crc_bad long, skipped long, table string, tags map<string,string>, seek_offsets array<long>"


def media_info(df: DataFrame, column: str = "media", into: str = "mpeg") -> DataFrame:
    """``df`` with a struct column ``into`` that describes the binary ``column``.

    Null gives a null struct, bytes without a frame a struct of zeros with
    all bytes skipped.  Other columns pass through; a column already named
    ``into`` is replaced.
    """
    from pyspark.sql import types as T

    tune(df.sparkSession)

    def one(blob):
        if blob is None:
            return None
        s = parse(bytes(blob))
        return (len(s.offsets), s.samples, s.seconds[1], s.crc_good, s.crc_bad, s.skipped, (s.table or {}).get("kind"), s.tags, s.offsets)

    return df.withColumn(into, F.udf(one, T.StructType.fromDDL(INFO), useArrow=True)(F.col(column)))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, hertz int, seek_offsets array<long>"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as MPEG audio, read the stored bytes back and describe them.

    Null text counts as empty, an empty text as 192 spaces; a null id stays
    null; repeated rows give repeated results.  Other columns are not read.
    With ``keep_media`` the stored bytes come along as column ``media``.
    """
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(11 + keep_media)]
        seen: dict[str, tuple] = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text not in seen:
                raw = (text or "").encode()
                media = encode(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "))
                stream = parse(media)
                back = decode(media, stream)
                seen[text] = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream.samples, stream.seconds[1], stream.offsets, *([media] if keep_media else []))
            for column, value in zip(rows, (key, *seen[text]), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "seek_offsets", "media"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names[: len(rows)])

    return scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, DIGEST + ", media binary" * keep_media)
