"""MPEG audio files in a column: written with a payload in their ancillary data, and read without trusting them.

A written file is an ID3v2 tag, a frame with the table of a variable bitrate (frames, bytes, 100 seek points), and Layer III
frames at 44.1 kHz, mono, each with a checksum. The frames are silent: their side information is zero, so everything
behind it is ancillary data, which decoders pass over and which holds the payload, a byte for a byte. Frames take the
largest bitrate until the rest fits a smaller one.

``read_file`` works on any MPEG-1, -2 or -2.5 audio: it skips tags, looks for a header whose frame ends at another header,
a tag or the end, resynchronises after junk, reads tables of variable bitrates (Xing, Info, VBRI), verifies checksums of
Layers I and III, and gives the duration by each frame's own rate and the offset of every frame. It does not verify
checksums of Layer II (they aren't counted) and does not read frames of free bitrates. ``rate`` is the last frame's.

Defined results: a null or empty text is a payload of 64 zero bytes; a null ``doc_id`` is kept; repeated rows give
repeated results; an empty table gives an empty result. Null or broken media give no frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAYLOAD_UNIT = 64
#: Bytes and rows that a task works on at once (one row at least).
TOGETHER, ROWS = 1 << 20, 1000
# Fixed values of the format: kbit/s by version 1 or 2 and layer, sample rates by version, samples of a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF


@lru_cache(65536)
def crc16(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    rate: int
    length: int
    samples: int
    side: int


@lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """The frame that four bytes announce, or None if they are no header (free bitrates aren't read)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    family = 1 if version == 3 else 2
    kbit, hertz, pad = BITRATES[family, layer][index], RATES[version][rate], word[2] >> 1 & 1
    samples = SAMPLES[family, layer]
    length = (12000 * kbit // hertz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, hertz, length, samples, side)


def _header(index: int, checked: bool) -> bytes:
    return bytes([0xFF, 0xFA if checked else 0xFB, index << 4, 0xC0])


@lru_cache(1)
def _frames() -> list[tuple[int, bytes]]:
    """For each bitrate from the smallest: what its frames hold, and what stands before that."""
    out = []
    for index in range(1, 15):
        head = _header(index, True)
        start = head + crc16(head[2:] + bytes(17)).to_bytes(2) + bytes(17)
        out.append((parse_header(head).length - len(start), start))
    return out


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


@lru_cache(4096)
def _table_frame(full: int, last: int) -> bytes:
    """The frame in front: frames, bytes and seek points of so many full frames and a last one of this bitrate (or none)."""
    head = _header(5, False)
    own, biggest = parse_header(head).length, len(_frames()[-1][1]) + _frames()[-1][0]
    n = full + (last >= 0)
    total = own + full * biggest + (len(_frames()[last][1]) + _frames()[last][0] if last >= 0 else 0)
    points = bytes(min(255, 256 * (own + i * n // 100 * biggest) // total) for i in range(100))
    body = b"Xing" + (15).to_bytes(4) + n.to_bytes(4) + total.to_bytes(4) + points + (0).to_bytes(4)
    return (head + bytes(17) + body).ljust(own, b"\0")


def write_file(payload: bytes) -> bytes:
    """An MPEG audio file that holds the payload."""
    tag = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(tag)) + b"\0\0" + tag
    sizes = _frames()
    room, start = sizes[-1]
    full, rest = divmod(len(payload), room)
    last = next(k for k, (size, _) in enumerate(sizes) if size >= rest) if rest else -1
    parts = [b"ID3\x04\0\0", _synchsafe(len(tag)), tag, _table_frame(full, last)]
    for k in range(full):
        parts += (start, payload[k * room : (k + 1) * room])
    if rest:
        parts += (sizes[last][1], payload[full * room :].ljust(sizes[last][0], b"\0"))
    return b"".join(parts)


@dataclass
class Media:
    tags: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    samples: int = 0
    samples_at: dict = field(default_factory=dict)
    rate: int = 0
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    last_end: int = 0
    table: dict | None = None
    table_fits: bool = False
    ancillary: bytes = b""

    @property
    def seconds(self) -> float:
        return sum((n / rate for rate, n in self.samples_at.items()), 0.0)


def _read_tag(data: bytes, at: int, tags: dict) -> int:
    """Read the ID3v2 tag at ``at`` and give its end."""
    size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
    end = min(len(data), at + 10 + size)
    p, major = at + 10, data[at + 3]
    while p + 10 <= end and data[p : p + 4].isalnum():
        raw = data[p + 4 : p + 8]
        n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0))) if major >= 4 else int.from_bytes(raw)
        body = data[p + 10 : p + 10 + n]
        name = data[p : p + 4].decode("latin-1")
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        p += 10 + n
    return end


def _bits(data: bytes, at: int, n: int) -> int:
    word = int.from_bytes(data[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"))
    return word >> 32 - n - (at & 7) & (1 << n) - 1


@lru_cache(65536)
def _main_bytes(side: bytes, version: int) -> int:
    """Bytes of audio that a Layer III frame's side information announces."""
    if not any(side):
        return 0
    mono = len(side) in (9, 17) and (version == 3) == (len(side) == 17)
    channels = 1 if mono else 2
    if version == 3:
        first, step, granules = (18 if mono else 20), 59, 2
    else:
        first, step, granules = (9 if mono else 10), 63, 1
    return (sum(_bits(side, first + k * step, 12) for k in range(channels * granules)) + 7) // 8


def _allocation_bytes(modes: int) -> int:
    """Bytes of a Layer I frame's bit allocation, which its checksum covers, by the header's last byte."""
    mode, bound = modes >> 6, 4 * ((modes >> 4 & 3) + 1)
    return 16 if mode == 3 else (32 + bound) // 2 if mode == 1 else 32


def read_file(data: bytes | None) -> Media:
    """What the stored bytes are: tags, frames, duration, checksums, seek offsets, ancillary data."""
    data = data or b""
    out = _read_frames(data, len(data))
    # "TAG" may be part of the last frame: it is a tag only where the frames before it end, and none reaches into it
    if data[-128:-125] == b"TAG" and out.last_end <= len(data) - 128:
        shorter = _read_frames(data, len(data) - 128)
        if shorter.last_end == len(data) - 128:
            out = shorter
            out.tags.setdefault("title", data[-125:-95].rstrip(b"\0 ").decode("latin-1"))
    return out


def _read_frames(data: bytes, end: int) -> Media:
    """What the bytes before ``end`` are."""
    out, p = Media(), 0
    ancillary, synced = [], False
    while p < end:
        if data[p : p + 3] == b"ID3" and p + 10 <= end:
            p = out.last_end = _read_tag(data, p, out.tags)
            continue
        head = parse_header(data[p : p + 4])
        follows = head and (p + head.length == end or p + head.length < end and (data[p + head.length : p + head.length + 3] == b"ID3" or parse_header(data[p + head.length : p + head.length + 4])))
        if not head or not (follows or synced and p + head.length <= end):
            synced = False
            nearest = [x for x in (data.find(b"\xff", p + 1, end), data.find(b"ID3", p + 1, end)) if x > 0]
            found = min(nearest, default=end)
            out.skipped += found - p
            p = found
            continue
        synced = True
        body = p + 4 + 2 * head.checked
        side = data[body : body + head.side]
        if head.checked and head.layer != 2:
            covered = side if head.layer == 3 else data[body : body + _allocation_bytes(data[p + 3])]
            out.checked += 1
            out.broken += crc16(data[p + 2 : p + 4] + covered) != int.from_bytes(data[p + 4 : p + 6])
        mark = data[body + head.side : body + head.side + 4]
        if not out.offsets and out.table is None and mark in (b"Xing", b"Info"):
            q = body + head.side + 4
            flags = int.from_bytes(data[q : q + 4])
            q += 4
            out.table = {"at": p}
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "points", 100), (8, "quality", 4)):
                if flags & bit:
                    out.table[name] = data[q : q + n] if n == 100 else int.from_bytes(data[q : q + n])
                    q += n
        elif not out.offsets and out.table is None and head.layer == 3 and data[p + 36 : p + 40] == b"VBRI":
            out.table = {"at": p, "quality": int.from_bytes(data[p + 44 : p + 46]), "bytes": int.from_bytes(data[p + 46 : p + 50]), "frames": int.from_bytes(data[p + 50 : p + 54])}
            entries, scale, width, step = (int.from_bytes(data[q : q + 2]) for q in range(p + 54, p + 62, 2))
            out.table |= {"frames_per_entry": step, "entries": [scale * int.from_bytes(data[q : q + width]) for q in range(p + 62, min(p + 62 + entries * width, p + head.length), width or 1)]}
        else:
            out.offsets.append(p)
            out.samples += head.samples
            out.samples_at[head.rate] = out.samples_at.get(head.rate, 0) + head.samples
            out.rate = head.rate
            if head.layer == 3:
                ancillary.append(data[body + head.side + _main_bytes(side, head.version) : p + head.length])
        p += head.length
        out.last_end = p
    out.ancillary = b"".join(ancillary)
    if out.table is not None:
        out.table_fits = out.table.get("frames") == len(out.offsets) and out.table.get("bytes") == end - out.table["at"]
    return out


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of the unit."""
    return text.ljust(max(PAYLOAD_UNIT, -(-len(text) // PAYLOAD_UNIT) * PAYLOAD_UNIT), b"\0")


def pieces(batch: pa.RecordBatch, column: int):
    """Slices of a batch of about TOGETHER bytes in the column, so that long texts don't make large pieces."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, k = np.cumsum(sizes, dtype=np.int64), 0
    while k < batch.num_rows:
        begin = ends[k - 1] if k else 0
        n = min(ROWS, max(1, int(np.searchsorted(ends, begin + TOGETHER, "right")) - k))
        yield batch.slice(k, n)
        k += n


def with_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8), media: the text of each document stored in an MPEG audio file."""

    def scan(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                texts = [(x.as_py() or "").encode() for x in part.column(1)]
                media = pa.array([write_file(payload_of(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_bytes long, media binary")


READ = "tags map<string,string>, n_frames long, samples long, sample_rate int, duration_s double, seek_offsets array<int>, table_fits boolean, n_checked long, n_broken long, n_skipped long, payload binary"


def read_media(files: DataFrame) -> DataFrame:
    """files (with a binary column ``media``) plus what ``read_file`` finds; payload: the ancillary data up to the size its tag gives."""
    fields = T._parse_datatype_string(READ).fields
    kept = [c for c in files.columns if c not in {f.name for f in fields}]

    def scan(batches):
        for batch in batches:
            at = batch.schema.get_field_index("media")
            for part in pieces(batch, at):
                found = [read_file(x.as_py()) for x in part.column(at)]
                payloads = [m.ancillary[: int(m.tags["payload_bytes"])] if m.tags.get("payload_bytes", "").isdecimal() else m.ancillary for m in found]
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([list(m.tags.items()) for m in found], pa.map_(pa.string(), pa.string())), pa.array([len(m.offsets) for m in found], pa.int64()),
                    pa.array([m.samples for m in found], pa.int64()), pa.array([m.rate for m in found], pa.int32()), pa.array([m.seconds for m in found]),
                    pa.array([m.offsets for m in found], pa.list_(pa.int32())), pa.array([m.table_fits for m in found]), pa.array([m.checked for m in found], pa.int64()),
                    pa.array([m.broken for m in found], pa.int64()), pa.array([m.skipped for m in found], pa.int64()), pa.array(payloads, pa.binary()),
                ], names=[*kept, *[f.name for f in fields]])

    out = T.StructType([*[files.schema[c] for c in kept], *fields])
    return files.select(*[f"`{c}`" for c in kept]).mapInArrow(scan, out)
