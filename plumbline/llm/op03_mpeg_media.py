"""MPEG audio as a lossless carrier: writing, and reading with resynchronisation.

Writing: an ID3v2.3 tag (text field ``payload_bytes``), then an MPEG-1 Layer III mono 48 kHz stream whose first
frame holds a variable-bitrate table (``Xing``: frames, bytes, 100 seek points).  Every frame has a header, a
CRC-16, a zero side information block (decodes as silence) and bytes of the payload as ancillary data.  Full
frames run at 320 kbit/s; the last takes the lowest rate that holds the rest.

Reading takes any Layer III stream (MPEG-1, 2 and 2.5; one or two channels; any constant or variable bitrate): tags at
either end are parsed and left out, then headers are searched: a header counts if its fields are valid and its checksum
holds; where it has none, or follows no other frame, the next frame must also begin where it says (or the stream end there).
Otherwise the search goes on one byte later, so junk and damaged frames are stepped over and counted.  A variable-bitrate
table (``Xing``, ``Info`` or ``VBRI``) in the first frame is read as far as that frame goes.  Durations are exact (frames x
samples of a frame / rate) and ``frame_offsets`` are the byte positions of all frames that sound: the seek table.

Nulls: a null text is empty; its payload is 64 zero bytes.  Repeated rows give repeated results, equal texts equal
ones.  A stream without the ``payload_bytes`` field (a foreign one) has no payload: its digest columns are null.  A null stream
is an empty one.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, slices, texts_of

#: Fixed values of Layer III: kbit/s by index for MPEG-1 and for MPEG-2 and 2.5, rates of MPEG-1, samples of its frames.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44_100, 48_000, 32_000)
SAMPLES = 1152
RATE = 48_000
SIDE = 17  # bytes of side information, mono
SKIP = 4 + 2 + SIDE  # header, checksum, side information
ALIGN = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG's CRC-16 (polynomial 8005, start FFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def _frame_bytes(index: int) -> int:
    return 144 * BITRATES[index] * 1000 // RATE


def _frames(index: int, bodies: np.ndarray) -> np.ndarray:
    """Frames at one bitrate; ``bodies`` has a row of ancillary bytes for each."""
    n = len(bodies)
    out = np.zeros((n, _frame_bytes(index)), np.uint8)
    out[:, 0], out[:, 1] = 0xFF, 0xFA  # sync, MPEG-1, Layer III, protected
    out[:, 2], out[:, 3] = index << 4 | 1 << 2, 0xC0  # 48 kHz, no padding; one channel
    crc = crc16(np.concatenate([out[:1, 2:4], out[:1, 6:SKIP]], axis=1))  # the same for all: side information is zero
    out[:, 4], out[:, 5] = crc >> 8, crc & 0xFF
    out[:, SKIP : SKIP + bodies.shape[1]] = bodies
    return out


def _id3(fields: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + struct.pack(">IH", len(v), 0) + v for v in (b"\0" + k.encode() + b"\0" + x.encode() for k, x in fields.items()))
    n = len(body)
    return b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


FULL = _frame_bytes(14) - SKIP  # payload of a full frame
_TABLE = 9  # 128 kbit/s: the frame that holds the variable-bitrate table


def pad(text: bytes) -> bytes:
    """The payload: ``text`` with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(ALIGN, -(-len(text) // ALIGN) * ALIGN) - len(text))


def encode(payload: bytes) -> bytes:
    """``payload`` as an MPEG audio stream."""
    full, rest = divmod(len(payload), FULL)
    data = np.frombuffer(payload, np.uint8)
    parts, sizes = [_frames(14, data[: full * FULL].reshape(full, FULL)).tobytes()], [_frame_bytes(14)] * full
    if rest:
        index = next(k for k in range(1, 15) if _frame_bytes(k) - SKIP >= rest)
        parts.append(_frames(index, data[full * FULL :].reshape(1, rest)).tobytes())
        sizes.append(_frame_bytes(index))
    ends = _frame_bytes(_TABLE) + np.r_[0, np.cumsum(sizes)]
    seek = ends[(np.arange(100) * len(sizes)) // 100] * 256 // int(ends[-1])
    table = b"Xing" + struct.pack(">III", 7, len(sizes), int(ends[-1])) + seek.astype(np.uint8).tobytes()
    first = _frames(_TABLE, np.frombuffer(table, np.uint8).reshape(1, -1)).tobytes()
    return b"".join((_id3({"payload_bytes": str(len(payload))}), first, *parts))


@dataclass
class Stream:
    fields: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of the frames that sound
    bodies: list[int] = field(default_factory=list)  # where their side information ends
    lengths: list[int] = field(default_factory=list)
    bitrates: list[int] = field(default_factory=list)  # kbit/s
    samples: int = 0
    seconds: float = 0.0
    rate: int = 0  # of the last frame
    channels: int = 0
    version: str = ""
    checked: int = 0  # frames whose checksum held
    skipped: int = 0  # bytes stepped over
    table: dict | None = None  # the variable-bitrate table


@dataclass(frozen=True)
class Header:
    length: int
    kbps: int
    version: str
    rate: int
    channels: int
    checked: bool  # a checksum follows
    side: int  # bytes of side information
    samples: int

    def like(self, other: Header) -> bool:
        """Whether both can be frames of one stream."""
        return (self.version, self.rate, self.channels, self.checked) == (other.version, other.rate, other.channels, other.checked)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _text_frames(data: bytes, at: int, stop: int, version: int) -> dict[str, str]:
    """User text fields of a tag's frames (versions 2.2 to 2.4), as far as they are whole."""
    fields, head = {}, 6 if version == 2 else 10
    while at + head <= stop and data[at : at + 3].strip(b"\0"):
        size = data[at + 3 : at + 6] if version == 2 else data[at + 4 : at + 8]
        n = _syncsafe(size) if version == 4 else int.from_bytes(size, "big")
        value = data[at + head : min(at + head + n, stop)]
        if data[at : at + 3] == b"TXX" and value[:1] and value[0] in _ENCODINGS:
            name, _, text = value[1:].decode(_ENCODINGS[value[0]], "replace").partition("\0")
            fields[name] = text.lstrip("\ufeff").rstrip("\0")
        at += head + n
    return fields


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text fields, and where audio begins and ends."""
    fields, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        version, flags = data[begin + 3], data[begin + 5]
        at = begin + 10
        stop = at + _syncsafe(data[begin + 6 : begin + 10])
        if flags & 0x40 and version > 2 and len(data) >= at + 4:  # an extended header
            at += _syncsafe(data[at : at + 4]) if version == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
        fields |= _text_frames(data, at, min(stop, len(data)), version)
        begin = min(stop + 10 * bool(flags & 0x10), len(data))
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        fields.setdefault("title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return fields, begin, end


def _header(data: bytes, at: int) -> Header | None:
    """The Layer III header at ``at``, if there is one."""
    if data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    version = {3: "1", 2: "2", 0: "2.5"}.get(data[at + 1] >> 3 & 3)
    b, mode = data[at + 2], data[at + 3] >> 6
    index, rate = b >> 4, b >> 2 & 3
    if version is None or index in (0, 15) or rate == 3 or data[at + 3] & 3 == 2:
        return None
    first, mono = version == "1", mode == 3
    hertz = RATES[rate] // {"1": 1, "2": 2, "2.5": 4}[version]
    kbps, samples = (BITRATES if first else LOW_BITRATES)[index], SAMPLES if first else SAMPLES // 2
    side = (17 if mono else 32) if first else 9 if mono else 17
    return Header(samples * 125 * kbps // hertz + (b >> 1 & 1), kbps, version, hertz, 1 if mono else 2, not data[at + 1] & 1, side, samples)


def _whole(data: bytes, at: int, head: Header) -> bool:
    """Whether the frame's checksum (if it has one) holds."""
    return not head.checked or _crc_one(data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]) == data[at + 4] << 8 | data[at + 5]


_SEEN: dict[bytes, int] = {}


def _crc_one(block: bytes) -> int:
    if (c := _SEEN.get(block)) is None:
        c = int(crc16(np.frombuffer(block, np.uint8).reshape(1, -1))[0])
        if len(_SEEN) < 4096:
            _SEEN[block] = c
    return c


def scan(data: bytes) -> Stream:
    """Find all frames of ``data``, whatever lies between them."""
    out = Stream()
    out.fields, at, end = _tags(data)
    synced, by_rate = False, {}
    while at + 4 <= end:
        head = _header(data, at)
        nxt = at + head.length if head else 0
        good = head is not None and nxt <= end and nxt >= at + 6 + head.side and _whole(data, at, head)
        if good and not (synced and head.checked):  # without a checksum, or on its own, a header may be chance: another one, or the end, must follow
            after = _header(data, nxt) if nxt + 4 <= end else None
            good = nxt == end or after is not None and after.like(head)
        if not good:
            synced = False
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        synced = True
        body = at + 4 + 2 * head.checked + head.side
        table = _table(data, at, body, nxt) if not out.offsets and out.table is None else None
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.bodies.append(body)
            out.lengths.append(head.length)
            out.bitrates.append(head.kbps)
            out.samples += head.samples
            by_rate[head.rate] = by_rate.get(head.rate, 0) + head.samples
        out.rate, out.channels, out.version = head.rate, head.channels, head.version
        out.checked += head.checked
        at = nxt
    out.skipped += max(0, end - at)
    out.seconds = sum(n / rate for rate, n in by_rate.items())
    return out


def _table(data: bytes, at: int, body: int, end: int) -> dict | None:
    """The variable-bitrate table of the frame from ``at`` to ``end``, as far as it goes: frames, bytes, seek points."""
    table: dict = {}
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= end:
        flags, at = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and at + 4 <= end:
                table[name] = int.from_bytes(data[at : at + 4], "big")
                at += 4
        if flags & 4 and at + 100 <= end:
            table["seek"] = list(data[at : at + 100])
        return table
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= end:
        _, _, _, table["bytes"], table["frames"], n, scale, size, _ = struct.unpack_from(">HHHIIHHHH", data, at + 40)
        points = [int.from_bytes(data[x : x + size], "big") * scale for x in range(at + 62, min(at + 62 + n * size, end - size + 1), max(1, size))]
        table["seek"] = np.cumsum(points).tolist()
        return table
    return None


def payload_of(data: bytes, stream: Stream) -> bytes | None:
    """The ancillary bytes of all frames, cut to the length that the tag states; None for a stream that carries none."""
    size = stream.fields.get("payload_bytes", "")
    if not size.isdecimal():
        return None
    return b"".join([data[b : a + n] for a, b, n in zip(stream.offsets, stream.bodies, stream.lengths)])[: int(size)]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each row of ``docs`` (doc_id, text)."""

    def write(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([encode(pad(t)) for t in texts], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frames long, frame_offsets array<long>"


def read_media(media: DataFrame) -> DataFrame:
    """Digests, durations and frame offsets of stored streams (doc_id, n_bytes, media)."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for data in texts_of(part.column("media")):
                    s = scan(data)
                    payload = payload_of(data, s)
                    seek = np.array(s.offsets, "<u8").tobytes()
                    low, high = (min(s.bitrates), max(s.bitrates)) if s.bitrates else (0, 0)
                    table = "none" if s.table is None else s.table.get("frames") == len(s.offsets)
                    feature = f"mpeg{s.version}-layer3 rate={s.rate} channels={s.channels} kbps={low}-{high} frames={len(s.offsets)} samples={s.samples} table={table} checked={s.checked} skipped={s.skipped} seek={zlib.crc32(seek):08x}"
                    digests = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]))
                    rows.append((*digests, len(data), hashlib.sha256(data).hexdigest(), feature, s.seconds, len(s.offsets), s.offsets))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], [x.split()[0] for x in OUT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, OUT)


def op3_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every text in an MPEG audio stream, stored, read back and measured; with the seek table of its frames."""
    stored = cut(to_media(load(spark, sf_dir, "documents")), "media", compression="zstd")
    return read_media(stored)
