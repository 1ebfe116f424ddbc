"""Media columns: Ogg bitstreams written, read back and described.

``write`` stores bytes as 8-bit samples in a logical stream of packets and a
note beside it in a second logical stream, both multiplexed into pages.
``read`` walks the pages, verifies every page's checksum, reassembles packets
from lacing values (also across pages), separates the logical streams by serial
number and derives each packet's time from the granule positions.

A null text is the empty text.  Texts of any length are stored whole.  Equal
texts give equal values: nothing but the text enters the stored form.  A stream
that breaks a rule of the format raises ``BadStream`` in ``read``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the page format: header layout, flags.
HEADER = struct.Struct("<4sBBqIIIB")
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
SAMPLES, NOTE = 1, 2  # serial numbers
SAMPLES_HEAD, NOTE_HEAD = b"\x01samples8", b"\x01note"
RATE = 8000
PACKET = 4096
UNIT = 64

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class BadStream(ValueError):
    """The bytes are not a valid bitstream."""


def page_crc(data: bytes) -> int:
    """The page checksum: CRC-32 of polynomial 0x04C11DB7, unreflected, without inversions.

    zlib's CRC is the mirrored one with inversions, so bytes go in mirrored, the
    inversions cancel and the result is mirrored back.
    """
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


class _Logical:
    """Packets of one logical stream put into pages."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """Pages of packets, each with the granule position at its end."""
        lacing, body, granule, flags = bytearray(), [], -1, 0
        for k, (packet, at) in enumerate(packets):
            left, pos = divmod(len(packet), 255)[0] + 1, 0
            while left:
                take = min(left, 255 - len(lacing))
                ends = take == left
                lacing += b"\xff" * (take - ends)
                if ends:
                    lacing.append(len(packet) % 255)
                cut = len(packet) if ends else pos + 255 * take
                body.append(packet[pos:cut])
                pos, left = cut, left - take
                if ends:
                    granule = at
                if len(lacing) == 255 or ends and k == len(packets) - 1:
                    final = last and ends and k == len(packets) - 1
                    yield self._page(flags | LAST * final, granule, lacing, body)
                    lacing, body, granule, flags = bytearray(), [], -1, 0 if ends else CONTINUED

    def _page(self, flags: int, granule: int, lacing: bytearray, body: list[bytes]) -> bytes:
        flags |= FIRST * (self.number == 0)
        head = HEADER.pack(CAPTURE, 0, flags, granule, self.serial, self.number, 0, len(lacing))
        self.number += 1
        whole = b"".join((head, lacing, *body))
        return whole[:22] + page_crc(whole).to_bytes(4, "little") + whole[26:]


def write(payload: bytes, note: bytes = b"") -> bytes:
    """A bitstream that holds ``payload`` as 8-bit samples and ``note`` beside it."""
    sound, text = _Logical(SAMPLES), _Logical(NOTE)
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    return b"".join(
        [
            *sound.pages([(SAMPLES_HEAD + RATE.to_bytes(4, "little"), 0)], not packets),
            *text.pages([(NOTE_HEAD, 0)], False),
            *text.pages([(note, 0)], True),
            *sound.pages(packets, True),
        ]
    )


@dataclass
class Stream:
    """One logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position known at each packet's end, or -1
    n_pages: int = 0
    ended: bool = False
    part: list[bytes] | None = None


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, their packets whole and in order."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise BadStream("a page header is cut off")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise BadStream(f"no page at byte {at}")
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise BadStream("a page is cut off")
        if page_crc(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise BadStream(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise BadStream("a stream without a first page")
            s = streams[serial] = Stream(serial)
        elif flags & FIRST or s.ended:
            raise BadStream("pages out of place")
        if number != s.n_pages or bool(flags & CONTINUED) != (s.part is not None):
            raise BadStream("a page is missing")
        part = s.part or []
        pos, open_ = start, s.part is not None
        size = 0
        for lace in lacing:
            size += lace
            open_ = True
            if lace < 255:
                part.append(data[pos : pos + size])
                s.packets.append(b"".join(part) if len(part) > 1 else part[0])
                s.ends.append(-1)
                part, pos, size, open_ = [], pos + size, 0, False
        if open_:
            part.append(data[pos : pos + size])
        s.part = part if open_ else None
        if granule >= 0 and s.packets:
            s.ends[-1] = granule
        s.n_pages += 1
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.part is not None or not s.ended:
            raise BadStream("a stream does not end")
    return streams


def times(s: Stream) -> list[float]:
    """Seconds at the end of each sample packet.

    A page gives the position at the end of its last packet only; those before
    it follow by counting back the samples of the packets between.
    """
    rate = int.from_bytes(s.packets[0][len(SAMPLES_HEAD) :][:4], "little")
    ends = list(s.ends[1:])
    sizes = [len(p) for p in s.packets[1:]]
    for k in range(len(ends) - 2, -1, -1):
        if ends[k] < 0:
            ends[k] = ends[k + 1] - sizes[k + 1]
    return [e / rate for e in ends]


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, Stream]:
    """The stored samples; the stream is found by its head packet, not by its number."""
    for s in streams.values():
        if s.packets and s.packets[0].startswith(SAMPLES_HEAD):
            data = b"".join(s.packets[1:])
            if max(s.ends[-1], 0) != len(data):
                raise BadStream("granule positions and samples differ")
            return data, s
    raise BadStream("no stream of samples")


def describe(samples: bytes, s: Stream) -> str:
    """Duration, loudness, zero crossings and the stream's make-up in a line."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    level = float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    t = times(s)
    return f"seconds={t[-1] if t else 0.0:.6f};rms={level:.4f};mean={float(x.mean()) if len(x) else 0.0:.4f};crossings={crossings};packets={len(t)};pages={s.n_pages}"


def pad(text: bytes) -> bytes:
    """Zeros up to a positive multiple of the unit."""
    return text + bytes(-len(text) % UNIT or UNIT * (not text))


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the column ``media`` with each text's bitstream; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                out.append(write(pad(raw), len(raw).to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary")


def inspect_media(stored: DataFrame) -> DataFrame:
    """Digests and features of ``media`` columns, from the stored bytes alone; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                streams = read(m)
                data, s = payload_of(streams)
                note = next(x.packets[1] for x in streams.values() if x.packets[0] == NOTE_HEAD)
                rows.append((int.from_bytes(note, "little"), len(data), sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(m), sha256(m).hexdigest(), describe(data, s)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
