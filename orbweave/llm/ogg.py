"""Media columns: Ogg files in a binary column.

``mux`` lays packets of several logical streams into pages: lacing values, sequence numbers, checksums,
granule positions, beginning and end flags, packets continued from page to page. ``demux`` reads them back:
it finds page by page at the capture pattern, verifies the checksum, splits the body by its lacing values,
joins continued packets per serial number, and derives each packet's end position from the page's granule
position. A page with a wrong checksum is skipped and counted; the packet that it would have continued is lost.

A text is stored as two logical streams: its UTF-8 bytes, padded with zeros to a positive multiple of 64, as
8-bit PCM samples ("PCM in Ogg": a header packet, then packets of at most ``FRAME`` samples), and a stream
with its unpadded length. Serial numbers are fixed, so equal texts give equal files.

Nulls are empty texts (64 zero samples). ``read`` gives nulls for null media and zero streams for bytes without
a page. Other columns are neither read nor returned; the id column may have any type and any values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import map_chunks, text_bytes

PAD = 64
RATE = 8_000
FRAME = 4_096
AUDIO, LENGTH = 1, 2
#: Magic numbers of the two kinds of streams.
PCM_MAGIC, LENGTH_MAGIC = b"PCM     ", b"txtlen\0\0"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, from 0 and without a final xor: zlib's over bit-reversed bytes, reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream; the first packet has a page of its own, as codecs' headers do."""
    out: list[bytes] = []
    lacing, body, granule, carried = bytearray(), [], -1, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule
        flags = carried | 2 * (not out) | 4 * last
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(lacing)) + lacing
        page = head + b"".join(body)
        out.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])
        lacing, body, granule = bytearray(), [], -1

    for k, (data, position) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(False)
                carried = at > 0
                continue
            part, values = values[:room], values[room:]
            lacing += bytes(part)
            body.append(data[at : at + sum(part)])
            at += sum(part)
        granule = position
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
            carried = False
        elif len(lacing) == 255:
            flush(False)
            carried = False
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """A physical stream of packets with their end positions by serial number: first pages first, then a page of each in turn."""
    paged = [_pages(s, p) for s, p in streams.items() if p]
    first, rest = [p[0] for p in paged], [p[1:] for p in paged]
    for i in range(max(map(len, rest), default=0)):
        first += [p[i] for p in rest if i < len(p)]
    return b"".join(first)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end where its page gives one: for the last packet that ends on a page.
    ends: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    closed: bool = False
    _next: int = 0
    _open: bytes | None = None


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many places looked like a page but failed its checksum or length."""
    streams: dict[int, Stream] = {}
    at, bad = data.find(b"OggS"), 0
    while at >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(b"OggS", at + 1)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next:
            s.lost += max(0, number - s._next)
            s._open = None
        s._next, s.pages, s.closed = number + 1, s.pages + 1, bool(flags & 4)
        part, skip = (s._open or b""), bool(flags & 1) and s._open is None
        begin = place = 27 + n
        done = []
        for value in lacing:
            place += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    done.append(part + page[begin:place])
                part, begin = b"", place
        s._open = part + page[begin:place] if lacing and lacing[-1] == 255 and not skip else None
        s.packets += done
        s.ends += [None] * (len(done) - 1) + [granule if granule >= 0 else None] if done else []
        at = data.find(b"OggS", end)
    return streams, bad


def positions(stream: Stream, durations: list[int]) -> list[int | None]:
    """End positions of all packets: of those within a page, from the page's granule position back, else onward from the packet before."""
    out: list[int | None] = list(stream.ends)
    for i in range(len(out) - 2, -1, -1):
        if out[i] is None and out[i + 1] is not None:
            out[i] = out[i + 1] - durations[i + 1]
    for i in range(1, len(out)):
        if out[i] is None and out[i - 1] is not None:
            out[i] = out[i - 1] + durations[i]
    return out


def encode_text(data: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    samples = data + bytes(-len(data) % PAD or (0 if data else PAD))
    # magic, major, minor, format (1: unsigned 8 bits), rate, bits, channels, frames in a packet, extra headers
    header = PCM_MAGIC + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, frame, 0)
    audio = [(header, 0), *((samples[i : i + frame], min(i + frame, len(samples))) for i in range(0, len(samples), frame))]
    return mux({AUDIO: audio, LENGTH: [(LENGTH_MAGIC, 0), (struct.pack(">Q", len(data)), 0)]})


@dataclass
class Audio:
    samples: bytes
    rate: int
    #: Seconds at each packet's end.
    times: list[float | None]
    length: int | None
    pages: int
    streams: int
    bad: int


def decode_audio(data: bytes) -> Audio | None:
    """The first PCM stream, and the text's length if a stream has it; None if there is no such stream."""
    streams, bad = demux(data)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(PCM_MAGIC) and len(s.packets[0]) >= 28), None)
    if audio is None:
        return None
    length = next((struct.unpack(">Q", s.packets[1])[0] for s in streams.values() if s.packets[0:1] == [LENGTH_MAGIC] and len(s.packets) > 1 and len(s.packets[1]) == 8), None)
    _, _, kind, rate, bits, channels, _, _ = struct.unpack_from(">HHIIBBHI", audio.packets[0], 8)
    if kind != 1 or bits != 8 or not rate or not channels:
        return None
    ends = positions(audio, [0, *(len(p) // channels for p in audio.packets[1:])])
    return Audio(b"".join(audio.packets[1:]), rate, [None if e is None else e / rate for e in ends[1:]], length, sum(s.pages for s in streams.values()), len(streams), bad)


def features(audio: Audio) -> str:
    """Duration by the granule positions and by the samples, level, sign changes about the middle, and the container's shape."""
    x = np.frombuffer(audio.samples, np.uint8)
    n = max(1, len(x))
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(f := x.astype(np.float64), f))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    last = next((t for t in reversed(audio.times) if t is not None), 0.0)
    return f"rate={audio.rate};seconds={last:.6f};samples={len(x)};packets={len(audio.times)};pages={audio.pages};streams={audio.streams};bad={audio.bad};mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};crossings={crossings}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``media``, the Ogg file of every row's text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_text(t) for t in text_bytes(batch.column(1))], pa.binary())], [id_col, "media"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, media binary", text_col)


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, seconds double, bad_pages int, feature string"


def read(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id and what the stored bytes hold: lengths, digests, duration, damaged pages and ``feature``."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in READ.split(", ")]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        audio = decode_audio(media)
        if audio is None:
            return (None, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, demux(media)[1], None)
        return (audio.length, len(audio.samples), hashlib.sha256(audio.samples).hexdigest(), zlib.crc32(audio.samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), audio.times[-1] if audio.times else 0.0, audio.bad, features(audio))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(m) for m in batch.column(1).to_pylist()]
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], types[x.split()[1]]) for k, x in enumerate(READ.split(", ")))], [id_col, *names])

    return map_chunks(df.select(id_col, media_col), run, f"`{id_col}` {kind}, {READ}", media_col)
