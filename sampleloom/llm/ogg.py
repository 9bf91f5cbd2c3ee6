"""Ogg media columns: multiplex payloads into Ogg, and verify, reassemble, demultiplex and time what is stored.

Each payload becomes ``STREAMS`` logical streams of unsigned 8-bit samples. Packets are dealt to the streams in
turn, cut into lacing values, laid into pages of at most 255 segments (packets may continue on later pages) and
protected by the container's checksum. Reading verifies every page, skips to the next capture pattern after a
damaged one, reassembles packets, separates the logical streams, derives packet times from granule positions, and counts
what is damaged or missing, a lost end as well as a lost page. A payload that comes back shorter than it was stored counts
as a fault of its own.

Null payloads count as empty; an empty text gives one block of 64 zero bytes. Equal texts give equal bytes: serial
numbers come from the stream's position, not from the row. Repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts_of

STREAMS = 2
PACKET_BYTES = 4096
RATE = 8000
BLOCK = 64
MAGIC = b"\x7fPCM8"
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<5sBBIIQ")  # magic, stream, streams, rate, packet bytes, bytes of the whole payload before padding
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, most significant bit first, from 0: the mirror image of zlib's, over mirrored bytes."""
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(head: bytes, packets: list[bytes], serial: int) -> Iterator[tuple[int, bytes]]:
    """The pages of one logical stream with the granule position by which they are interleaved."""
    yield -1, _page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(head)]), head)
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    ends, done, at = [i for i, x in enumerate(lacing) if x < 255], 0, 0
    granules = np.cumsum([len(p) for p in packets]).tolist()
    for number, i in enumerate(range(0, len(lacing), 255), 1):
        part = lacing[i : i + 255]
        inside = done
        while inside < len(ends) and ends[inside] < i + len(part):
            inside += 1
        granule = granules[inside - 1] if inside > done else -1
        flags = (CONTINUED if i and lacing[i - 1] == 255 else 0) | (LAST if i + 255 >= len(lacing) else 0)
        size = sum(part)
        yield granules[inside - 1] if inside else 0, _page(flags, granule, serial, number, part, body[at : at + size])
        at, done = at + size, inside


def mux(payload: bytes, n_bytes: int | None = None, streams: int = STREAMS, packet_bytes: int = PACKET_BYTES) -> bytes:
    """Stores a payload as multiplexed logical streams; first pages come first, then pages in order of time."""
    packets = [payload[i : i + packet_bytes] for i in range(0, len(payload), packet_bytes)]
    pages = []
    for k in range(streams):
        head = _HEAD.pack(MAGIC, k, streams, RATE, packet_bytes, len(payload) if n_bytes is None else n_bytes)
        pages += [(granule, k, j, page) for j, (granule, page) in enumerate(_stream_pages(head, packets[k::streams], 1 + k))]
    return b"".join(x[3] for x in sorted(pages, key=lambda x: x[:3]))


def pages(media: bytes) -> tuple[list[tuple[dict, memoryview]], int]:
    """Header fields and body of every page whose checksum holds, and how many stretches of other bytes stand before,
    between and behind them."""
    found, at, end, stretches, view = [], 0, 0, 0, memoryview(media)
    while (at := media.find(b"OggS", at)) >= 0:
        if at + 27 <= len(media):
            _, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            over = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and over <= len(media) and page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : over]) == crc:
                found.append(({"flags": flags, "granule": granule, "serial": serial, "number": number, "lacing": lacing}, view[at + 27 + n : over]))
                stretches += at > end
                at = end = over
                continue
        at += 4
    return found, stretches + (end < len(media))


def demux(media: bytes) -> tuple[dict[int, list[tuple[int, int, bytes]]], int, int]:
    """Packets of each serial as (first sample, end sample, bytes), the number of sound pages, and of faults.

    Faults are stretches of bytes that are no sound page, also behind the last one, gaps in a stream's page numbers,
    streams without a last page or with pages behind it, and packets that are still open at the end. A packet that
    misses a part is dropped. A page's granule position is the end of its last complete packet; the ends of the packets
    before follow from their lengths.
    """
    found: dict[int, list[tuple[int, int, bytes]]] = {}
    open_parts: dict[int, list | None] = {}
    expected: dict[int, int] = {}
    over: dict[int, bool] = {}
    sound, damaged = pages(media)
    for head, body in sound:
        serial = head["serial"]
        part = open_parts.pop(serial, None)
        if head["number"] != expected.get(serial, 0):
            damaged, part = damaged + 1, None
        damaged += over.get(serial, False)
        expected[serial], over[serial] = head["number"] + 1, bool(head["flags"] & LAST)
        if not head["flags"] & CONTINUED:
            part = []
        whole, at, size = [], 0, 0
        for lace in head["lacing"]:
            size += lace
            if lace < 255:
                if part is not None:
                    part.append(body[at : at + size])
                    whole.append(b"".join(part))
                at, size, part = at + size, 0, []
        if size or (head["lacing"] and head["lacing"][-1] == 255):
            if part is not None:
                part.append(body[at : at + size])
            open_parts[serial] = part
        end = head["granule"]
        timed = []
        for p in reversed(whole):
            start = end - (0 if head["flags"] & FIRST else len(p))
            timed.append((start, end, p))
            end = start
        if timed:
            found.setdefault(serial, []).extend(reversed(timed))
    damaged += sum(not last for last in over.values()) + len(open_parts)
    return found, len(sound), damaged


def payload_of(streams: dict[int, list[tuple[int, int, bytes]]]) -> tuple[bytes, int]:
    """The payload and its length before padding, from the demultiplexed streams; streams without their head are left out."""
    dealt, n_bytes = {}, 0
    for packets in streams.values():
        if len(packets[0][2]) != _HEAD.size or packets[0][2][:5] != MAGIC:
            continue  # its first page was lost
        _, k, _, _, _, n_bytes = _HEAD.unpack(packets[0][2])
        dealt[k] = [p for _, _, p in packets[1:]]
    rounds = max((len(x) for x in dealt.values()), default=0)
    return b"".join(dealt[k][i] for i in range(rounds) for k in sorted(dealt) if i < len(dealt[k])), n_bytes


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def feature_of(payload: bytes, streams: dict[int, list[tuple[int, int, bytes]]], sound: int, damaged: int) -> str:
    """Structure, duration and level of what was read, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    seconds = max((p[-1][1] for p in streams.values()), default=0) / RATE
    packets = sum(len(p) - 1 for p in streams.values())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    square = int((x * x).sum())
    return f"streams={len(streams)};pages={sound};damaged={damaged};packets={packets};seconds={seconds:.6f};sum={int(x.sum())};square={square};crossings={crossings}"


def mux_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): every whole text as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([mux(*padded(t)) for t in texts_of(b, text)], pa.binary())], ["key", "media"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, media binary").withColumnRenamed("key", key)


def demux_packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, serial, packet, start_s, end_s, data): every packet of every logical stream with its times; the header packet is number 0."""
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, s, i, a / RATE, e / RATE, p) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, ps in sorted(demux(m or b"")[0].items()) for i, (a, e, p) in enumerate(ps)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.binary())], ["key", "serial", "packet", "start_s", "end_s", "data"])

    return media.select(key, "media").mapInArrow(run, f"key {kind}, serial bigint, packet int, start_s double, end_s double, data binary").withColumnRenamed("key", key)


def media_digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per media value: digests and features of the payload that is read back from the stored bytes."""
    kind = dict(media.dtypes)[key]
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages", "n_damaged"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                m = m or b""
                streams, sound, damaged = demux(m)
                payload, n = payload_of(streams)
                damaged += len(payload) < max(n, 1)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(payload, streams, sound, damaged), sound, damaged))
            cols = list(zip(*rows)) or [[]] * 9
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names)

    return media.select(key, "media").mapInArrow(run, f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages bigint, n_damaged bigint").withColumnRenamed("key", key)


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back."""
    small_batches(spark)
    return media_digests(mux_texts(table(spark, sf_dir, "documents")))
