"""Sampled-signal containers: WAV, AIFF, AU, CAF and raw PCM, read from and written to binary columns.

Files come in through Spark's binary file source and go out as binary columns, so listing, splitting and retries are
Spark's. Damaged files give an error text instead of samples in the permissive mode that ``decode`` uses.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: numpy kinds of sample formats without their byte order (fixed values); 24-bit is packed by hand.
KINDS = {"u8": "u1", "s8": "i1", "s16": "i2", "s24": "i3", "s32": "i4", "f32": "f4", "f64": "f8"}
MAX_BYTES = 512 << 20


def sniff(content: Column) -> Column:
    """The container of bytes by their first ones; null if none is known."""
    at = lambda i, n: F.hex(F.substring(content, i, n))
    code = lambda s: s.encode().hex().upper()
    return (
        F.when(at(1, 4).isin(code("RIFF"), code("RF64"), code("BW64")) & (at(9, 4) == code("WAVE")), "wav")
        .when((at(1, 4) == code("FORM")) & at(9, 4).isin(code("AIFF"), code("AIFC")), "aiff")
        .when(at(1, 4) == code("caff"), "caf")
        .when(at(1, 4) == code(".snd"), "au")
        .when(at(1, 4) == code("fLaC"), "flac")
        .when((at(1, 4) == code("OggS")) & F.hex(F.substring(content, 1, 64)).contains(code("OpusHead")), "opus")
        .when(at(1, 4) == code("OggS"), "vorbis")
        .when(at(1, 3) == code("ID3"), "mp3")
        .when((at(1, 1) == "FF") & (F.conv(at(2, 1), 16, 10).cast("int").bitwiseAND(F.lit(0xE0)) == 0xE0), "mp3")
    )


def to_pcm(x: np.ndarray, kind: str, big: bool = False) -> bytes:
    """Interleaved samples (frames, channels) as bytes: rounded half away from zero and kept in range."""
    order = ">" if big else "<"
    if kind in ("f32", "f64"):
        return x.astype(order + KINDS[kind]).tobytes()
    bits = int(kind[1:])
    full = float(1 << (bits - 1))
    v = x.astype(np.float64) * full
    code = np.clip(np.sign(v) * np.floor(np.abs(v) + 0.5), -full, full - 1).astype(np.int64)
    if kind == "u8":
        return (code + 128).astype("u1").tobytes()
    if kind == "s24":
        wide = code.astype(order + "i4").view("u1").reshape(-1, 4)
        return (wide[:, 1:] if big else wide[:, :3]).tobytes()
    return code.astype(order + KINDS[kind]).tobytes()


def from_pcm(data: bytes, kind: str, channels: int, big: bool = False) -> np.ndarray:
    """(frames, channels) samples of whole frames; a part of one at the end is left out."""
    order, width = ">" if big else "<", int(kind[1:]) // 8
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8)
    if kind == "s24":
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, (slice(0, 3) if big else slice(1, 4))] = raw.reshape(-1, 3)
        x = wide.view(order + "i4").ravel().astype(np.float64) / (1 << 31)
    elif kind == "u8":
        x = (raw.astype(np.float64) - 128) / 128
    else:
        v = raw.view(order + KINDS[kind])
        x = v.astype(np.float64) if kind[0] == "f" else v.astype(np.float64) / (1 << (width * 8 - 1))
    return x.astype(np.float32).reshape(-1, channels)


def _extended(rate: float) -> bytes:
    """The 80-bit float that AIFF keeps rates in."""
    mantissa, exponent = np.frexp(rate)
    return struct.pack(">HQ", int(exponent) + 16382, int(mantissa * 2**64) & 0xFFFFFFFFFFFFFFFF)


def _from_extended(data: bytes) -> float:
    exponent, mantissa = struct.unpack(">HQ", data)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446)


def head(n: int, channels: int, rate: int, container: str, kind: str) -> bytes:
    """What stands before ``n`` frames of samples in a container; sizes beyond 32 bits make a WAV file of the wide form."""
    width = int(kind[1:]) // 8
    size = n * channels * width
    if container == "raw":
        return b""
    if container == "wav":
        if kind == "s8":
            raise ValueError("WAV keeps bytes unsigned")
        fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 3 if kind[0] == "f" else 1, channels, rate, rate * channels * width, channels * width, width * 8)
        if kind[0] == "f" and n <= 0xFFFFFFFF:  # codes that are not linear say how many frames there are
            fmt += b"fact" + struct.pack("<II", 4, n)
        whole = 4 + len(fmt) + 8 + size + size % 2
        if whole < 0xFFFFFFFF:
            return b"RIFF" + struct.pack("<I", whole) + b"WAVE" + fmt + b"data" + struct.pack("<I", size)
        wide = b"ds64" + struct.pack("<IQQQI", 28, whole + 36, size, n, 0)
        return b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + wide + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF)
    if container == "aiff":
        if kind in ("u8", "f64"):
            raise ValueError(f"AIFF does not keep {kind}")
        if size >= 0xFFFFFF00:
            raise ValueError("AIFF has no sizes beyond 32 bits")
        kind_of = b"" if kind[0] != "f" else b"fl32\x00\x00"
        comm = struct.pack(">hIh", channels, n, width * 8) + _extended(rate) + kind_of
        chunks = (b"FVER" + struct.pack(">II", 4, 0xA2805140) if kind_of else b"") + b"COMM" + struct.pack(">I", len(comm)) + comm
        return b"FORM" + struct.pack(">I", 4 + len(chunks) + 16 + size + size % 2) + (b"AIFC" if kind_of else b"AIFF") + chunks + b"SSND" + struct.pack(">III", size + 8, 0, 0)
    if container == "au":
        code = {"s8": 2, "s16": 3, "s24": 4, "s32": 5, "f32": 6, "f64": 7}[kind]
        return b".snd" + struct.pack(">IIIII", 28, min(size, 0xFFFFFFFF), code, rate, channels) + bytes(4)
    if container == "caf":
        desc = struct.pack(">d4sIIIII", float(rate), b"lpcm", 1 if kind[0] == "f" else 0, channels * width, 1, channels, width * 8)
        return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">qI", size + 4, 0)
    raise ValueError(f"no container {container}")


def body(x: np.ndarray, container: str, kind: str) -> bytes:
    """Samples (frames, channels) as they stand in a container."""
    return to_pcm(x, kind, big=container in ("aiff", "au", "caf"))


def tail(n: int, channels: int, container: str, kind: str) -> bytes:
    """What stands behind them: chunks have even sizes."""
    return bytes(n * channels * (int(kind[1:]) // 8) % 2) if container in ("wav", "aiff") else b""


def encode(x: np.ndarray, rate: int, container: str, kind: str) -> bytes:
    """Samples (frames, channels) in a container."""
    n, channels = x.shape
    return head(n, channels, rate, container, kind) + body(x, container, kind) + tail(n, channels, container, kind)


def _chunks(data: bytes, at: int, size: str, even: bool) -> Iterator[tuple[bytes, bytes]]:
    head = struct.Struct(size)
    while at + head.size <= len(data):
        name, n = head.unpack_from(data, at)
        at += head.size
        n = len(data) - at if n < 0 else n
        yield name, data[at : at + n]
        at += n + (n % 2 if even else 0)


def companded(kind: str) -> np.ndarray:
    """The 16-bit code of each byte of G.711 (biases and inverted bits are fixed values)."""
    byte = np.arange(256)
    raw = byte ^ (0xFF if kind == "ulaw" else 0x55)
    exponent, mantissa = raw >> 4 & 7, raw & 15
    if kind == "ulaw":
        size = (mantissa * 8 + 132 << exponent) - 132
        return np.where(raw & 128, -size, size)
    size = np.where(exponent == 0, mantissa * 16 + 8, mantissa * 16 + 264 << np.maximum(exponent - 1, 0))
    return np.where(raw & 128, size, -size)


#: Format tags of samples (fixed values), and what follows them where a tag stands in a longer identifier.
LINEAR, FLOAT, ALAW, ULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
SUBFORMAT = bytes.fromhex("000000001000800000aa00389b71")


def wav_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """All chunks in order; the size of a first data chunk of all ones is that of the ds64 chunk before it. A chunk that is
    longer than the file, or than what the file says of itself, is an error."""
    wide = data[:4] in (b"RF64", b"BW64")
    end = len(data) if wide else 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise ValueError("the file ends too soon")
    at, out, size64 = 12, [], None
    while at < end:
        if end - at < 8:
            raise ValueError("a chunk's head is cut off")
        name, n = struct.unpack_from("<4sI", data, at)
        if wide and name == b"data" and n == 0xFFFFFFFF:
            if size64 is None:
                raise ValueError("no ds64 chunk before the data")
            n = size64
        if n > end - at - 8:
            raise ValueError("a chunk is longer than its file")
        out.append((name, data[at + 8 : at + 8 + n]))
        if name == b"ds64":
            size64 = struct.unpack_from("<Q", out[-1][1], 8)[0]
        at += 8 + n + n % 2
    return out


def wav_tags(chunks: list[tuple[bytes, bytes]]) -> dict[str, str]:
    """The INFO tags by their four-letter names; of repeated ones the first."""
    tags: dict[str, str] = {}
    for name, body in chunks:
        if name == b"LIST" and body[:4] == b"INFO":
            for tag, value in _chunks(body, 4, "<4sI", True):
                tags.setdefault(tag.decode("ascii", "replace"), value.decode("utf-8").rstrip("\0"))
    return tags


def decode_wav(data: bytes) -> tuple[np.ndarray, int, str]:
    """All data chunks one after the other; a fact chunk says how many frames of them count for codes that are not linear."""
    chunks = wav_chunks(data)
    parts = dict(reversed(chunks))
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if tag == EXTENSIBLE:
        valid, = struct.unpack_from("<H", parts[b"fmt "], 18)
        if valid not in (0, bits) or parts[b"fmt "][26:40] != SUBFORMAT:
            raise ValueError("only whole samples of known formats")
        tag, = struct.unpack_from("<H", parts[b"fmt "], 24)
    kind = {LINEAR: "u8" if bits == 8 else f"s{bits}", FLOAT: f"f{bits}", ALAW: "alaw", ULAW: "ulaw"}.get(tag)
    if kind not in (*KINDS, "alaw", "ulaw") or kind == "s8" or channels == 0 or align != channels * ((bits + 7) // 8) or b"data" not in parts:
        raise ValueError(f"no samples of format {tag} with {bits} bits in {channels} channels")
    body = b"".join(body for name, body in chunks if name == b"data")
    if len(body) % align:
        raise ValueError("a frame is cut off")
    if kind[0] != "a" and kind != "ulaw":
        x = from_pcm(body, kind, channels)
        if not np.isfinite(x).all():
            raise ValueError("a sample is not finite")
        return x, rate, kind
    x = (companded(kind)[np.frombuffer(body, np.uint8)] / 32768).astype(np.float32).reshape(-1, channels)
    return x[: struct.unpack_from("<I", parts[b"fact"])[0]] if len(parts.get(b"fact", b"")) >= 4 else x, rate, kind


def decode(data: bytes) -> tuple[np.ndarray, int, str]:
    """(samples, rate, kind) of a container's bytes."""
    if data[:4] in (b"RIFF", b"RF64", b"BW64") and data[8:12] == b"WAVE":
        return decode_wav(data)
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        parts = dict(reversed(list(_chunks(data, 12, ">4sI", True))))
        channels, n, bits = struct.unpack_from(">hIh", parts[b"COMM"])
        rate, coding = _from_extended(parts[b"COMM"][8:18]), parts[b"COMM"][18:22]
        named = {b"fl32": "f32", b"fl64": "f64", b"alaw": "alaw", b"ulaw": "ulaw"}
        kind = named.get(coding.lower(), f"s{(bits + 7) // 8 * 8}")
        body = parts[b"SSND"][8 + struct.unpack_from(">I", parts[b"SSND"])[0] :]
        if kind in ("alaw", "ulaw"):
            return (companded(kind)[np.frombuffer(body, np.uint8)] / 32768).astype(np.float32).reshape(-1, channels)[:n], round(rate), kind
        return from_pcm(body, kind, channels, coding != b"sowt")[:n], round(rate), kind
    if data[:4] == b".snd":
        start, size, code, rate, channels = struct.unpack_from(">IIIII", data, 4)
        kind = {2: "s8", 3: "s16", 4: "s24", 5: "s32", 6: "f32", 7: "f64"}[code]
        body = data[start:] if size == 0xFFFFFFFF else data[start : start + size]
        return from_pcm(body, kind, channels, big=True), rate, kind
    if data[:4] == b"caff":
        parts = dict(reversed(list(_chunks(data, 8, ">4sq", False))))
        rate, coding, flags, _, _, channels, bits = struct.unpack(">d4sIIIII", parts[b"desc"])
        if coding != b"lpcm":
            raise ValueError("only linear samples")
        kind = f"f{bits}" if flags & 1 else f"s{bits}"
        return from_pcm(parts[b"data"][4:], kind, channels, big=not flags & 2), round(rate), kind
    raise ValueError("no known container")


def encode_clips(clips: DataFrame, container: str, kind: str, rate: int) -> DataFrame:
    """(clip, content): clips (clip, channel, samples) as files; channels of a clip meet in one row."""
    rows = clips.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("_all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode(np.stack([np.array(c["samples"], np.float32) for c in row], 1), rate, container, kind) for row in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], ["clip", "content"])

    return rows.select("clip", "_all").mapInArrow(run, "clip bigint, content binary")


def decode_files(files: DataFrame, key: str = "clip") -> DataFrame:
    """(key, rate, kind, frames, channels array<array<float>>, tags, error) of each file's bytes; null samples where it failed."""
    key_type = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    x, rate, kind = decode(data or b"")
                    tags = wav_tags(wav_chunks(data)) if data[8:12] == b"WAVE" else {}
                    rows.append((rate, kind, len(x), [c.tolist() for c in x.T], list(tags.items()), None))
                except (ValueError, KeyError, struct.error) as bad:
                    rows.append((None, None, None, None, None, f"{type(bad).__name__}: {bad}"))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.float32())), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["key", "rate", "kind", "frames", "channels", "tags", "error"])

    return files.select(key, "content").mapInArrow(run, f"key {key_type}, rate int, kind string, frames bigint, channels array<array<float>>, tags map<string,string>, error string").withColumnRenamed("key", key)


def read_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Decoded files below a path; the size cap reaches the source, larger files are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode_files(files.where(F.col("length") <= max_bytes), "path")
