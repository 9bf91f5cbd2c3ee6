"""Sampled files as a Spark data source: ``spark.read.format("sampled")`` and ``df.write.format("sampled")``.

Reading deals a file by ranges of its frames, so a file of any size is the work of many tasks, each of which reads the
file's heads and its own bytes. The driver lists files and sizes. Filters on ``path``, ``channel`` and ``frame`` reach the
source: files and ranges that hold nothing wanted are not read, and other channels are not decoded into rows.

Writing takes long frames that ``write_clips`` deals by clip, in order, so that a clip streams into its file whatever its
length. Tasks write below a folder of the job and say what they wrote; the files get their names when all tasks are done,
those of failed and repeated attempts never do.

Files are opened through Arrow's file systems: local paths, and remote ones that Arrow knows. ``containers.read_files``
reads small files from any store that Spark reads.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import containers
from .containers import ALAW, EXTENSIBLE, FLOAT, KINDS, LINEAR, SUBFORMAT, ULAW

SCHEMA = "path string, rate int, channel int, frame bigint, sample float"
#: Bytes of files that are one task's, those that opening a file counts as, and frames that are decoded at once.
SPLIT_BYTES, OPEN_BYTES, STEP = 64 << 20, 256 << 10, 1 << 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Layout:
    """Where the samples of a file stand: runs of bytes that follow each other."""

    rate: int
    channels: int
    kind: str
    big: bool
    runs: list[tuple[int, int]]
    most: int | None = None

    @property
    def width(self) -> int:
        return self.channels * (1 if self.kind in ("alaw", "ulaw") else int(self.kind[1:]) // 8)

    @property
    def frames(self) -> int:
        n = sum(size for _, size in self.runs) // self.width
        return n if self.most is None else min(n, self.most)

    def samples(self, read: Callable[[int, int], bytes], first: int, end: int) -> np.ndarray:
        """(frames, channels) of the frames from ``first`` to ``end``."""
        lo, hi, at, parts = first * self.width, end * self.width, 0, []
        for offset, size in self.runs:
            a, e = max(lo, at), min(hi, at + size)
            if a < e:
                parts.append(read(offset + a - at, e - a))
            at += size
        data = b"".join(parts)
        if len(data) != hi - lo:
            raise ValueError("the file ends too soon")
        if self.kind in ("alaw", "ulaw"):
            return (containers.companded(self.kind)[np.frombuffer(data, np.uint8)] / 32768).astype(np.float32).reshape(-1, self.channels)
        return containers.from_pcm(data, self.kind, self.channels, self.big)


def _heads(read: Callable[[int, int], bytes], at: int, end: int, form: str, even: bool) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, size) of each chunk; a size below zero reaches to the end."""
    head = struct.Struct(form)
    while at + head.size <= end:
        name, n = head.unpack(read(at, head.size))
        at += head.size
        n = end - at if n < 0 else n
        yield name, at, n
        at += n + (n % 2 if even else 0)


def _wav(read: Callable[[int, int], bytes], size: int) -> Layout:
    wide = read(0, 4) in (b"RF64", b"BW64")
    runs, fmt, fact, size64 = [], b"", b"", None
    at, end = 12, size if wide else min(size, 8 + struct.unpack("<I", read(4, 4))[0])
    while at + 8 <= end:
        name, n = struct.unpack("<4sI", read(at, 8))
        at += 8
        if wide and name == b"data" and n == 0xFFFFFFFF:
            if size64 is None:
                raise ValueError("no ds64 chunk before the data")
            n = size64
        if at + n > end:
            raise ValueError("a chunk is longer than its file")
        if name == b"ds64":
            size64 = struct.unpack("<Q", read(at + 8, 8))[0]
        elif name == b"fmt ":
            fmt = read(at, n)
        elif name == b"fact":
            fact = read(at, n)
        elif name == b"data":
            runs.append((at, n))
        at += n + n % 2
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", fmt)
    if tag == EXTENSIBLE:
        if struct.unpack_from("<H", fmt, 18)[0] not in (0, bits) or fmt[26:40] != SUBFORMAT:
            raise ValueError("only whole samples of known formats")
        tag = struct.unpack_from("<H", fmt, 24)[0]
    kind = {LINEAR: "u8" if bits == 8 else f"s{bits}", FLOAT: f"f{bits}", ALAW: "alaw", ULAW: "ulaw"}.get(tag)
    if kind not in (*KINDS, "alaw", "ulaw") or kind == "s8" or not channels or align != channels * ((bits + 7) // 8) or not runs:
        raise ValueError(f"no samples of format {tag} with {bits} bits in {channels} channels")
    most = struct.unpack_from("<I", fact)[0] if kind in ("alaw", "ulaw") and len(fact) >= 4 else None
    return Layout(rate, channels, kind, False, runs, most)


def _aiff(read: Callable[[int, int], bytes], size: int) -> Layout:
    found = {}
    for name, at, n in _heads(read, 12, size, ">4sI", True):
        found.setdefault(name, (at, n))
    comm = read(*found[b"COMM"])
    channels, frames, bits = struct.unpack_from(">hIh", comm)
    coding = comm[18:22]
    kind = {b"fl32": "f32", b"FL32": "f32", b"fl64": "f64", b"FL64": "f64", b"alaw": "alaw", b"ALAW": "alaw", b"ulaw": "ulaw", b"ULAW": "ulaw"}.get(coding, f"s{(bits + 7) // 8 * 8}")
    if channels < 1 or coding not in (b"", b"NONE", b"twos", b"sowt") and kind[0] == "s":
        raise ValueError(f"no samples of coding {coding!r}")
    at, n = found[b"SSND"]
    skip = 8 + struct.unpack(">I", read(at, 4))[0]
    return Layout(round(containers._from_extended(comm[8:18])), channels, kind, coding != b"sowt", [(at + skip, n - skip)], frames)


def _au(read: Callable[[int, int], bytes], size: int) -> Layout:
    start, n, code, rate, channels = struct.unpack(">IIIII", read(4, 20))
    kind = {1: "ulaw", 2: "s8", 3: "s16", 4: "s24", 5: "s32", 6: "f32", 7: "f64", 27: "alaw"}[code]
    return Layout(rate, channels, kind, True, [(start, min(n, size - start) if n != 0xFFFFFFFF else size - start)])


def _caf(read: Callable[[int, int], bytes], size: int) -> Layout:
    found = {}
    for name, at, n in _heads(read, 8, size, ">4sq", False):
        found.setdefault(name, (at, n))
    rate, coding, flags, _, _, channels, bits = struct.unpack(">d4sIIIII", read(*found[b"desc"]))
    kind = {b"lpcm": f"f{bits}" if flags & 1 else f"s{bits}", b"alaw": "alaw", b"ulaw": "ulaw"}.get(coding)
    if kind not in (*KINDS, "alaw", "ulaw"):
        raise ValueError(f"no samples of coding {coding!r}")
    at, n = found[b"data"]
    return Layout(round(rate), channels, kind, not flags & 2, [(at + 4, n - 4)])


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The layout of a file, from its heads alone."""
    first = read(0, min(12, size))
    try:
        if first[:4] in (b"RIFF", b"RF64", b"BW64") and first[8:] == b"WAVE":
            return _wav(read, size)
        if first[:4] == b"FORM" and first[8:] in (b"AIFF", b"AIFC"):
            return _aiff(read, size)
        if first[:4] == b".snd":
            return _au(read, size)
        if first[:4] == b"caff":
            return _caf(read, size)
    except (KeyError, struct.error) as bad:
        raise ValueError(f"a head is missing or cut off: {bad}") from bad
    raise ValueError("no known container")


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    """Shares of files: (path, size, k, n) is the k-th of n equal shares of a file's frames."""

    shares: list[tuple[str, int, int, int]]


class SampledReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split, self.open = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("openbytes", OPEN_BYTES))
        self.raw = (int(options.get("rate", 0)), int(options.get("channels", 1)), options["kind"]) if "kind" in options else None
        self.only: list[int] | None = sorted({int(c) for c in options["channel"].split(",")}) if "channel" in options else None
        self.first, self.end, self.paths = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("frame",) and isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            elif column in (("channel",), ("path",)) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if column == ("path",):
                    self.paths = wanted if self.paths is None else self.paths & wanted
                else:
                    self.only = sorted(wanted if self.only is None else wanted & set(self.only))
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in PurePosixPath(p).relative_to(path).parts)
        files = sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path) and (self.paths is None or f.path in self.paths))
        out, held = [Part([])], 0
        for name, size in files:
            n = max(1, -(-size // self.split))
            for k in range(n):
                cost = size // n + self.open
                if out[-1].shares and held + cost > self.split:
                    out.append(Part([]))
                    held = 0
                out[-1].shares.append((name, size, k, n))
                held += cost
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        for share in part.shares if self.only != [] else ():
            yield from self._share(system, *share)

    def _share(self, system: arrow_fs.FileSystem, path: str, size: int, k: int, n: int) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(path) as file:

            def read(at: int, many: int) -> bytes:
                file.seek(at)
                return file.read(many)

            if self.raw:
                rate, channels, kind = self.raw
                found = Layout(rate, channels, kind, False, [(0, size)])
            else:
                found = layout(read, size)
            lo, hi = max(self.first, found.frames * k // n), found.frames * (k + 1) // n
            hi = hi if self.end is None else min(hi, self.end)
            wanted = [c for c in (range(found.channels) if self.only is None else self.only) if 0 <= c < found.channels]
            for a in range(lo, hi if wanted else lo, STEP):
                e = min(hi, a + STEP)
                x = found.samples(read, a, e)[:, wanted]
                rows, frames = x.size, np.repeat(np.arange(a, e), len(wanted))
                yield pa.record_batch(
                    [pa.array([path]).take(pa.array(np.zeros(rows, np.int32))), pa.array(np.full(rows, found.rate, np.int32)), pa.array(np.tile(np.array(wanted, np.int32), e - a)), pa.array(frames), pa.array(x.ravel())],
                    ["path", "rate", "channel", "frame", "sample"],
                )


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SampledWriter(DataSourceArrowWriter):
    """Rows (clip, frames, channels, channel, frame, sample), each clip's together and in order of frame and channel."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.container, self.kind, self.rate = options.get("container", "wav"), options.get("kind", "s16"), int(options["rate"])
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _opened(self.path)
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(folder, recursive=True)
        done, out, clip, held, left, shape = [], None, None, np.zeros(0, np.float32), 0, (0, 0)

        def finish():
            if left or len(held):
                raise ValueError(f"clip {clip} has other frames than it says")
            out.write(containers.tail(*shape, self.container, self.kind))
            out.close()

        for b in iterator:
            if not b.num_rows:
                continue
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            clips = col["clip"].to_pylist()
            starts = [0, *(i for i in range(1, len(clips)) if clips[i] != clips[i - 1])]
            x = col["sample"].to_numpy(zero_copy_only=False)
            place = col["frame"].to_numpy() * col["channels"].to_numpy() + col["channel"].to_numpy()
            for a, e in zip(starts, [*starts[1:], len(clips)]):
                if out is None or clips[a] != clip:
                    if out is not None:
                        finish()
                    clip, shape = clips[a], (col["frames"][a].as_py(), col["channels"][a].as_py())
                    left, held = shape[0] * shape[1], held[:0]
                    name = f"{folder}/{clip}.{self.container}"
                    done.append((name, f"{base}/{clip}.{self.container}"))
                    out = system.open_output_stream(name)
                    out.write(containers.head(*shape, self.rate, self.container, self.kind))
                if (place[a:e] != np.arange(e - a) + shape[0] * shape[1] - left).any():
                    raise ValueError(f"clip {clip} has frames that are missing, twice or out of order")
                left -= e - a
                held = np.concatenate([held, x[a:e]])
                whole = len(held) // shape[1] * shape[1]
                out.write(containers.body(held[:whole].reshape(-1, shape[1]), self.container, self.kind))
                held = held[whole:]
        if out is not None:
            finish()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, base = _opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for info in system.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True)):
                if info.base_name != self.job:
                    system.delete_dir(info.path) if info.type == arrow_fs.FileType.Directory else system.delete_file(info.path)
        for made, name in files:
            system.move(made, name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, base = _opened(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class SampledSource(DataSource):
    """Options to read: path (a file or a folder), splitBytes, openBytes, channel (a list of those wanted); for files without a head kind,
    rate and channels. Options to write: path, container, kind, rate."""

    @classmethod
    def name(cls) -> str:
        return "sampled"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SampledReader:
        return SampledReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> SampledWriter:
        return SampledWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampledSource)
    spark.conf.set(PUSHDOWN, "true")


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, rate, channel, frame, sample) of the files at a path."""
    register(spark)
    return spark.read.format("sampled").options(**options).load(path)


def write_clips(frames: DataFrame, path: str, rate: int, container: str = "wav", kind: str = "s16", mode: str = "append") -> None:
    """A file ``clip.container`` for each clip of (clip, channel, frame, sample)."""
    spark = frames.sparkSession
    register(spark)
    size = frames.groupBy("clip").agg((F.max("frame") + 1).cast("bigint").alias("frames"), (F.max("channel") + 1).cast("int").alias("channels"))
    rows = frames.join(size, "clip").select(F.col("clip").cast("string").alias("clip"), "frames", "channels", F.col("channel").cast("int").alias("channel"), F.col("frame").cast("bigint").alias("frame"), F.col("sample").cast("float").alias("sample"))
    rows.repartition("clip").sortWithinPartitions("clip", "frame", "channel").write.format("sampled").options(rate=str(rate), container=container, kind=kind).mode(mode).save(path)


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, below the one that ``spark.checkpoint.dir`` names; on one machine a
    temporary one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="sampleloom-")
    return f"{configured.rstrip('/')}/{what}-{uuid.uuid4().hex}"
