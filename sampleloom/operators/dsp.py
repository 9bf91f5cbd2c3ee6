"""Filters, limiters, resampling, stretching and effects: kernels on each channel, planned and dealt by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.units import f32, f64
from . import kernels, scans
from .measure import BLOCK, fine_peaks, look_ahead_peak, true_peak
from .runs import by_block, by_run, dealt, run_starts, whole_runs
from .shape import lengths

#: What stands in place of a channel in rows that hold a clip's length and the places that a block is taken from.
ENDS, PLACES = -2, -1


def filtered(frames: DataFrame, kind: str, hz: float, rate: int, q: float = 0.5**0.5, gain_db: float = 0.0) -> DataFrame:
    coefficients = kernels.biquad_coefficients(kind, hz, rate, q, gain_db)
    return scans.filtered(frames, coefficients).withColumn("sample", f32(F.col("sample")))


def _gains(peaks: DataFrame, kernel) -> DataFrame:
    """(clip, frame, gain) from (clip, frame, peak) by a recurrence over each clip; the kernel takes rows of peaks."""
    return by_run(peaks, ["clip"], "peak", lambda x, n, _: (kernels.by_rows(kernel, x, n), n), "clip bigint, frame bigint, gain double")


def limit(frames: DataFrame, rate: int, ceiling_db: float = -1.0, look_ms: float = 5.0, release_ms: float = 50.0) -> DataFrame:
    """Keeps linked channels under the ceiling, looking ahead by a window."""
    look = int(np.floor(look_ms * rate / 1000 + 0.5))
    gains = scans.limiter_gains(look_ahead_peak(frames, look), 10 ** (ceiling_db / 20), release_ms * rate / 1000)
    return frames.join(gains, ["clip", "frame"]).select("clip", "channel", "frame", f32(F.col("sample") * f32(F.col("gain"))).alias("sample"))


def compress(frames: DataFrame, key: DataFrame, rate: int, threshold_db: float, ratio: float, attack_ms: float, release_ms: float, makeup_db: float = 0.0, depth: float = 1.0) -> DataFrame:
    """Lowers frames while the key, itself or another clip's signal under the same id, is loud."""
    peaks = key.groupBy("clip", "frame").agg(F.max(F.abs(f64(F.col("sample")))).alias("peak"))
    gains = _gains(peaks, lambda p: kernels.compressor_gains(p, rate, threshold_db, ratio, attack_ms, release_ms, makeup_db, depth))
    met = frames.join(gains, ["clip", "frame"], "left")
    return met.select("clip", "channel", "frame", f32(f64(F.col("sample")) * F.coalesce("gain", F.lit(1.0))).alias("sample"))


def duck(frames: DataFrame, key: DataFrame, rate: int) -> DataFrame:
    """Lowers frames far and fast while the key is heard, as music under speech (fixed values)."""
    return compress(frames, key, rate, -30.0, 20.0, 5.0, 250.0)


def _lengthened(frames: DataFrame, kernel, tasks: int | None) -> DataFrame:
    return by_run(frames, ["clip", "channel"], "sample", kernel, "clip bigint, channel int, frame bigint, sample float", tasks)


def _resampled(frames: DataFrame, ratio: float, block: int) -> DataFrame:
    reach = kernels.resample_reach(ratio)
    work = lambda x, n, k: kernels.resample_blocks(x, n, k, block, ratio)
    made = by_block(frames, block, reach, reach, work, "clip bigint, channel int, block bigint, frame bigint, sample float")
    return made.select("clip", "channel", (F.ceil(F.col("block") * float(block) * ratio) + F.col("frame")).alias("frame"), "sample")


def resample(frames: DataFrame, rate: int, to: int, block: int = BLOCK) -> DataFrame:
    return _resampled(frames, to / rate, block)


def speed(frames: DataFrame, factor: float, block: int = BLOCK) -> DataFrame:
    return _resampled(frames, 1 / factor, block)


def _stretched(frames: DataFrame, factor: float, rate: int, block: int, tasks: int | None, ratio: float | None) -> DataFrame:
    """Another tempo and, with a ``ratio``, what it gives resampled by it at the length of the clip. Only the search runs over
    a whole channel. Each block of the other tempo then has its few places, its clip's length and the frames that the places
    can reach in one run, so frames travel once for it, and edges of blocks twice."""
    window, hop, radius = kernels.tempo_sizes(rate)
    reach = kernels.resample_reach(ratio) if ratio else 0

    def search(x: np.ndarray, sizes: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        out = [kernels.tempo_places(p, factor, rate) for p in np.split(x, np.cumsum(sizes)[:-1])]
        return np.concatenate(out), np.array([len(p) for p in out], np.int64)

    def rows(at: DataFrame, begin: Column, end: Column, channel: Column, frame: Column, value: Column) -> DataFrame:
        """Rows of each block that has frames from ``begin`` to ``end`` of the other tempo within its reach."""
        low, high = (F.floor((edge + shift) / block).cast("bigint") for edge, shift in ((begin, -reach), (end, reach)))
        blocks = F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), low), F.greatest(F.lit(0).cast("bigint"), high)))
        return at.select("clip", blocks.alias("block"), channel.alias("channel"), frame.cast("bigint").alias("frame"), value.cast("double").alias("sample"))

    places = by_run(frames.where("channel = 0"), ["clip", "channel"], "sample", search, "clip bigint, channel int, frame bigint, place bigint", tasks)
    at, f = F.col("frame") * hop, F.col("frame")
    sizes = lengths(frames)
    last = F.greatest(F.lit(0), F.ceil(F.col("frames") / factor / block) - 1).cast("bigint")
    ends = sizes.select("clip", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), F.lit(ENDS).alias("channel"), F.col("channels").cast("bigint").alias("frame"), F.col("frames").cast("double").alias("sample"))
    dealt_rows = rows(frames.where("channel >= 0"), (f - window - radius) / factor, (f + radius + 1) / factor + window, F.col("channel").cast("int"), f, F.col("sample"))
    all_rows = ends.unionByName(rows(places, at, at + window - 1, F.lit(PLACES), f, F.col("place"))).unionByName(dealt_rows)

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        clip, number, channel, frame = (t.column(c).to_numpy() for c in ("clip", "block", "channel", "frame"))
        x = np.ma.array(t.column("sample").to_numpy(), mask=t.column("sample").is_null().to_numpy())
        starts = run_starts([clip, number])
        known = channel == ENDS  # other runs are behind the clip's end
        run = np.repeat(np.cumsum(known[starts]) - 1, np.diff(np.append(starts, t.num_rows)))
        mine = np.repeat(known[starts], np.diff(np.append(starts, t.num_rows)))
        clip, number, channels, frames = clip[known], number[known], frame[known], x.data[known].astype(np.int64)
        moved = np.floor(frames / factor + 0.5).astype(np.int64)
        begin = np.maximum(0, number * block - reach)
        size = np.maximum(0, np.minimum(moved, (number + 1) * block + reach) - begin)
        p, s = mine & (channel == PLACES), mine & (channel >= 0)
        out, lost = kernels.tempo_overlap(run[s], channel[s], frame[s], x[s], channels, begin, size, (run[p], frame[p], x.data[p].astype(np.int64)), rate)
        of = np.repeat(np.arange(len(clip)), channels)
        clip, number, channel, frames, moved, begin, size = clip[of], number[of], kernels.ragged(channels), frames[of], moved[of], begin[of], size[of]
        if ratio:
            out[lost] = np.nan
            out, size = kernels.resample_blocks(out, size, number, block, ratio)
            begin, lost = kernels.resampled_first(number, block, ratio), None
            kept = np.repeat(begin, size) + kernels.ragged(size) < np.repeat(frames, size)  # what is too long is cut
            out, size = out[kept], np.minimum(size, np.maximum(0, frames - begin))
            behind = np.floor(moved * ratio + 0.5).astype(np.int64)  # and zeros follow what is too short
            rest = np.where(number == np.maximum(0, -(-moved // block) - 1), np.maximum(0, frames - behind), 0)
            out = np.concatenate([out, np.zeros(rest.sum(), np.float32)])
            clip, channel, begin, size = (np.concatenate(pair) for pair in ((clip, clip), (channel, channel), (begin, behind), (size, rest)))
        made = [np.repeat(clip, size), np.repeat(channel, size), np.repeat(begin, size) + kernels.ragged(size)]
        return pa.record_batch([*map(pa.array, made), pa.array(out, mask=lost)], fields.names).cast(target)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_runs(batches, ["clip", "block"]):
            yield work(held)

    fields = StructType.fromDDL("clip bigint, channel int, frame bigint, sample float")
    target = to_arrow_schema(fields)
    return all_rows.repartition(*dealt(["clip", "block"], tasks)).sortWithinPartitions("clip", "block", "channel", "frame").mapInArrow(run_all, fields)


def tempo(frames: DataFrame, factor: float, rate: int, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """Another speed at the same pitch. The first channel decides where each block is taken from, so channels stay in step;
    blocks overlap by halves under a window, whose weights are divided out. Frames are dealt to so many ``tasks`` where
    their number is known."""
    return frames if factor == 1 else _stretched(frames, factor, rate, block, tasks, None)


def pitch(frames: DataFrame, semitones: float, rate: int, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """Another pitch at the same length: another tempo, played at another speed, cut or filled with zeros."""
    ratio = 2 ** (semitones / 12)
    if ratio != 1:
        return _stretched(frames, 1 / ratio, rate, block, tasks, 1 / ratio)
    size = lengths(frames)
    grid = size.select("clip", "frames", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("channel")).select("clip", "channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)).alias("frame"))
    return grid.join(speed(frames, ratio, block), ["clip", "channel", "frame"], "left").select("clip", "channel", "frame", F.coalesce("sample", F.lit(0.0).cast("float")).alias("sample"))


def effect(frames: DataFrame, kind: str, rate: int, tasks: int | None = None, **settings) -> DataFrame:
    """One of the bus effects, by name; many clips are worked on at once, channel by channel, dealt to so many
    ``tasks`` where their number is known."""
    if kind in ("lowpass", "highpass"):
        return scans.filtered(frames, kernels.one_pole_coefficients(settings["hz"], rate, kind == "highpass"), tasks=tasks).withColumn("sample", f32(F.col("sample")))
    moved = lambda x, c, taps, longest: kernels.modulated_delay(x, rate, settings["delay_ms"], settings["depth_ms"], settings["hz"], settings.get("feedback", 0.0), settings.get("stereo_phase", 0.0), settings["wet"], taps, longest, c)
    work = {
        "delay": lambda x, c: kernels.delay(x, settings["seconds"] * rate, settings["feedback"], settings["wet"]),
        "reverb": lambda x, c: kernels.reverb(x, rate, settings["decay_s"], settings.get("damping", 0.0), settings["wet"], c),
        "chorus": lambda x, c: moved(x, c, 2, 80.0),
        "flanger": lambda x, c: moved(x, c, 1, 20.0),
        "phaser": lambda x, c: kernels.phaser(x, rate, settings["centre_hz"], settings["depth"], settings["hz"], settings["feedback"], settings.get("stereo_phase", 0.0), settings["wet"], c),
        "bitcrusher": lambda x, c: kernels.bitcrush(x, settings["bits"], settings["ratio"], settings.get("wet", 1.0)),
    }[kind]

    def run(x: np.ndarray, sizes: np.ndarray, channels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(x), np.float32)
        for c in np.unique(channels).tolist():
            mine = np.repeat(channels == c, sizes)
            out[mine] = kernels.by_rows(lambda rows: work(rows, c), x[mine], sizes[channels == c])
        return out, sizes

    return _lengthened(frames, run, tasks)


def limit_true_peak(frames: DataFrame, rate: int, ceiling_db: float = -1.0, look_ms: float = 5.0, release_ms: float = 50.0, margin_db: float = 0.3) -> DataFrame:
    """Keeps linked channels under the ceiling between samples, too: eightfold reconstruction finds the peaks, and what the
    finished clip still has beyond the ceiling is taken from all of it."""
    protected = 10 ** ((ceiling_db - margin_db) / 20) * (1 - 8 * 2.0**-23)
    linked = fine_peaks(frames).groupBy("clip", "frame").agg(F.max("peak").alias("peak"))
    look = int(np.floor(look_ms * rate / 1000 + 0.5))
    gains = scans.limiter_gains(scans.ahead_max(linked, "peak", look), protected, release_ms * rate / 1000)
    out = frames.join(gains, ["clip", "frame"]).select("clip", "channel", "frame", f32(f64(F.col("sample")) * F.col("gain")).alias("sample"))
    found = fine_peaks(out).groupBy("clip").agg(F.max("peak").alias("_a")).join(true_peak(out).select("clip", F.col("true_peak").alias("_b")), "clip")
    over = found.select("clip", F.least(F.lit(1.0), F.lit(protected) / F.greatest("_a", "_b", F.lit(1e-300))).alias("_c"))
    return out.join(over, "clip").select("clip", "channel", "frame", f32(f64(F.col("sample")) * F.col("_c")).alias("sample"))


def spectrum(frames: DataFrame, rate: int, size: int) -> DataFrame:
    """(clip, channel, bin, hz, magnitude) of the first ``size`` samples of each channel."""
    return spectrogram(frames.where(F.col("frame") < size), rate, size, size).select("clip", "channel", "bin", "hz", "magnitude")


def spectrogram(frames: DataFrame, rate: int, size: int, hop: int) -> DataFrame:
    """(clip, channel, col, t, bin, hz, magnitude): a column each hop, the last ones padded with zeros. Columns are dealt in
    blocks that share what the last ones of a block reach over its end, so each frame travels little more than once."""
    columns, bins = max(1, -(-max(BLOCK, 8 * size) // hop)), size // 2 + 1
    work = lambda x, n, k: kernels.columns_of(x, n, k, size, hop, columns)
    kept = frames if hop <= size else frames.where(F.pmod("frame", F.lit(hop)) < size)
    if hop > size:  # frames between the columns are not dealt
        kept = kept.withColumn("frame", F.floor(F.col("frame") / hop).cast("bigint") * size + F.pmod("frame", F.lit(hop)))
        work = lambda x, n, k: kernels.columns_of(x, n, k, size, size, columns)
    step = min(hop, size)
    made = by_block(kept, columns * step, 0, size - step, work, "clip bigint, channel int, block bigint, frame bigint, magnitude double")
    col, bin_ = (F.col("block") * columns + F.floor(F.col("frame") / bins)).cast("bigint"), F.pmod("frame", F.lit(bins)).cast("int")
    return made.select("clip", "channel", col.alias("col"), (col * hop / rate).alias("t"), bin_.alias("bin"), (bin_ * (rate / size)).alias("hz"), "magnitude")
