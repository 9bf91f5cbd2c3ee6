"""Measurements of clips in long form: levels, offsets, overviews, stereo relation, silence, boundaries, look-ahead peaks,
loudness and true peak.

All but the filters of loudness and the interpolation of true peaks are aggregates and windows, so partial aggregates
combine before a shuffle; the two exceptions run a kernel on many channels of clips at once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import f32, f64, from_db, to_db
from . import kernels, scans
from .runs import by_block, by_run, per_channel  # noqa: F401


def level() -> Column:
    """The sample in 64-bit floats."""
    return f64(F.col("sample"))


def clip_levels(frames: DataFrame) -> DataFrame:
    """(clip, frames, peak, peak_db, mean_square, rms, rms_db) over all channels; silence is minus infinity."""
    found = frames.groupBy("clip").agg((F.max("frame") + 1).alias("frames"), F.max(F.abs(level())).alias("peak"), F.avg(level() * level()).alias("mean_square"))
    return found.select("clip", "frames", "peak", to_db(F.col("peak")).alias("peak_db"), "mean_square", F.sqrt("mean_square").alias("rms"), to_db(F.sqrt("mean_square")).alias("rms_db"))


#: Bits of magnitude that share a limb, and bits below a limb's magnitude that are kept: more than the 24 of a sample.
LIMB, KEPT = 16, 26


def exact_limbs(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, limb, n, total, squares): whole-number sums of samples and of their squares, exact and so the same in any order
    and at any number of partitions.

    Samples of magnitudes between two powers of 2^16 are whole numbers after one shift, as 32-bit floats have 24 digits; the
    limb says which shift. Sums add up as decimals, in parts before a shuffle.
    """
    x = level()
    limb = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(x)) / LIMB)).cast("int")
    whole = (x * F.pow(F.lit(2.0), F.lit(KEPT) - F.col("limb") * LIMB)).cast("decimal(19,0)")
    cut = frames.withColumn("limb", limb).withColumn("_whole", whole)
    return cut.groupBy(*keys, "limb").agg(F.count(F.lit(1)).alias("n"), F.sum("_whole").cast("decimal(38,0)").alias("total"), F.sum((F.col("_whole") * F.col("_whole")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("squares"))


def exact_levels(frames: DataFrame) -> DataFrame:
    """(clip, n, mean, mean_square, rms, rms_db) over all channels, bit by bit the same at every run: limbs are added from the
    smallest on."""
    limbs = exact_limbs(frames, ["clip"])
    listed = limbs.groupBy("clip").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("limb", "total", "squares"))).alias("_all"))
    shift = lambda x, times: F.pow(F.lit(2.0), (x["limb"] * LIMB - KEPT) * times)
    added = lambda name, times: F.aggregate("_all", F.lit(0.0), lambda s, x: s + x[name].cast("double") * shift(x, times))
    out = listed.select("clip", "n", (added("total", 1) / F.col("n")).alias("mean"), (added("squares", 2) / F.col("n")).alias("mean_square"))
    return out.withColumn("rms", F.sqrt("mean_square")).withColumn("rms_db", to_db(F.col("rms")))


def dc_means(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip", "channel").agg(F.avg(level()).alias("mean"))


def waveform(frames: DataFrame, buckets: int) -> DataFrame:
    """(clip, bucket, lo, hi) over all channels: bucket b of B has the frames from floor(bN/B) to floor((b+1)N/B), at least one; 0 is always inside."""
    n = frames.groupBy("clip").agg((F.max("frame") + 1).alias("_n"))
    b = F.lit(buckets).cast("bigint")
    sized = frames.join(n, "clip")
    if_long = F.floor((F.col("frame") * b + b - 1) / F.col("_n"))
    first = F.floor(((F.col("frame") + 1) * b - 1) / F.col("_n"))
    # A frame is in every bucket whose range holds it: one where there are enough frames, several where there are few.
    spread = F.sequence(F.least(first, F.floor(F.col("frame") * b / F.col("_n"))), F.greatest(first, if_long))
    each = sized.withColumn("bucket", F.explode(spread)).where((F.col("bucket") >= 0) & (F.col("bucket") < b))
    lo = F.floor(F.col("bucket") * F.col("_n") / b)
    hi = F.greatest(lo + 1, F.floor((F.col("bucket") + 1) * F.col("_n") / b))
    each = each.where((F.col("frame") >= lo) & (F.col("frame") < hi))
    return each.groupBy("clip", "bucket").agg(F.least(F.lit(0.0), F.min(level())).alias("lo"), F.greatest(F.lit(0.0), F.max(level())).alias("hi"))


def stereo_statistics(stereo: DataFrame) -> DataFrame:
    """(clip, frames, correlation, left, right, mid, side mean squares) of (clip, frame, l, r)."""
    l, r = f64(F.col("l")), f64(F.col("r"))
    m, s = (l + r) * 0.5, (l - r) * 0.5
    varies = (F.min("l") < F.max("l")) & (F.min("r") < F.max("r"))
    return stereo.groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"),
        F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(l, r) / (F.stddev_pop(l) * F.stddev_pop(r))))).alias("correlation"),
        F.avg(l * l).alias("left_ms"),
        F.avg(r * r).alias("right_ms"),
        F.avg(m * m).alias("mid_ms"),
        F.avg(s * s).alias("side_ms"),
    )


def threshold_silence(frames: DataFrame, threshold: float) -> DataFrame:
    """(clip, leading, trailing): frames before the first and after the last one beyond the threshold in any channel."""
    loud = F.when(F.abs(level()) > threshold, F.col("frame"))
    found = frames.groupBy("clip").agg((F.max("frame") + 1).alias("n"), F.min(loud).alias("first"), F.max(loud).alias("last"))
    return found.select("clip", F.coalesce("first", "n").alias("leading"), F.coalesce(F.col("n") - 1 - F.col("last"), "n").alias("trailing"))


def silent_ranges(frames: DataFrame, threshold_db: float, least: int, window: int) -> DataFrame:
    """(clip, start, end): runs of windows in which every channel's mean square is at most the threshold, long enough."""
    quiet = frames.groupBy("clip", F.floor(F.col("frame") / window).cast("bigint").alias("w"), "channel").agg(F.avg(level() * level()).alias("power"), (F.max("frame") + 1).alias("end"))
    quiet = quiet.groupBy("clip", "w").agg((F.max("power") <= from_db(threshold_db * 2)).alias("silent"), F.max("end").alias("end"))
    order = Window.partitionBy("clip").orderBy("w")
    runs = quiet.withColumn("run", F.col("w") - F.row_number().over(Window.partitionBy("clip", "silent").orderBy("w"))).where("silent")
    ranges = runs.groupBy("clip", "run").agg((F.min("w") * window).alias("start"), F.max("end").alias("end"))
    return ranges.where(F.col("end") - F.col("start") >= least).select("clip", "start", "end")


def trim_silence(frames: DataFrame, threshold_db: float, least: int, window: int, padding: int = 0) -> DataFrame:
    """Drops a silent range at the start and one at the end, but for the padding."""
    n = frames.groupBy("clip").agg((F.max("frame") + 1).alias("_n"))
    ranges = silent_ranges(frames, threshold_db, least, window).join(n, "clip")
    cuts = ranges.groupBy("clip").agg(F.max(F.when(F.col("start") == 0, F.greatest(F.col("start"), F.col("end") - padding))).alias("_a"), F.max(F.when(F.col("end") == F.col("_n"), F.least("end", F.col("start") + padding))).alias("_e"))
    joined = frames.join(cuts, "clip", "left")
    a = F.coalesce("_a", F.lit(0))
    kept = joined.where((F.col("frame") >= a) & (F.col("_e").isNull() | (F.col("frame") < F.col("_e"))))
    return kept.select("clip", "channel", (F.col("frame") - a).alias("frame"), "sample")


def boundaries(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """(clip, request, channel, before, after, step) at requested joins (clip, request, frame), in any number per clip."""
    before = frames.select("clip", "channel", (F.col("frame") + 1).alias("frame"), F.col("sample").alias("before"))
    met = requests.join(frames.withColumnRenamed("sample", "after"), ["clip", "frame"]).join(before, ["clip", "channel", "frame"])
    return met.select("clip", "request", "channel", "before", "after", (f64(F.col("after")) - f64(F.col("before"))).alias("step"))


def look_ahead_peak(frames: DataFrame, look: int) -> DataFrame:
    """(clip, frame, peak): the largest magnitude of any channel from this frame on to ``look`` frames later."""
    linked = frames.groupBy("clip", "frame").agg(F.max(F.abs(level())).alias("x"))
    return scans.ahead_max(linked.withColumnRenamed("x", "peak"), "peak", look)


#: Weights of the channels of layouts with surround channels; all others weigh 1 (fixed values).
CHANNEL_WEIGHTS = {4: [1.0, 1.0, 1.41, 1.41], 5: [1.0, 1.0, 1.0, 1.41, 1.41], 6: [1.0, 1.0, 1.0, 0.0, 1.41, 1.41]}


def loudness_blocks(frames: DataFrame, rate: int) -> DataFrame:
    """(clip, block, power): weighted mean square of each full 400 ms window, every 100 ms, after K weighting; a clip that is
    shorter has one block."""
    block, step = int(np.floor(0.4 * rate + 0.5)), int(np.floor(0.1 * rate + 0.5))
    weighted = scans.filtered(frames, *kernels.k_weights(rate)).withColumn("sample", f32(F.col("sample")))
    clip = Window.partitionBy("clip")
    short = [F.when((F.col("channels") == k) & (F.col("channel") == c), w) for k, ws in CHANNEL_WEIGHTS.items() for c, w in enumerate(ws)]
    weight = F.coalesce(*short, F.lit(1.0))
    # Windows are whole numbers of pieces long: sums by piece, then of neighbouring pieces. All follows the deal by clip.
    piece = math.gcd(block, step)
    parts = weighted.groupBy("clip", "channel", F.floor(F.col("frame") / piece).cast("bigint").alias("piece")).agg(F.sum(level() * level()).alias("p"), (F.max("frame") + 1).alias("end"))
    parts = parts.withColumn("n", F.max("end").over(clip)).withColumn("channels", F.max("channel").over(clip) + 1)
    parts = parts.groupBy("clip", "n", "piece").agg(F.sum(F.col("p") * weight).alias("p"))
    # Differences of running sums, as windows may be many pieces long.
    order = clip.orderBy("piece")
    parts = parts.withColumn("before", F.sum("p").over(order) - F.col("p")).withColumn("after", F.lead("before", block // piece).over(order)).withColumn("all", F.sum("p").over(clip))
    at = F.col("piece") * piece
    full = (F.col("n") >= block) & (at % step == 0) & (at + block <= F.col("n"))
    tiny = (F.col("n") < block) & (F.col("piece") == 0)
    power = F.when(tiny, F.col("all") / F.col("n")).otherwise((F.coalesce("after", "all") - F.col("before")) / block)
    return parts.where(full | tiny).select("clip", F.when(tiny, F.lit(-1)).otherwise(at / step).cast("bigint").alias("block"), F.greatest(power, F.lit(0.0)).alias("power"))


def lufs(power: Column) -> Column:
    return F.when(power > 0, -0.691 + 10 * F.log10(power)).otherwise(F.lit(float("-inf")))


def gated_blocks(blocks: DataFrame) -> DataFrame:
    """Adds to each block its loudness ``l``, and whether it is ``_kept``: at least -70 LUFS, and at least the mean of those
    less 10."""
    clip = Window.partitionBy("clip")
    b = blocks.withColumn("l", lufs(F.col("power"))).withColumn("_mean", lufs(F.avg(F.when(F.col("l") >= -70, F.col("power"))).over(clip)))
    b = b.withColumn("_kept", F.coalesce((F.col("l") >= -70) & (F.col("l") >= F.col("_mean") - 10), F.lit(False)))
    return b


def gated(blocks: DataFrame) -> DataFrame:
    """(clip, lufs, range_lu, momentary) by the blocks that are kept; the range lies between the values at whole-number ranks
    of those blocks."""
    clip = Window.partitionBy("clip")
    silent = F.lit(float("-inf"))
    b = gated_blocks(blocks)
    b = b.withColumn("_n", F.count(F.when(F.col("_kept"), 1)).over(clip)).withColumn("_r", F.row_number().over(clip.orderBy(F.desc("_kept"), "l")) - 1)
    at = lambda rank: F.max(F.when(F.col("_kept") & (F.col("_r") == rank), F.col("l")))
    out = b.groupBy("clip").agg(
        F.max("l").alias("_top"),
        F.max("block").alias("_last"),
        lufs(F.avg(F.when(F.col("_kept"), F.col("power")))).alias("_lufs"),
        (at(F.least(F.floor(F.col("_n") * 95 / 100), F.col("_n") - 1)) - at(F.floor(F.col("_n") / 10))).alias("_range"),
        F.max("_n").alias("_n"),
    )
    short = F.col("_last") < 0  # one block, which no gate holds back
    some = F.col("_n") > 0
    return out.select(
        "clip",
        F.when(short, F.col("_top")).when(some, F.col("_lufs")).otherwise(silent).alias("lufs"),
        F.when(short | ~some, 0.0).otherwise(F.col("_range")).alias("range_lu"),
        F.when(short | some, F.col("_top")).otherwise(silent).alias("momentary"),
    )


def loudness(frames: DataFrame, rate: int) -> DataFrame:
    return gated(loudness_blocks(frames, rate))


#: Frames of a block whose edges are shared with its neighbours.
BLOCK = 1 << 14


def true_peak(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """(clip, true_peak, true_peak_db): the largest magnitude between samples, by fourfold interpolation."""
    work = lambda x, n, k: (kernels.true_peaks(x, n, *kernels.own_part(n, k, block, 16)), np.ones(len(n), np.int64))
    each = by_block(frames, block, 16, 15, work, "clip bigint, channel int, block bigint, peak double")
    peaks = each.groupBy("clip").agg(F.max("peak").alias("true_peak"))
    return peaks.select("clip", "true_peak", to_db(F.col("true_peak")).alias("true_peak_db"))


def fine_peaks(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """(clip, channel, frame, peak): magnitudes up to the next sample by eightfold reconstruction."""

    def work(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        skip, own = kernels.own_part(n, k, block, 64)
        peaks = kernels.fine_peaks(x, n, k == 0, skip + own == n)
        return peaks[np.repeat(np.cumsum(n) - n + skip, own) + kernels.ragged(own)], own

    dealt = by_block(frames, block, 64, 64, work, "clip bigint, channel int, block bigint, frame bigint, peak double")
    return dealt.select("clip", "channel", (F.col("block") * block + F.col("frame")).alias("frame"), "peak")
