"""Editing and channel operators over long frames (clip, channel, frame, sample).

Ranges are pushed down as predicates on ``frame``; joins are equi-joins on (clip, channel, frame); lengths come from one
partial aggregate per clip, so no clip has to fit into a row or a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import f32, f64, frame_index

KEY = ["clip", "channel", "frame"]
TURN = 6.283185307179586


def lengths(frames: DataFrame) -> DataFrame:
    """(clip, frames, channels)."""
    return frames.groupBy("clip").agg((F.max("frame") + 1).alias("frames"), (F.max("channel") + 1).alias("channels"))


def faults(frames: DataFrame) -> DataFrame:
    """(clip, fault) of clips that are none: samples that are null or not finite, frames below 0, channels or frames that are
    missing, and places that occur more than once. One aggregate for each channel, then one for each clip."""
    x = f64(F.col("sample"))
    odd = F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))
    by = frames.groupBy("clip", "channel").agg(F.count(F.when(odd, 1)).alias("odd"), F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("places"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    clips = by.groupBy("clip").agg(F.sum("odd").alias("odd"), F.sum(F.col("n") - F.col("places")).alias("twice"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("places").alias("least"), F.count(F.lit(1)).alias("channels"), F.min("channel").alias("low"), F.max("channel").alias("high"))
    named = {
        "not finite": F.col("odd") > 0,
        "twice": F.col("twice") > 0,
        "before the start": (F.col("first") < 0) | (F.col("low") < 0),
        "frames missing": F.col("least") < F.col("last") + 1,
        "channels missing": F.col("channels") < F.col("high") + 1,
    }
    return clips.select("clip", F.explode(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in named.items()))).alias("fault")).where("fault is not null")


def mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """(clip, first, second) of clips whose numbers of channels differ: they cannot be mixed, joined or crossfaded."""
    a, b = (lengths(f).select("clip", F.col("channels").alias(name)) for f, name in ((first, "first"), (second, "second")))
    return a.join(b, "clip").where("first <> second")


def _sized(first: DataFrame, second: DataFrame) -> DataFrame:
    """(clip, _a, _b): the frames of clips that both have; other numbers of channels are an error."""
    a = lengths(first).select("clip", F.col("frames").alias("_a"), F.col("channels").alias("_ca"))
    b = lengths(second).select("clip", F.col("frames").alias("_b"), F.col("channels").alias("_cb"))
    text = F.concat(F.lit("clip "), F.col("clip").cast("string"), F.lit(" has "), F.col("_ca").cast("string"), F.lit(" channels, but "), F.col("_cb").cast("string"), F.lit(" in the other signal"))
    checked = F.when(F.col("_ca") == F.col("_cb"), F.col("_a")).otherwise(F.raise_error(text).cast("bigint"))
    return a.join(b, "clip").select("clip", checked.alias("_a"), "_b")


def with_length(frames: DataFrame) -> DataFrame:
    return frames.join(lengths(frames), "clip")


def _range(frames: DataFrame, start: float, end: float, rate: int) -> DataFrame:
    timed = with_length(frames)
    a = frame_index(F.lit(float(start)), rate, F.col("frames"))
    e = F.greatest(a, frame_index(F.lit(float(end)), rate, F.col("frames")))
    return timed.withColumn("_a", a).withColumn("_e", e)


def cut(frames: DataFrame, start: float, end: float, rate: int) -> DataFrame:
    """Keeps the seconds from start to end, counted from the first of them."""
    inside = _range(frames, start, end, rate).where("frame >= _a and frame < _e")
    return inside.select("clip", "channel", (F.col("frame") - F.col("_a")).alias("frame"), "sample")


def remove(frames: DataFrame, start: float, end: float, rate: int) -> DataFrame:
    """Drops the seconds from start to end and closes the gap."""
    rest = _range(frames, start, end, rate).where("frame < _a or frame >= _e")
    return rest.select("clip", "channel", F.when(F.col("frame") >= F.col("_e"), F.col("frame") - (F.col("_e") - F.col("_a"))).otherwise(F.col("frame")).alias("frame"), "sample")


def silence(clips: DataFrame, frames: int, channels: int) -> DataFrame:
    """Zero samples for each row of ``clips``."""
    made = clips.select("clip", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    return made.select("clip", "channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(frames - 1).cast("bigint"))).alias("frame"), F.lit(0.0).cast("float").alias("sample"))


def pad(frames: DataFrame, before: int, after: int) -> DataFrame:
    """Zeros before and after each clip."""
    size = lengths(frames)
    at = size.select("clip", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("channel"), "frames")
    gaps = [F.sequence(F.lit(0).cast("bigint"), F.lit(before - 1).cast("bigint"))] * bool(before)
    gaps += [F.sequence(F.col("frames") + before, F.col("frames") + before + after - 1)] * bool(after)
    moved = frames.select("clip", "channel", (F.col("frame") + before).alias("frame"), "sample")
    for gap in gaps:
        moved = moved.unionByName(at.select("clip", "channel", F.explode(gap).alias("frame"), F.lit(0.0).cast("float").alias("sample")))
    return moved


def reverse(frames: DataFrame) -> DataFrame:
    return with_length(frames).select("clip", "channel", (F.col("frames") - 1 - F.col("frame")).alias("frame"), "sample")


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second clip of each id after the first."""
    later = second.join(lengths(first).select("clip", F.col("frames").alias("_n")), "clip", "left")
    return first.select(*KEY, "sample").unionByName(later.select("clip", "channel", (F.col("frame") + F.coalesce("_n", F.lit(0))).alias("frame"), "sample"))


def mix(base: DataFrame, overlay: DataFrame, offset: int, gain: float, extend: bool) -> DataFrame:
    """Adds the overlay in 32-bit floats from a frame on; frames before 0 are lost, those behind the end unless ``extend``.
    Clips with other numbers of channels in the two are an error."""
    same = _sized(base, overlay).select("clip", F.col("_a").alias("_n"))
    base = base.join(same, "clip", "left").where("_n is null or _n >= 0")  # what reads the number finds the error
    moved = overlay.select("clip", "channel", (F.col("frame") + offset).alias("frame"), F.col("sample").alias("_over")).where("frame >= 0")
    joined = base.join(moved, KEY, "full" if extend else "left")
    value = F.coalesce("sample", F.lit(0.0).cast("float")) + f32(F.coalesce("_over", F.lit(0.0).cast("float")) * F.lit(float(gain)).cast("float"))
    return joined.select(*KEY, f32(value).alias("sample"))


def crossfade(first: DataFrame, second: DataFrame, duration: int) -> DataFrame:
    """The end of the first clip fades into the second by a quarter turn of cosine and sine. Clips with other numbers of
    channels in the two are an error."""
    size = _sized(first, second)
    size = size.select("clip", "_a", F.least(F.lit(duration).cast("bigint"), "_a", "_b").alias("_n"))
    left = first.join(size, "clip").select(*KEY, F.col("sample").alias("_x"), F.col("_a").alias("_la"), F.col("_n").alias("_ln"))
    right = second.join(size, "clip").select("clip", "channel", (F.col("frame") + F.col("_a") - F.col("_n")).alias("frame"), F.col("sample").alias("_y"), F.col("_a").alias("_ra"), F.col("_n").alias("_rn"))
    both = left.join(right, KEY, "full").withColumn("_n", F.coalesce("_ln", "_rn")).withColumn("_a", F.coalesce("_la", "_ra"))
    t = (F.col("frame") - (F.col("_a") - F.col("_n"))) / F.greatest(F.col("_n") - 1, F.lit(1).cast("bigint")) / 4 * TURN
    mixed = f64(F.col("_x")) * F.cos(t) + f64(F.col("_y")) * F.sin(t)
    return both.select(*KEY, f32(F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), mixed).otherwise(f64(F.coalesce("_x", "_y")))).alias("sample"))


def to_mono(frames: DataFrame) -> DataFrame:
    """The mean of the channels of each frame, added in 32-bit floats in channel order."""
    # Sorting within a frame keeps the order of addition; a frame has few channels.
    listed = frames.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("channel", "sample"))).alias("_all"))
    total = F.aggregate("_all", F.lit(0.0).cast("float"), lambda s, x: f32(s + x["sample"]))
    return listed.select("clip", F.lit(0).alias("channel"), "frame", f32(total / f32(F.size("_all"))).alias("sample"))


def map_channels(frames: DataFrame, mapping: list[int]) -> DataFrame:
    """Output channel i is input channel mapping[i]; channels may repeat or go."""
    outputs = F.filter(F.transform(F.lit(mapping), lambda c, i: F.when(c == F.col("channel"), i)), lambda i: i.isNotNull())
    return frames.select("clip", F.explode(outputs).alias("_c"), "frame", "sample").select("clip", F.col("_c").alias("channel"), "frame", "sample")


def to_channels(frames: DataFrame, count: int) -> DataFrame:
    """1: the mean, 2: the mean twice unless it is stereo already, else channels in turn."""
    if count == 1:
        return to_mono(frames)
    sized = with_length(frames)
    turn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(i % F.col("channels") == F.col("channel"), i)), lambda i: i.isNotNull())
    if count == 2:
        stereo = sized.where("channels = 2").select(*KEY, "sample")
        other = to_mono(sized.where("channels <> 2").select(*KEY, "sample"))
        return stereo.unionByName(other.select("clip", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), "frame", "sample"))
    return sized.select("clip", F.explode(turn).alias("_c"), "frame", "sample").select("clip", F.col("_c").alias("channel"), "frame", "sample")


def split(frames: DataFrame) -> DataFrame:
    """(clip, part, channel 0, …): a mono clip for each channel."""
    return frames.select("clip", F.col("channel").alias("part"), F.lit(0).alias("channel"), "frame", "sample")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Channels of all parts one after the other, padded with zeros to the longest."""
    offset, stacked = F.lit(0), None
    counts = None
    for i, p in enumerate(parts):
        tagged = p.select("clip", F.lit(i).alias("_part"), "channel", "frame", "sample")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    counts = stacked.groupBy("clip").agg(*(F.coalesce(F.max(F.when(F.col("_part") == i, F.col("channel"))) + 1, F.lit(0)).alias(f"_c{i}") for i in range(len(parts))), (F.max("frame") + 1).alias("_n"))
    before = F.lit(0)
    for i in range(len(parts) - 1):
        before = before + F.when(F.col("_part") > i, F.col(f"_c{i}")).otherwise(0)
    placed = stacked.join(counts, "clip").select("clip", (F.col("channel") + before).alias("channel"), "frame", "sample")
    total = sum((F.col(f"_c{i}") for i in range(1, len(parts))), F.col("_c0"))
    grid = counts.select("clip", F.explode(F.sequence(F.lit(0), total - 1)).alias("channel"), "_n").select("clip", "channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("frame"))
    return grid.join(placed, KEY, "left").select(*KEY, F.coalesce("sample", F.lit(0.0).cast("float")).alias("sample"))


def pan(stereo_or_mono: DataFrame, position: float) -> DataFrame:
    """Constant-power placement of the mono sum between left (-1) and right (1)."""
    turn = (position + 1) / 8
    gain = F.when(F.col("_c") == 0, F.sin(F.lit((0.25 - turn) * TURN))).otherwise(F.sin(F.lit(turn * TURN)))
    both = to_mono(stereo_or_mono).select("clip", F.explode(F.array(F.lit(0), F.lit(1))).alias("_c"), "frame", "sample")
    return both.select("clip", F.col("_c").alias("channel"), "frame", f32(f64(F.col("sample")) * gain).alias("sample"))


def interleave(frames: DataFrame) -> DataFrame:
    """(clip, position, sample): all channels of a frame, then the next frame."""
    return with_length(frames).select("clip", (F.col("frame") * F.col("channels") + F.col("channel")).alias("position"), "sample")


def deinterleave(samples: DataFrame, channels: int) -> DataFrame:
    return samples.select("clip", F.pmod("position", F.lit(channels)).cast("int").alias("channel"), F.floor(F.col("position") / channels).cast("bigint").alias("frame"), "sample")


#: Stereo shares of the channels of each layout, low-frequency channels left out (fixed values).
DOWNMIX = {
    "mono": [(0.7071067811865476, 0.7071067811865476)],
    "quad": [(1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 1.0)],
    "5.1": [(1.0, 0.0), (0.0, 1.0), (0.7071067811865476, 0.7071067811865476), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)],
    "7.1": [(1.0, 0.0), (0.0, 1.0), (0.7071067811865476, 0.7071067811865476), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 1.0)],
}


def downmix(frames: DataFrame, layout: str) -> DataFrame:
    """Stereo as the sum of channel times share; the matrix has a row for each channel of the layout."""
    # A group for each frame has both sums, and no row is doubled before it is added.
    shares = F.element_at(F.lit([[float(x) for x in row] for row in DOWNMIX[layout]]), F.col("channel") + 1)
    sums = frames.groupBy("clip", "frame").agg(*(F.sum(f64(F.col("sample")) * shares[c]).alias(f"_{c}") for c in range(2)))
    summed = sums.select("clip", F.posexplode(F.array("_0", "_1")).alias("channel", "sample"), "frame")
    return summed.select(*KEY, f32(F.col("sample")).alias("sample"))


def as_clips(frames: DataFrame) -> DataFrame:
    """(clip, channel, samples): each channel's samples in an array."""
    listed = frames.groupBy("clip", "channel").agg(F.array_sort(F.collect_list(F.struct("frame", "sample"))).alias("_all"))
    return listed.select("clip", "channel", F.transform("_all", lambda x: x["sample"]).alias("samples"))


def as_frames(clips: DataFrame, samples: str | Column = "samples") -> DataFrame:
    return clips.select("clip", "channel", F.posexplode(samples).alias("frame", "sample")).withColumn("frame", F.col("frame").cast("bigint"))


def as_blocks(frames: DataFrame, size: int = 4096) -> DataFrame:
    """(clip, channel, block, samples): bounded pieces that shuffle and stream."""
    listed = frames.groupBy("clip", "channel", F.floor(F.col("frame") / size).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "sample"))).alias("_all"))
    return listed.select("clip", "channel", "block", F.transform("_all", lambda x: x["sample"]).alias("samples"))
