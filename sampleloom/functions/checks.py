"""Predicates and small columns over catalogues of voices, names, tags, effects and buses.

Checks are data: each gives rows (key, fault), so a catalogue of any size is checked in one pass and joins with what it
describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of playback rates and of pitches in semitones, and the longest name (fixed values).
RATES, SEMITONES, NAME_BYTES = (1 / 16, 8.0), (-48.0, 48.0), 64
#: Speaker bits of layouts by their number of channels (fixed values).
MASKS = {1: 0x4, 2: 0x3, 4: 0x33, 6: 0x3F, 8: 0x63F}
#: Tags by the names under which files keep them (fixed values).
TAGS = {
    "title": ("title", "inam"),
    "artist": ("artist", "iart"),
    "album": ("album", "iprd"),
    "album_artist": ("album_artist", "albumartist"),
    "track": ("track", "tracknumber", "iprt", "itrk"),
    "disc": ("disc", "discnumber"),
    "year": ("year", "date", "icrd"),
    "genre": ("genre", "ignr"),
    "comment": ("comment", "description", "icmt"),
    "isrc": ("isrc",),
}
#: Containers that keep tags, and tags that one of them has no place for (fixed values).
TAGGED, UNKEPT = ("wav", "flac", "mp3"), {"wav": ("album_artist", "disc", "isrc")}


def name_ok(name: Column) -> Column:
    """One to 64 ASCII letters, digits and signs of ``_-.``; null is no name."""
    return F.coalesce(name.rlike(f"^[A-Za-z0-9_.\\-]{{1,{NAME_BYTES}}}\\z"), F.lit(False))


def text_ok(text: Column) -> Column:
    """Texts of tags hold no zero character."""
    return F.coalesce(~F.contains(text, F.lit("\0")), F.lit(True))


def inside(value: Column, low: float, high: float, zero_is_off: bool = False) -> Column:
    """Whether a number is finite and within bounds, or 0 where that means off."""
    x = value.cast("double")
    fits = (x >= low) & (x <= high) & ~F.isnan(x)
    return F.coalesce(fits | (x == 0) if zero_is_off else fits, F.lit(False))


def rate_ok(rate: Column) -> Column:
    return inside(rate, *RATES)


def pitch_ok(semitones: Column) -> Column:
    return inside(semitones, *SEMITONES)


def channel_mask(channels: Column) -> Column:
    """The speaker bits of a layout; null for numbers of channels that have none."""
    return F.get(F.lit([MASKS.get(n) for n in range(max(MASKS) + 1)]), channels.cast("int"))


def canonical_tag(name: Column) -> Column:
    """The tag that a file's name for it means; null for unknown ones."""
    known = F.create_map(*(F.lit(x) for tag, names in TAGS.items() for n in names for x in (n, tag)))
    return F.try_element_at(known, F.lower(name))


def tag_faults(tags: DataFrame, container: Column) -> DataFrame:
    """(clip, tag, fault) of (clip, name, value): what a clip's container can't keep. The last value of a tag does not say
    more than the first: several are a fault, too."""
    named = tags.withColumn("tag", canonical_tag(F.col("name"))).withColumn("_box", container).where("tag is not null")
    unkept = F.lit(False)
    for box, missing in UNKEPT.items():
        unkept = unkept | ((F.col("_box") == box) & F.col("tag").isin(*missing))
    by = named.groupBy("clip", "tag").agg(F.max((~F.col("_box").isin(*TAGGED)).cast("int")).alias("bare"), F.max(unkept.cast("int")).alias("unkept"), F.max((~text_ok(F.col("value"))).cast("int")).alias("zero"), F.count_distinct("value").alias("values"))
    faults = {"no tags in this container": "bare = 1", "no place for this tag": "bare = 0 and unkept = 1", "a zero character": "zero = 1", "several values": "values > 1"}
    return by.select("clip", "tag", F.explode(F.array_compact(F.array(*(F.when(F.expr(wrong), F.lit(name)) for name, wrong in faults.items())))).alias("fault"))


def field_faults(rows: DataFrame, key: str, fields: dict[str, tuple[float, float, bool]], longest: float | None = None, parts: tuple[str, ...] = ("attack", "sustain", "decay")) -> DataFrame:
    """(key, fault): columns that are not within (low, high), or 0 where that means off, and lengths, the sum of ``parts``,
    that are not above 0 or are beyond the longest."""
    wrong = [F.when(~inside(F.col(c), *bounds), F.lit(c)) for c, bounds in fields.items()]
    if longest is not None:
        total = sum((F.col(p).cast("double") for p in parts[1:]), F.col(parts[0]).cast("double"))
        wrong.append(F.when(~F.coalesce((total > 0) & (total <= longest), F.lit(False)), F.lit("duration")))
    return rows.select(key, F.explode(F.array_compact(F.array(*wrong))).alias("fault"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, times): what is defined more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def drum_ms(kind: Column, noise_percent: Column, tone_ms: Column, noise_ms: Column, click_percent: Column) -> Column:
    """How long a hit sounds, muted parts left out: a clap has no tone and bursts before its noise, a click takes 3 ms."""
    tone = F.when((noise_percent < 100) & (kind != "clap"), tone_ms).otherwise(0)
    noise = F.when((noise_percent > 0) & (noise_ms > 0), noise_ms + F.when(kind == "clap", 30).otherwise(0)).otherwise(0)
    return F.greatest(tone, noise, F.when(click_percent > 0, 3).otherwise(0))


def piece_length(notes: DataFrame, bpm: int, ticks_per_quarter: int) -> DataFrame:
    """(ticks, seconds): a piece of (start, length) is as long as its longest track."""
    ends = notes.agg(F.coalesce(F.max(F.col("start") + F.col("length")), F.lit(0)).cast("bigint").alias("ticks"))
    return ends.select("ticks", (F.col("ticks") * 60.0 / (bpm * ticks_per_quarter)).alias("seconds"))
