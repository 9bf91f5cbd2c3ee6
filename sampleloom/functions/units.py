"""Column functions for units: decibels, cents, notes, positions in time, hashes of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semitones of the letters above C (fixed values).
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def f32(x: Column) -> Column:
    return x.cast("float")


def f64(x: Column) -> Column:
    return x.cast("double")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(f64(x), digits) + 0.0


def to_db(linear: Column) -> Column:
    """20 log10, minus infinity at and below 0."""
    return F.when(linear > 0, 20 * F.log10(linear)).otherwise(F.lit(float("-inf")))


def from_db(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)


def cents_to_hz(cents: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), cents / 1200)


def midi_to_hz(midi: Column) -> Column:
    return cents_to_hz((midi - 69) * 100)


def note_to_midi(name: Column) -> Column:
    """C4 is 60; null for anything that is not a letter, accidentals and an octave, or beyond 0 to 127."""
    letter = F.upper(F.regexp_extract(name, "^([A-Ga-g])", 1))
    marks = F.regexp_extract(name, "^[A-Ga-g]([#b]{0,2})-?[0-9]+$", 1)
    octave = F.regexp_extract(name, "(-?[0-9]+)$", 1)
    base = F.element_at(F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv)), letter)
    midi = base + F.length(F.regexp_replace(marks, "b", "")) - F.length(F.regexp_replace(marks, "#", "")) + (octave.try_cast("int") + 1) * 12
    return F.when(name.rlike("^[A-Ga-g][#b]{0,2}-?[0-9]{1,2}$") & midi.between(0, 127), midi)


def frame_index(seconds: Column, rate: Column | int, frames: Column) -> Column:
    """A position as a frame of the clip: rounded first, negative ones from the end, kept inside."""
    at = F.round(seconds * rate).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(frames, F.when(at < 0, frames + at).otherwise(at)))


def parse_time(text: Column) -> Column:
    """Seconds of ``500ms``, ``1.5s``, ``2``, ``1:02.5`` or ``1:02:03.5``; null for other texts."""
    number = "[0-9]+(?:\\.[0-9]+)?"
    part = lambda p, g=1: F.regexp_extract(text, p, g).try_cast("double")
    clock = f"^([0-9]+):([0-9]{{1,2}}):({number})$"
    short = f"^([0-9]+):({number})$"
    return (
        F.when(text.rlike(f"^-?{number}ms$"), part(f"^(-?{number})ms$") / 1000)
        .when(text.rlike(f"^-?{number}s?$"), part(f"^(-?{number})s?$"))
        .when(text.rlike(clock), part(clock) * 3600 + part(clock, 2) * 60 + part(clock, 3))
        .when(text.rlike(short), part(short) * 60 + part(short, 2))
    )


def format_duration(seconds: Column) -> Column:
    """h:mm:ss.mmm, the fraction rounded."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("bigint"), F.floor(ms / 60_000).cast("bigint") % 60, F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)


def ratio_half_up(numerator: Column, denominator: Column) -> Column:
    """The nearest whole number of a ratio of non-negative whole numbers, halves up, without rounding errors."""
    n, d = numerator.cast("decimal(30,0)"), denominator.cast("decimal(8,0)")
    return F.floor((2 * n + d) / (2 * d)).cast("bigint")


def length_ticks(denominator: Column, dots: Column, ticks_per_quarter: int) -> Column:
    """Ticks of a note of 1/denominator with dots, each of which adds half of what came before; null unless they are whole."""
    whole, halves = F.lit(4 * ticks_per_quarter), F.pow(F.lit(2.0), dots).cast("bigint")
    part = (whole / denominator).cast("bigint")
    return F.when((denominator > 0) & (dots >= 0) & (whole % F.greatest(denominator, F.lit(1)) == 0) & (part % halves == 0), 2 * part - (part / halves).cast("bigint"))


def resampled_index(frame: Column, rate: int, to: int) -> Column:
    """Where a boundary lies after resampling, halves up: boundaries are mapped and subtracted, never rounded lengths added."""
    return F.floor(frame * (to / rate) + 0.5).cast("bigint")


#: Offset and prime of the 64-bit FNV-1a hash (fixed values).
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over the bytes of a text, as 16 hexadecimal digits; products are exact in decimals."""
    raw = F.hex(text.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))
    whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")

    def step(h: Column, c: Column) -> Column:
        low = F.pmod(h, whole(256)).cast("bigint")
        mixed = h - low.cast("decimal(20,0)") + low.bitwiseXOR(c).cast("decimal(20,0)")
        return F.pmod((mixed.cast("decimal(20,0)") * F.lit(str(FNV_PRIME)).cast("decimal(13,0)")).cast("decimal(38,0)"), whole(1 << 64)).cast("decimal(38,0)")

    hashed = F.when(F.length(text) == 0, whole(FNV_OFFSET)).otherwise(F.aggregate(codes, whole(FNV_OFFSET), step))
    return F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 16)), 16, "0")


#: Step and multipliers of a 64-bit counter generator (fixed values).
COUNTER_STEP, COUNTER_MIX = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def counter_mix(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers; products wrap around, which columns of Spark do not do."""
    for shift, by in COUNTER_MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def splitmix64(state: Column) -> Column:
    """The next value of a 64-bit counter generator from its state, as a bigint's bits, by Arrow batches."""

    @F.pandas_udf("bigint")
    def mixed(x: pd.Series) -> pd.Series:
        return pd.Series(counter_mix(x.to_numpy(np.int64).view(np.uint64) + np.uint64(COUNTER_STEP)).view(np.int64))

    return mixed(state)
