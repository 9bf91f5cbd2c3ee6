"""Gains, fades, offsets, normalisation and quantisation of long frames: pointwise columns, and one aggregate where a
level is needed first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import COUNTER_STEP, counter_mix, f32, f64, from_db
from .measure import clip_levels, loudness, true_peak
from .shape import TURN, with_length


def _with(frames: DataFrame, value: Column) -> DataFrame:
    return frames.select("clip", "channel", "frame", f32(value).alias("sample"))


def gain(frames: DataFrame, linear: float | Column) -> DataFrame:
    return _with(frames, f64(F.col("sample")) * (linear if isinstance(linear, Column) else F.lit(float(linear))))


def gain_db(frames: DataFrame, db: float) -> DataFrame:
    return gain(frames, from_db(db))


def curve(t: Column, kind: str) -> Column:
    """A rise from 0 to 1: linear, a quarter turn of sine, or a square."""
    return {"linear": t, "equal_power": F.sin(t / 4 * TURN), "exponential": t * t}[kind]


def fade(frames: DataFrame, fade_in: int, fade_out: int, kind: str) -> DataFrame:
    """Fades of so many frames; the last frame of a fade reaches its end, and overlapping fades multiply."""
    sized = with_length(frames)
    n, f = F.col("frames"), F.col("frame")
    rise, fall = F.least(F.lit(fade_in).cast("bigint"), n), F.least(F.lit(fade_out).cast("bigint"), n)
    one = F.lit(1).cast("bigint")
    up = F.when(f < rise, curve(f64(f) / F.greatest(rise - 1, one), kind)).otherwise(1.0)
    down = F.when(f >= n - fall, curve(f64(n - 1 - f) / F.greatest(fall - 1, one), kind)).otherwise(1.0)
    return _with(sized, f64(F.col("sample")) * up * down)


def remove_dc(frames: DataFrame) -> DataFrame:
    means = frames.groupBy("clip", "channel").agg(F.avg(f64(F.col("sample"))).alias("_mean"))
    return _with(frames.join(means, ["clip", "channel"]), f64(F.col("sample")) - F.col("_mean"))


def normalize(frames: DataFrame, to: float, by: str = "peak", rate: int = 48_000, ceiling: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """The frames at the target level, and a report (clip, measured, gain_db, limited_by_peak). Silent and wholly gated clips
    stay as they are.

    ``by`` is peak, true_peak, rms or lufs; the gain by loudness is kept so low that true peaks stay under the ceiling, which
    the report says.
    """
    wanted, most = to - F.col("measured"), F.lit(None).cast("double")
    if by == "lufs":
        if rate < 4000:
            raise ValueError("loudness needs a rate of 4000 Hz at least")
        level = loudness(frames, rate).join(true_peak(frames), "clip").select("clip", F.col("lufs").alias("measured"), F.col("true_peak_db").alias("_peak"))
        most = ceiling - F.col("_peak")
    elif by == "true_peak":
        level = true_peak(frames).select("clip", F.col("true_peak_db").alias("measured"))
    else:
        level = clip_levels(frames).select("clip", F.col({"peak": "peak_db", "rms": "rms_db"}[by]).alias("measured"))
    heard = F.col("measured") > float("-inf")
    report = level.select("clip", "measured", F.when(heard, F.least(wanted, most)).otherwise(0.0).alias("gain_db"), (heard & F.coalesce(wanted > most, F.lit(False))).alias("limited_by_peak"))
    return gain(frames.join(report, "clip"), from_db(F.col("gain_db"))), report


def saturate(frames: DataFrame, drive_db: float, output_db: float) -> DataFrame:
    """v - v³/3 of the driven sample, 2/3 beyond 1."""
    v = f64(F.col("sample")) * from_db(drive_db)
    shaped = F.when(F.abs(v) < 1, v - v * v * v / 3).otherwise(F.signum(v) * (2.0 / 3.0))
    return _with(frames, shaped * from_db(output_db))


#: Bytes, and the first code that is beyond the range, of linear formats.
BITS = {"u8": 8, "s8": 8, "s16": 16, "s24": 24, "s32": 32}


def round_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def dither(channel: Column, frame: Column, seed: int) -> Column:
    """Triangular noise of up to one code, drawn for a place: two draws of a 64-bit counter generator that starts at a mix of
    seed and channel, so any frame is drawn without those before it, by Arrow batches."""

    @F.pandas_udf("double")
    def noise(c: pd.Series, f: pd.Series) -> pd.Series:
        step, place = np.uint64(COUNTER_STEP), f.to_numpy(np.int64).view(np.uint64) * np.uint64(2)
        start = counter_mix(np.uint64(seed % (1 << 64)) ^ ((c.to_numpy(np.int64).view(np.uint64) + np.uint64(1)) * step))
        one, two = ((counter_mix(start + (place + np.uint64(k)) * step) >> np.uint64(11)).astype(np.float64) / (1 << 53) for k in (1, 2))
        return pd.Series(one - two)

    return noise(channel, frame)


def quantize(frames: DataFrame, kind: str, seed: int | None = None) -> DataFrame:
    """(clip, channel, frame, code): full scale is 2^(bits-1); codes are kept in range, unsigned ones are offset. With a seed,
    triangular noise is added before rounding."""
    full = float(1 << (BITS[kind] - 1))
    exact = f64(F.col("sample")) * full
    if seed is not None:
        exact = exact + dither(F.col("channel"), F.col("frame"), seed)
    code = F.greatest(F.lit(-full), F.least(F.lit(full - 1), round_away(exact)))
    return frames.select("clip", "channel", "frame", (code + (128 if kind == "u8" else 0)).cast("bigint").alias("code"))


def dequantize(codes: DataFrame, kind: str) -> DataFrame:
    full = float(1 << (BITS[kind] - 1))
    return codes.select("clip", "channel", "frame", f32((F.col("code") - (128 if kind == "u8" else 0)) / full).alias("sample"))


def ulaw_encode(code: Column) -> Column:
    """8-bit mu-law of a 16-bit code: bias 132, clip 32635, inverted bits (fixed values)."""
    magnitude = F.least(F.abs(code.cast("int")), F.lit(32635)) + 132
    exponent = (F.floor(F.log2(magnitude.cast("double"))) - 7).cast("int")
    mantissa = F.floor(magnitude / F.pow(F.lit(2.0), exponent + 3)).cast("int").bitwiseAND(F.lit(15))
    return F.lit(255) - (F.when(code < 0, 128).otherwise(0) + exponent * 16 + mantissa)


def ulaw_decode(byte: Column) -> Column:
    raw = F.lit(255) - byte.cast("int")
    exponent, mantissa = F.floor(raw % 128 / 16).cast("int"), raw % 16
    size = ((mantissa * 8 + 132) * F.pow(F.lit(2.0), exponent)).cast("int") - 132
    return F.when(raw >= 128, -size).otherwise(size)


def alaw_encode(code: Column) -> Column:
    """8-bit A-law of a 16-bit code; even bits are inverted, the sign bit is set for codes from 0 (fixed values)."""
    c = code.cast("int")
    size = F.when(c >= 0, c).otherwise(-c - 1)
    exponent = F.when(size >= 256, (F.floor(F.log2(size.cast("double"))) - 7).cast("int")).otherwise(0)
    mantissa = F.floor(size / F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) + 3)).cast("int").bitwiseAND(F.lit(15))
    return (exponent * 16 + mantissa).bitwiseXOR(F.when(c >= 0, F.lit(0xD5)).otherwise(F.lit(0x55)))


def alaw_decode(byte: Column) -> Column:
    raw = byte.cast("int").bitwiseXOR(F.lit(0x55))
    exponent, mantissa = F.floor(raw % 128 / 16).cast("int"), raw % 16
    size = F.when(exponent == 0, mantissa * 16 + 8).otherwise(((mantissa * 16 + 264) * F.pow(F.lit(2.0), exponent - 1)).cast("int"))
    return F.when(raw >= 128, size).otherwise(-size)
