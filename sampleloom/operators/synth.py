"""Generators: oscillators by phase, sound effects in closed form, drums, notes summed to tracks.

A sample depends on its own frame only wherever the pitch is given in closed form, so frames are exploded and computed as
columns; nothing has to be rendered in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import cents_to_hz, f32, f64
from .shape import TURN

CYCLE = 1 << 32


def increment(hz: Column, rate: int) -> Column:
    """Steps of a 32-bit phase for each frame."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(rate / 2), hz)) / rate * float(CYCLE) + 0.5).cast("bigint")


def phase(step: Column, frame: Column) -> Column:
    """The phase, 0 to 1, after so many frames of one step: exact, whatever the frame."""
    low = F.pmod(frame, F.lit(1 << 20))
    high = F.floor(frame / (1 << 20)).cast("bigint")
    whole = F.pmod(F.pmod(step * low, F.lit(CYCLE)) + F.pmod(F.pmod(step * (1 << 20), F.lit(CYCLE)) * F.pmod(high, F.lit(1 << 12)), F.lit(CYCLE)), F.lit(CYCLE))
    return whole / float(CYCLE)


def wave(t: Column, kind: str, duty: float | Column = 0.5) -> Column:
    """The plain shapes at a phase."""
    return {
        "pulse": F.when(t < duty, 1.0).otherwise(-1.0),
        "saw": 2 * t - 1,
        "triangle": F.when(t < 0.5, 4 * t - 1).otherwise(3 - 4 * t),
        "sine": F.sin(t * TURN),
    }[kind]


def edge_correction(t: Column, dt: Column) -> Column:
    """What a band-limited step of height 2 adds near its edge."""
    a, b = t / dt, (t - 1) / dt
    return F.when(t < dt, 2 * a - a * a - 1).when(t > 1 - dt, b * b + 2 * b + 1).otherwise(0.0)


def smooth_wave(t: Column, dt: Column, kind: str, duty: float | Column = 0.5) -> Column:
    """Pulse and saw with corrected edges."""
    if kind == "saw":
        return wave(t, "saw") - edge_correction(t, dt)
    fall = F.pmod(t - duty + 1, F.lit(1.0))
    return wave(t, "pulse", duty) + edge_correction(t, dt) - edge_correction(fall, dt)


def exploded(rows: DataFrame, frames: Column) -> DataFrame:
    """A row for each frame from 0 on."""
    return rows.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), (frames - 1).cast("bigint"))))


def effect_frequency(n: Column, rate: int) -> Column:
    """Hz of a sound effect (frequency, slide, slide_change, arpeggio, arpeggio_at, vibrato_depth, vibrato_speed, repeat) at
    frame n; time restarts every ``repeat`` frames but for vibrato."""
    m = F.pmod(n, F.col("repeat"))
    t = m / rate
    octaves = F.col("slide") * t + F.col("slide_change") * t * t / 2
    octaves = octaves + F.when(m >= F.col("arpeggio_at"), F.col("arpeggio") / 12).otherwise(0.0)
    octaves = octaves + F.when(F.col("vibrato_depth") > 0, F.col("vibrato_depth") / 12 * F.sin(F.col("vibrato_speed") * n / rate * TURN)).otherwise(0.0)
    return F.col("frequency") * F.pow(F.lit(2.0), octaves)


def effect_level(n: Column) -> Column:
    """Attack, sustain with punch, decay, in frames."""
    a, s, d = F.col("attack"), F.col("sustain"), F.col("decay")
    return F.when(n < a, n / a).when(n < a + s, 1 + F.col("punch") * (1 - (n - a) / s)).otherwise(1 - (n - a - s) / d)


def render_effects(effects: DataFrame, rate: int) -> DataFrame:
    """(effect, frame, sample): triangle-wave effects; the phase is the running sum of each frame's step."""
    each = exploded(effects, F.col("attack") + F.col("sustain") + F.col("decay"))
    stepped = each.withColumn("_step", increment(effect_frequency(F.col("frame"), rate), rate))
    order = Window.partitionBy("effect").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    t = F.pmod(F.coalesce(F.sum("_step").over(order), F.lit(0)), F.lit(CYCLE)) / float(CYCLE)
    return stepped.select("effect", "frame", f32(wave(t, "triangle") * effect_level(F.col("frame")) * F.col("volume")).alias("sample"))


def swept_cents(base: Column, age: Column, slide: Column, vibrato: tuple[float, int, int] | None = None, arpeggio: tuple[list[int], int] | None = None) -> Column:
    """The pitch of a note at an age in frames: a slide by so many cents a frame, a vibrato (cents, period, delay) as a sine and
    an arpeggio (semitones, frames of a step) in turn."""
    cents = base + slide * age
    if vibrato:
        depth, period, delay = vibrato
        turn = F.pmod(age - delay, F.lit(period)) / period
        cents = cents + F.when(age >= delay, depth * F.sin(turn * TURN)).otherwise(0.0)
    if arpeggio:
        offsets, step = arpeggio
        cents = cents + F.get(F.lit(offsets), F.pmod(F.floor(age / step), F.lit(len(offsets))).cast("int")) * 100
    return cents


def swept_duty(age: Column, first: float, duties: list[float], step: int) -> Column:
    """The duty of a pulse at an age in frames: the first for one step, then the others in turn; the last one stays."""
    place = F.least(F.floor(age / step) - 1, F.lit(len(duties) - 1).cast("bigint")).cast("int")
    return F.when(age >= step, F.get(F.lit([float(d) for d in duties]), F.greatest(place, F.lit(0)))).otherwise(float(first))


#: Frames of a stretch of a note whose phase steps are added up by themselves.
STRETCH = 1 << 14


def summed_phase(rows: DataFrame, by: str, step: Column, stretch: int = STRETCH) -> DataFrame:
    """Adds ``phase``, 0 to 1, before each frame of (by, frame, …): whole-number steps of all frames before it. They are added
    up within stretches of frames, and what comes before a stretch is carried into it by one row, so a long note is many
    tasks' work and never drifts. Nothing is joined: Spark takes exploded frames for as few as their notes, and would
    broadcast them."""
    parted = rows.withColumn("_part", F.floor(F.col("frame") / stretch).cast("bigint")).withColumn("_step", step).withColumn("_own", F.lit(True))
    before = F.sum("_step").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parted.groupBy(by, "_part").agg(F.sum("_step").alias("_step"))
    carried = sums.select(by, "_part", before.alias("_step"), F.lit(False).alias("_own")).where("_step is not null")
    inside = F.sum("_step").over(Window.partitionBy(by, "_part").orderBy("_own", "frame").rowsBetween(Window.unboundedPreceding, -1))
    met = parted.unionByName(carried, allowMissingColumns=True).withColumn("_before", F.coalesce(inside, F.lit(0))).where("_own")
    return met.select(*rows.columns, (F.pmod(F.col("_before"), F.lit(CYCLE)) / float(CYCLE)).alias("phase"))


def drum_level(age: Column, length: int, attack: int) -> Column:
    rest = 1 - age / length
    return rest * rest * F.least(F.lit(1.0), age / attack)


def adsr(age: Column, held: Column, attack: int, decay: int, sustain: float, release: int) -> Column:
    """Straight stages; release falls from whatever level it meets."""
    level = lambda a: F.when(a < attack, a / attack).when(a < attack + decay, 1 - (1 - sustain) * (a - attack) / decay).otherwise(sustain)
    return F.when(age < held, level(age)).otherwise(F.greatest(F.lit(0.0), level(held) * (1 - (age - held) / release)))


def render_notes(notes: DataFrame, rate: int, kind: str = "triangle", gain: float = 0.25, attack: int = 32, decay: int = 64, sustain: float = 0.5, release: int = 64) -> DataFrame:
    """(track, frame, sample): notes (track, on, off, cents, amplitude) as waves under an envelope, added up by frame."""
    held = F.col("off") - F.col("on")
    each = exploded(notes, held + release)
    age = F.col("frame")
    t = phase(increment(cents_to_hz(F.col("cents")), rate), age)
    x = wave(t, kind) * adsr(age, held, attack, decay, sustain, release) * F.col("amplitude")
    placed = each.select("track", (F.col("on") + age).alias("frame"), x.alias("x"))
    return placed.groupBy("track", "frame").agg(f32(F.sum(f64(F.col("x"))) * gain).alias("sample"))


def timer(hz: Column) -> Column:
    """The 11-bit timer of a chip's clock for a pitch (the clock is a fixed value)."""
    return F.greatest(F.lit(0), F.least(F.lit(2047), F.floor(1_789_773 / (16 * hz) - 1 + 0.5).cast("int")))


def lfsr_period(tap: int, start: int = 1) -> int:
    """States of a 15-bit shift register before it repeats."""
    state, n = start, 0
    while True:
        bit = (state ^ (state >> tap)) & 1
        state, n = (state >> 1) | (bit << 14), n + 1
        if state == start:
            return n
