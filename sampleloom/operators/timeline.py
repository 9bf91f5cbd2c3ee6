"""Ticks, frames and controls: tempo maps, note times, ramps and lanes found as of a frame, grids of beats.

Whole-number arithmetic is exact in decimals and rounds once. As-of lookups are one union and one window per key and stretch
of time, so neither side is broadcast and no pair of rows is made that is not wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import ratio_half_up
from .levels import curve
from .shape import TURN


def as_of(rows: DataFrame, changes: DataFrame, keys: list[str], at: str, values: list[str], span: int | None = None) -> DataFrame:
    """Each row with the values of the last change of its keys at or before it; of changes at one place the greatest values,
    none gives null.

    With ``span``, keys are dealt by stretches of so many frames, so that one busy key is many tasks' work: what held at
    the end of a stretch's predecessors comes from one row for each stretch.
    """
    rest = [c for c in rows.columns if c not in [*keys, at]]
    changed = changes.select(*keys, F.col(at), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(f"_r_{c}") for c in rest))
    mine = rows.select(*keys, F.col(at), F.lit(1).alias("_side"), F.lit(None).cast(changed.schema["_v"].dataType).alias("_v"), *(F.col(c).alias(f"_r_{c}") for c in rest))
    both = changed.unionByName(mine).withColumn("_part", F.floor(F.col(at) / span).cast("bigint") if span else F.lit(0))
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_part").orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_found", last).where("_side = 1")
    if span:
        ends = both.groupBy(*keys, "_part").agg(F.max(F.when(F.col("_side") == 0, F.struct(F.col(at), F.col("_v")))).alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        names = [f"_k{i}" for i in range(len(keys))]
        ends = ends.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("_part").alias("_p"), carried["_v"].alias("_before"))
        same = F.col("_part") == F.col("_p")
        for k, n in zip(keys, names):
            same = same & F.col(k).eqNullSafe(F.col(n))
        found = found.join(ends, same, "left").withColumn("_found", F.coalesce("_found", "_before"))
    return found.select(*keys, at, *(F.col(f"_r_{c}").alias(c) for c in rest), *(F.col(f"_found.{v}").alias(v) for v in values))


#: Changes of tempo up to which a tempo map is one array beside every row; longer maps are looked up by stretches of ticks.
MAP_CHANGES = 256
MAP_SPAN = 1 << 16
#: Frames of a stretch of a control lane.
LANE_SPAN = 1 << 27


def tempo_map(changes: DataFrame, rate: int, ticks_per_quarter: int) -> DataFrame:
    """(tick, milli_bpm, before): for each change of tempo, the frames before it as an exact sum over 1e9ths.

    ``changes`` has a row for each change of one piece: few rows, in one window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("tick")
    span = (F.col("tick") - F.lag("tick", 1, 0).over(order)).cast("decimal(20,0)")
    tempo = F.coalesce(F.lag("milli_bpm").over(order), F.col("milli_bpm")).cast("decimal(12,0)")
    part = span * F.lit(rate * 60_000_000).cast("decimal(16,0)") / (tempo * ticks_per_quarter).cast("decimal(18,0)")
    return changes.withColumn("_part", part.cast("decimal(38,9)")).withColumn("before", F.sum("_part").over(order).cast("decimal(38,9)") / 1000).select("tick", "milli_bpm", F.col("before").cast("decimal(30,9)").alias("before"))


def _latest(rows: DataFrame, column: str, table: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """Each row with the ``fields`` of the last entry of a tempo map at or before it, the greatest of those at one place. Maps
    are settings: their entries are counted up to ``MAP_CHANGES``, and up to as many they are one array beside every row."""
    if table.limit(MAP_CHANGES + 1).count() <= MAP_CHANGES:
        whole = table.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), *fields))).alias("_map"))
        met = rows.crossJoin(F.broadcast(whole)).withColumn("_t", F.try_element_at(F.filter("_map", lambda x: x["_at"] <= F.col(column)), F.lit(-1)))
        return met.select(*rows.columns, *(F.col(f"_t.{f}").alias(f) for f in fields))
    return as_of(rows, table.select(F.col(at).alias(column), *fields), [], column, fields, MAP_SPAN)


def ticks_to_frames(rows: DataFrame, column: str, tempos: DataFrame, rate: int, ticks_per_quarter: int) -> DataFrame:
    """Adds ``<column>_frame``: the frame of a tick under a tempo map, halves up."""
    named = tempos.select("tick", F.col("tick").alias("_from"), F.col("milli_bpm").alias("_bpm"), F.col("before").alias("_before"))
    rated = _latest(rows, column, named, "tick", ["_from", "_bpm", "_before"])
    frames = F.col("_before") + ((F.col(column) - F.col("_from")).cast("decimal(20,0)") * F.lit(rate * 60_000).cast("decimal(14,0)") / (F.col("_bpm") * ticks_per_quarter).cast("decimal(18,0)")).cast("decimal(30,9)")
    return rated.select(*rows.columns, F.floor(frames + 0.5).cast("bigint").alias(f"{column}_frame"))


def beat_clock(rows: DataFrame, column: str, tempos: DataFrame, rate: int) -> DataFrame:
    """Adds ``<column>_beats``: the quarter notes up to a frame under a tempo map, exactly, in parts of 1 / (60,000 rate).

    Between the frames of two changes the clock runs in whole numbers, so it never drifts; a change holds from its own
    rounded frame on, of several at one frame the last one.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("tick")  # few rows
    placed = tempos.select("tick", "milli_bpm", F.floor(F.col("before") + 0.5).cast("decimal(20,0)").alias("_frame"))
    part = (F.col("_frame") - F.coalesce(F.lag("_frame").over(order), F.lit(0))) * F.coalesce(F.lag("milli_bpm").over(order), F.lit(0)).cast("decimal(10,0)")
    clock = placed.withColumn("_part", part.cast("decimal(38,0)")).withColumn("_beats", F.sum("_part").over(order).cast("decimal(38,0)"))
    clock = clock.select(F.col("_frame").cast("bigint").alias("_from"), F.col("tick").alias("_tick"), F.col("milli_bpm").alias("_bpm"), "_beats")
    rated = _latest(rows, column, clock.withColumn("_place", F.col("_from")), "_place", ["_tick", "_from", "_bpm", "_beats"])
    beats = F.col("_beats") + (F.col(column) - F.col("_from")).cast("decimal(20,0)") * F.col("_bpm").cast("decimal(10,0)")
    return rated.withColumn(f"{column}_beats", beats.cast("decimal(38,0)")).select(*rows.columns, f"{column}_beats")


def note_frames(notes: DataFrame, rate: int, bpm: int, ticks_per_quarter: int) -> DataFrame:
    """(note, track, on, off, amplitude, cents): frames round down, the gate is eighths of the length."""
    per = F.lit(60 * rate).cast("bigint")
    whole = lambda ticks: F.floor(ticks * per / F.lit(bpm * ticks_per_quarter)).cast("bigint")
    start, end = whole(F.col("start")), whole(F.col("start") + F.col("length"))
    return notes.select(
        "note",
        "track",
        start.alias("on"),
        (start + F.floor((end - start) * F.col("gate") / 8)).cast("bigint").alias("off"),
        (F.col("volume") / 15 * (F.col("velocity") / 127)).alias("amplitude"),
        ((F.col("midi") - 69) * 100).alias("cents"),
    )


def ramp_value(frame: Column, start: Column, length: Column, origin: Column, to: Column, kind: str) -> Column:
    """A ramp at a frame: rising ones follow the curve, falling ones mirror it, and it stays at its end."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (frame - start) / F.greatest(length, F.lit(1).cast("bigint"))))
    rise = origin + (to - origin) * curve(t, kind)
    fall = to + F.abs(to - origin) * curve(1 - t, kind)
    return F.when(frame >= start + length, to).when(to >= origin, rise).otherwise(fall)


def lanes(rows: DataFrame, note_changes: DataFrame, instrument_changes: DataFrame, span: int = LANE_SPAN) -> DataFrame:
    """The control value of each (instrument, note, frame): the note's own lane before its instrument's. An instrument may
    hold a large part of all rows, so its lane is looked up by stretches of ``span`` frames."""
    own = as_of(rows, note_changes, ["instrument", "note"], "frame", ["value"], span).withColumnRenamed("value", "_own")
    both = as_of(own, instrument_changes, ["instrument"], "frame", ["value"], span)
    return both.withColumn("value", F.coalesce("_own", "value")).drop("_own")


def marker_at(rows: DataFrame, markers: DataFrame, keys: list[str], values: list[str], span: int = LANE_SPAN) -> DataFrame:
    """Each row (keys, frame) with the values of the marker (keys, start, end) that holds its frame, the one that starts last;
    null where none does. Markers of one kind do not reach over the next one's start."""
    found = as_of(rows, markers.withColumnRenamed("start", "frame"), keys, "frame", ["end", *values], span)
    return found.select(*rows.columns, *(F.when(F.col("frame") < F.col("end"), F.col(v)).alias(v) for v in values))


def macro_index(age: Column, hz: int, rate: int, size: int, loop_from: int | None) -> Column:
    """Which value of a macro applies at an age in frames: the last one is held, or a loop runs from an index on."""
    step = F.floor(age * hz / rate).cast("bigint")
    if loop_from is None:
        return F.least(step, F.lit(size - 1).cast("bigint"))
    return F.when(step < size, step).otherwise(loop_from + F.pmod(step - loop_from, F.lit(size - loop_from).cast("bigint")))


def lfo(frame: Column, milli_hz: int, rate: int) -> Column:
    """A sine by its exact whole-number phase, which never drifts."""
    period = rate * 1000
    return F.sin(F.pmod(frame * milli_hz, F.lit(period).cast("bigint")) / period * TURN)


def boundary_after(frame: Column, origin: int, rate: int, milli_bpm: int, numerator: int, denominator: int, bar: bool) -> Column:
    """The first beat or bar strictly after a frame; its origin while that is still to come."""
    num, den = rate * 240_000 * (numerator if bar else 1), milli_bpm * denominator
    k = F.floor((frame - origin).cast("decimal(20,0)") * F.lit(den).cast("decimal(12,0)") / F.lit(num).cast("decimal(16,0)")).cast("bigint")
    at = lambda i: ratio_half_up((k + i).cast("decimal(18,0)") * F.lit(num).cast("decimal(12,0)"), F.lit(den)) + origin
    return F.when(frame < origin, F.lit(origin).cast("bigint")).when(at(0) > frame, at(0)).when(at(1) > frame, at(1)).otherwise(at(2))
