"""Voices, buses and events: choice, gaps and admission of starts, top voices, placement in space, sums over buses, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import f32, f64
from . import scans
from .shape import TURN

SOUND_SPEED = 343.3


#: Frames of the stretches by which the triggers of one name are dealt: a name may have a large part of all triggers.
SPAN = 1 << 27


def _running(rows: DataFrame, by: str, value: Column, name: str, span: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same key up to this one, by (frame, seq). Rows are summed
    within stretches of time; what comes before a stretch is a sum over one row for each earlier one."""
    parted = rows.withColumn("_part", F.floor(F.col("frame") / span).cast("bigint")).withColumn("_value", value)
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parted.groupBy(by, "_part").agg(F.sum("_value").alias("_sum")).select(F.col(by).alias("_k"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(by, "_part").orderBy("frame", "seq").rowsBetween(Window.unboundedPreceding, 0))
    met = parted.withColumn("_inside", inside).join(sums, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))


def sequence_choice(triggers: DataFrame, sources: int, span: int = SPAN) -> DataFrame:
    """Adds ``choice``: each name takes its sources in turn."""
    numbered = _running(triggers, "name", F.lit(1), "_n", span)
    return numbered.withColumn("choice", F.pmod(F.col("_n") - 1, F.lit(sources))).drop("_n")


def draw(name: Column, number: Column, what: str = "") -> Column:
    """A whole number of 52 bits by name and number: the same at every run, in any order of rows."""
    digest = F.md5(F.concat_ws(":", F.coalesce(name.cast("string"), F.lit("")), F.lit(what), number.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def random_choice(triggers: DataFrame, sources: int, span: int = SPAN) -> DataFrame:
    """Adds ``choice``: each trigger of a name draws one of its sources."""
    numbered = _running(triggers, "name", F.lit(1), "_n", span)
    return numbered.withColumn("choice", F.pmod(draw(F.col("name"), F.col("_n")), F.lit(sources)).cast("int")).drop("_n")


def shuffled_choice(triggers: DataFrame, sources: int, span: int = SPAN) -> DataFrame:
    """Adds ``choice``: each name takes all its sources once a cycle, in an order drawn for the cycle, and never one twice in a
    row: a cycle that would begin with the last one of the cycle before changes its first with one that is not its last, so
    no cycle depends on more than the draws of the one before it. Two sources take turns."""
    numbered = _running(triggers, "name", F.lit(1), "_n", span)
    name, cycle, at = F.col("name"), F.floor((F.col("_n") - 1) / sources).cast("bigint"), F.pmod(F.col("_n") - 1, F.lit(sources)).cast("int")
    if sources == 1:
        return numbered.withColumn("choice", F.lit(0)).drop("_n")
    if sources == 2:
        return numbered.withColumn("choice", F.pmod(draw(name, F.lit(0)) + F.col("_n") - 1, F.lit(2)).cast("int")).drop("_n")
    places = F.sequence(F.lit(0), F.lit(sources - 1))
    order = lambda c: F.transform(F.array_sort(F.transform(places, lambda i: F.struct(draw(name, c * sources + i).alias("d"), i.alias("i")))), lambda x: x["i"])
    dealt = numbered.withColumn("_order", order(cycle)).withColumn("_last", F.when(cycle > 0, F.element_at(order(cycle - 1), sources)))
    other = 1 + F.pmod(draw(name, cycle, "edge"), F.lit(sources - 2)).cast("int")
    twice = F.coalesce(F.element_at("_order", 1) == F.col("_last"), F.lit(False))
    place = F.when(twice & (at == 0), other).when(twice & (at == other), F.lit(0)).otherwise(at)
    return dealt.withColumn("choice", F.get(F.col("_order"), place)).drop("_n", "_order", "_last")


def previous(rows: DataFrame, by: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """Adds ``was_<column>`` of the row before, of the same key by (frame, seq); null for the first. A key's stretches of time are
    dealt apart, and what came last before a stretch is looked up in one row for each."""
    values = F.struct("frame", "seq", *(c for c in columns if c not in ("frame", "seq")))
    parted = rows.withColumn("_part", F.floor(F.col("frame") / span).cast("bigint"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = parted.groupBy(by, "_part").agg(F.max(values).alias("_end")).select(F.col(by).alias("_k"), F.col("_part").alias("_p"), carried.alias("_before"))
    own = F.lag(values).over(Window.partitionBy(by, "_part").orderBy("frame", "seq"))
    met = parted.withColumn("_own", own).join(ends, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("_found", F.coalesce("_own", "_before")).select(*rows.columns, *(F.col(f"_found.{c}").alias(f"was_{c}") for c in columns))


def retargeted_ramps(changes: DataFrame, by: str, initial: float = 1.0, span: int = SPAN) -> DataFrame:
    """Adds ``origin`` to changes (by, frame, seq, value, length): where a straight ramp starts, which is what the one before it
    has reached when it is cut short.

    The value at a change is an affine map of the origin before it, and no more than the target where the ramp has ended. So
    a key falls into islands that begin where ramps ended, and only islands are walked in order.
    """
    met = previous(changes, by, ["frame", "value", "length"], span)
    done = F.when(F.col("was_length") > 0, F.least(F.lit(1.0), (F.col("frame") - F.col("was_frame")) / F.col("was_length"))).otherwise(F.lit(1.0))
    met = met.withColumn("_t", done)
    parts = _running(met, by, F.when(F.col("_t") >= 1, 1).otherwise(0), "_island", span)
    order = Window.partitionBy(by, "_island").orderBy("frame", "seq")
    parts = parts.withColumn("_rank", F.row_number().over(order).cast("bigint"))
    parts = parts.withColumn("_a", 1 - F.col("_t")).withColumn("_b", F.when(F.col("was_value").isNull(), F.lit(float(initial))).otherwise(F.col("_t") * F.col("was_value").cast("double")))
    steps = parts.select(F.col(by).alias("_by"), "_island", (F.col("_rank") - 1).alias("block"), "_a", "_b")
    walked = scans.entered(steps, ["_by", "_island"], ["_a", "_b"], lambda o, v: o * v[:, :1] + v[:, 1:], [float(initial)], ["origin"])
    same = F.col(by).eqNullSafe(F.col("_by")) & (parts["_island"] == walked["_island"]) & (F.col("_rank") == F.col("block"))
    return parts.join(walked, same).select(*changes.columns, "origin")


def islands(triggers: DataFrame, gap: int, by: str, span: int = SPAN) -> DataFrame:
    """Adds ``island``: a number that goes up, within each key, where the trigger before is at least ``gap`` frames ago."""
    parted = triggers.withColumn("_part", F.floor(F.col("frame") / span).cast("bigint"))
    last = F.max("_last").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = parted.groupBy(by, "_part").agg(F.max("frame").alias("_last")).select(F.col(by).alias("_k"), F.col("_part").alias("_p"), last.alias("_before"))
    own = F.lag("frame").over(Window.partitionBy(by, "_part").orderBy("frame", "seq"))
    met = parted.withColumn("_own", own).join(ends, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    since = F.col("frame") - F.coalesce("_own", "_before")
    marked = met.select(*triggers.columns, F.when(since >= gap, 1).otherwise(0).alias("_new"))
    return _running(marked, by, F.col("_new"), "island", span).drop("_new")


def _folded(triggers: DataFrame, keys: list[str], fold, name: str) -> DataFrame:
    """Adds a boolean column by a fold over the frames of each run of equal keys; runs are dealt over tasks and read in order, one batch at a
    time. ``fold(state, frames)`` gives (answers, state) and starts from None."""
    columns = [c for c in triggers.columns if c != "island"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            if not len(rows):
                continue
            heads = rows[keys].fillna("\0null").to_numpy(object)
            starts = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(1)]))
            frames, out = rows["frame"].to_numpy(), np.empty(len(rows), bool)
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                if tuple(heads[a]) != key:
                    key, state = tuple(heads[a]), None
                out[a:e], state = fold(state, frames[a:e])
            yield rows[columns].assign(**{name: out})

    schema = ", ".join(f"{c} {t}" for c, t in triggers.dtypes if c != "island")
    return triggers.repartition(*keys).sortWithinPartitions(*keys, "frame", "seq").mapInPandas(run, f"{schema}, {name} boolean")


def min_gap(triggers: DataFrame, gap: int, by: str = "name") -> DataFrame:
    """Adds ``started``: a trigger starts if the last one of its key that did is at least ``gap`` frames ago.

    A start depends on the one before, so this is a fold; a trigger that has no other within the gap before it starts for
    certain, so every key's time is cut there and the islands are dealt over tasks. Inside one, the fold jumps from start to
    start.
    """

    def fold(last: int | None, frames: np.ndarray) -> tuple[np.ndarray, int | None]:
        started, at = np.zeros(len(frames), bool), 0 if last is None else int(np.searchsorted(frames, last + gap))
        while at < len(frames):
            started[at], last = True, int(frames[at])
            at = max(at + 1, int(np.searchsorted(frames, last + gap)))
        return started, last

    return _folded(islands(triggers, gap, by), [by, "island"], fold, "started")


def admitted(triggers: DataFrame, length: int, most: int, by: str = "name") -> DataFrame:
    """Adds ``admitted``: a start is refused while ``most`` instances of its key, each ``length`` frames long, still sound.

    Nothing sounds any more ``length`` frames after a trigger, so every key's time is cut where that long nothing came, and
    the islands are dealt over tasks.
    """

    def fold(ends: list[int] | None, frames: np.ndarray) -> tuple[np.ndarray, list[int]]:
        ends, out, at = list(ends or []), np.zeros(len(frames), bool), 0  # ends of what sounds, in order: at most ``most``
        while at < len(frames):
            f = int(frames[at])
            while ends and ends[0] <= f:
                ends.pop(0)
            if len(ends) < most:
                out[at] = True
                ends.append(f + length)
                at += 1
            else:  # all until the first of them ends are refused
                at = int(np.searchsorted(frames, ends[0]))
        return out, ends

    return _folded(islands(triggers, length, by), [by, "island"], fold, "admitted")


def physical_voices(voices: DataFrame, most: int) -> DataFrame:
    """The voices (quantum, voice, priority, level, start) that are rendered: the first ones by priority, level and age."""
    order = Window.partitionBy("quantum").orderBy(F.desc("priority"), F.desc("level"), "start", "voice")
    return voices.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def steal_victim(voices: DataFrame) -> DataFrame:
    """(quantum, voice): the voice that goes first, by least priority and greatest age."""
    return voices.groupBy("quantum").agg(F.min_by("voice", F.struct("priority", "start", "voice")).alias("voice"))


def quietest_victim(voices: DataFrame) -> DataFrame:
    """(quantum, voice): the voice that goes first where the quietest does, of equally loud ones the oldest."""
    return voices.groupBy("quantum").agg(F.min_by("voice", F.struct("level", "start", "voice")).alias("voice"))


#: Speakers of each layout, clockwise: channel, and the direction to the right and ahead (fixed values).
_Q, _T, _S, _C = 0.5**0.5, 0.75**0.5, 0.9396926207859084, -0.3420201433256687
SPEAKERS = {
    "quad": [(0, -_Q, _Q), (1, _Q, _Q), (3, _Q, -_Q), (2, -_Q, -_Q)],
    "5.1": [(0, -0.5, _T), (2, 0.0, 1.0), (1, 0.5, _T), (5, _S, _C), (4, -_S, _C)],
    "7.1": [(0, -0.5, _T), (2, 0.0, 1.0), (1, 0.5, _T), (7, 1.0, 0.0), (5, 0.5, -_T), (4, -0.5, -_T), (6, -1.0, 0.0)],
}
LAYOUT_CHANNELS = {"quad": 4, "5.1": 6, "7.1": 8}


def speaker_gains(x: Column, z: Column, layout: str) -> Column:
    """An array of each channel's gain for a direction (right, ahead): of the pair of neighbours that the direction lies
    between, each as much as it takes, to one power in all. No direction is straight ahead."""
    norm = F.sqrt(x * x + z * z)
    aim = F.struct(F.when(norm < 1e-12, 0.0).otherwise(x / norm).alias("x"), F.when(norm < 1e-12, 1.0).otherwise(z / norm).alias("z"))
    ring = SPEAKERS[layout]
    pairs = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("a", "ax", "az", "b", "bx", "bz"), (*one, *two)))) for one, two in zip(ring, [*ring[1:], ring[0]])))

    def solved(p: Column, v: Column) -> Column:
        det = p["ax"] * p["bz"] - p["bx"] * p["az"]
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), ((v["x"] * p["bz"] - v["z"] * p["bx"]) / det).alias("ga"), ((v["z"] * p["ax"] - v["x"] * p["az"]) / det).alias("gb"))

    def gains(p: Column) -> Column:
        ga, gb = F.greatest(p["ga"], F.lit(0.0)), F.greatest(p["gb"], F.lit(0.0))
        each = F.sequence(F.lit(0), F.lit(LAYOUT_CHANNELS[layout] - 1))
        return F.transform(each, lambda c: F.when(c == p["a"], ga).when(c == p["b"], gb).otherwise(0.0) / F.sqrt(ga * ga + gb * gb))

    found = F.flatten(F.transform(F.array(aim), lambda v: F.filter(F.transform(pairs, lambda p: solved(p, v)), lambda p: (p["ga"] >= -1e-12) & (p["gb"] >= -1e-12))))
    return F.element_at(F.transform(F.slice(found, 1, 1), gains), 1)


def seen_by(dx: Column, dy: Column, dz: Column, forward: tuple[float, float, float], up: tuple[float, float, float]) -> tuple[Column, Column]:
    """How far a relative place lies to the right of and ahead of a listener who looks forward."""
    length = lambda v: sum(x * x for x in v) ** 0.5
    f = tuple(v / length(forward) for v in forward)
    r = (f[1] * up[2] - f[2] * up[1], f[2] * up[0] - f[0] * up[2], f[0] * up[1] - f[1] * up[0])
    if length(r) < 1e-9:
        raise ValueError("a listener looks across, not along, what is up")
    r = tuple(v / length(r) for v in r)
    return tuple(dx * float(v[0]) + dy * float(v[1]) + dz * float(v[2]) for v in (r, f))


def place_2d(x: Column, y: Column, width: float, near: float, far: float, model: str) -> tuple[Column, Column]:
    """Pan and gain of a place on a plane."""
    d = F.sqrt(x * x + y * y)
    between = 1 - (d - near) / (far - near) if model == "linear" else (near / d - near / far) / (1 - near / far)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / width)), F.when(d <= near, 1.0).when(d >= far, 0.0).otherwise(between)


def attenuation(distance: Column, near: float, far: float, rolloff: float, model: str) -> Column:
    d = F.greatest(F.lit(near), F.least(F.lit(far), distance))
    if model == "linear":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rolloff * (d - near) / (far - near)))
    return near / (near + rolloff * (d - near)) if model == "inverse" else F.pow(d / near, F.lit(-rolloff))


def doppler(listener_speed: Column, source_speed: Column, factor: float) -> Column:
    """Pitch ratio from speeds towards each other (listener) and apart (source), kept between a quarter and four."""
    edge = 0.9 * SOUND_SPEED
    inside = lambda v: F.greatest(F.lit(-edge), F.least(F.lit(edge), v * factor))
    return F.greatest(F.lit(0.25), F.least(F.lit(4.0), (SOUND_SPEED + inside(listener_speed)) / (SOUND_SPEED + inside(source_speed))))


def stereo_gains(x: Column) -> tuple[Column, Column]:
    """Left and right gains of a direction's sideways part, -1 to 1."""
    turns = (x + 1) / 8
    return F.sin((0.25 - turns) * TURN), F.sin(turns * TURN)


def place_3d(
    emitters: DataFrame,
    listener: DataFrame,
    near: float,
    far: float,
    rolloff: float,
    model: str,
    factor: float = 1.0,
    forward: tuple[float, float, float] = (0.0, 0.0, -1.0),
    up: tuple[float, float, float] = (0.0, 1.0, 0.0),
    layout: str | None = None,
) -> DataFrame:
    """(voice, distance, gain, left, right, ratio) of emitters (voice, x, y, z, vx, vy, vz) for one listener at a place, who looks
    forward; the listener's one row is broadcast. With a layout there are ``gains`` of its channels instead of left and right."""
    met = emitters.crossJoin(F.broadcast(listener.limit(1)))
    dx, dy, dz = (F.col(c) - F.col(f"l{c}") for c in "xyz")
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    safe = F.when(d > 0, d).otherwise(1.0)
    toward = lambda p: (dx * F.col(f"{p}x") + dy * F.col(f"{p}y") + dz * F.col(f"{p}z")) / safe
    aside, ahead = seen_by(dx, dy, dz, forward, up)
    gain = attenuation(d, near, far, rolloff, model)
    if layout is None:
        flat = F.sqrt(aside * aside + ahead * ahead)
        left, right = stereo_gains(F.when(flat > 0, aside / F.when(flat > 0, flat).otherwise(1.0)).otherwise(0.0))
        heard = [(gain * left).alias("left"), (gain * right).alias("right")]
    else:
        heard = [F.transform(speaker_gains(aside, ahead, layout), lambda g: g * gain).alias("gains")]
    return met.select("voice", d.alias("distance"), gain.alias("gain"), *heard, doppler(toward("lv"), toward("v"), factor).alias("ratio"))


def sum_to_buses(voices: DataFrame, frames: DataFrame) -> DataFrame:
    """(bus, channel, frame, sample): voices (clip, bus, start, gain) of clips, each scaled in 64-bit and added."""
    moved = frames.join(voices, "clip").select("bus", "channel", (F.col("frame") + F.col("start")).alias("frame"), f64(f32(f64(F.col("sample")) * F.col("gain"))).alias("x"))
    return moved.groupBy("bus", "channel", "frame").agg(f32(F.sum("x")).alias("sample"))


def topological(edges: list[tuple[int, int]]) -> list[int]:
    """Buses in an order in which every edge leads forward; a cycle is an error. Graphs of buses are small settings."""
    nodes = sorted({x for e in edges for x in e})
    incoming = {n: sum(d == n for _, d in edges) for n in nodes}
    ready, order = [n for n in nodes if not incoming[n]], []
    while ready:
        n = ready.pop(0)
        order.append(n)
        for s, d in edges:
            if s == n:
                incoming[d] -= 1
                if not incoming[d]:
                    ready.append(d)
    if len(order) < len(nodes):
        raise ValueError("buses feed each other in a circle")
    return order


#: A graph of buses is a setting, not data: no more routes than this are allowed.
MAX_ROUTES = 1024


def path_gains(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """(source, bus, gain): how much of what enters ``source`` arrives at each bus below it, added up over all ways there; of
    itself all of it. Graphs of buses are small settings."""
    if len(edges) > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} routes")
    order = topological([(s, d) for s, d, _ in edges])
    arrives = {n: {n: 1.0} for n in order}  # from each source
    for n in order:
        for s, d, g in edges:
            if s == n:
                for below in arrives.values():
                    if n in below:
                        below[d] = below.get(d, 0.0) + below[n] * g
    return [(s, d, g) for s, below in arrives.items() for d, g in below.items()]


def route(buses: DataFrame, edges: list[tuple[int, int, float]]) -> DataFrame:
    """(bus, channel, frame, sample): every bus with what the others send to it, at whatever distance: one pass over the
    samples, a broadcast table of at most the square of the number of buses, and one grouped sum."""
    gains = buses.sparkSession.createDataFrame(path_gains(edges), "_source bigint, _to bigint, _gain double")
    met = buses.join(F.broadcast(gains), F.col("bus") == F.col("_source"), "left")
    sent = met.select(F.coalesce("_to", "bus").cast(buses.schema["bus"].dataType).alias("bus"), "channel", "frame", (f64(F.col("sample")) * F.coalesce("_gain", F.lit(1.0))).alias("x"))
    return sent.groupBy("bus", "channel", "frame").agg(f32(F.sum("x")).alias("sample"))


def solo_edges(edges: DataFrame, soloed: list[int]) -> DataFrame:
    """Edges (src, dst) that sound while buses are soloed: those below a soloed bus, and those on a way to one."""
    routes = [tuple(r) for r in edges.select("src", "dst").distinct().limit(MAX_ROUTES + 1).collect()]
    if len(routes) > MAX_ROUTES:
        raise ValueError(f"more than {MAX_ROUTES} routes")

    def closure(pairs: list[tuple[int, int]]) -> list[int]:
        found = set(soloed)
        while more := {d for s, d in pairs if s in found} - found:
            found |= more
        return sorted(found)

    down, up = closure(routes), closure([(d, s) for s, d in routes])
    src, dst = F.col("src"), F.col("dst")
    return edges.where(src.isin(down) | (src.isin(up) & dst.isin(up))).select("src", "dst").distinct()
