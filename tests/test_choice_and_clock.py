"""Choice without folds, ramps cut short, beats of frames and exact sums against plain forms."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.operators import measure, mixing, timeline

RATE, TPQ = 48_000, 48
TEMPOS = [(0, 120_000), (4000, 97_500), (4001, 999_000), (4002, 60_000), (9000, 151_250)]


def triggers(spark, n, names="aab", span=1000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, span), rng.choice(names)) for i in range(n)] + [(n, 5, None), (n + 1, 5, None)]
    return spark.createDataFrame(rows, "seq bigint, frame bigint, name string")


def in_order(df, column):
    out = {}
    for r in df.orderBy("frame", "seq").collect():
        out.setdefault(r.name, []).append(r[column])
    return out


@pytest.mark.parametrize("sources", [1, 2, 3, 5])
def test_shuffles_take_each_source_once_a_cycle_and_none_twice_in_a_row(spark, sources):
    rows = triggers(spark, 400)
    whole = in_order(mixing.shuffled_choice(rows, sources), "choice")
    assert whole == in_order(mixing.shuffled_choice(rows.repartition(7), sources, span=37), "choice")
    for taken in whole.values():
        for i in range(0, len(taken) - sources + 1, sources):
            assert sorted(taken[i : i + sources]) == list(range(sources))
        assert sources == 1 or all(a != b for a, b in zip(taken, taken[1:]))
    if sources > 2:
        assert len({tuple(whole["a"][i : i + sources]) for i in range(0, 200, sources)}) > 3


def test_random_choice_is_even_and_the_same_at_every_run(spark):
    rows = triggers(spark, 900)
    whole = in_order(mixing.random_choice(rows, 3), "choice")
    assert whole == in_order(mixing.random_choice(rows.repartition(5), 3, span=50), "choice")
    assert all(0.2 < whole["a"].count(k) / len(whole["a"]) < 0.47 for k in range(3))


@pytest.mark.parametrize("span", [1 << 27, 50])
def test_ramps_start_where_the_one_before_was_cut_short(spark, span):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "x", "y"]), rng.randint(0, 2000), rng.random(), rng.choice([0, 1, 30, 400])) for i in range(500)] + [(900, None, 3, 0.5, 10), (901, None, 8, 0.1, 10)]
    changes = spark.createDataFrame(rows, "seq bigint, key string, frame bigint, value double, length bigint")
    got = {r.seq: r.origin for r in mixing.retargeted_ramps(changes, "key", 0.25, span).collect()}
    state = {}
    for seq, key, frame, value, length in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        origin = 0.25
        if key in state:
            was, at, to, n = state[key]
            t = min(1.0, (frame - at) / n) if n else 1.0
            origin = was + (to - was) * t
        assert got[seq] == pytest.approx(origin)
        state[key] = (origin, frame, value, length)
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [timeline.MAP_CHANGES, 2])
def test_beats_of_frames(spark, most, monkeypatch):
    monkeypatch.setattr(timeline, "MAP_CHANGES", most)
    tempos = timeline.tempo_map(spark.createDataFrame(TEMPOS, "tick bigint, milli_bpm int"), RATE, TPQ)
    before, at = Fraction(0), []
    for (tick, bpm), (next_tick, _) in zip(TEMPOS, [*TEMPOS[1:], (0, 0)]):
        at.append((int(before + Fraction(1, 2)), bpm))
        before += Fraction((next_tick - tick) * RATE * 60_000, bpm * TPQ)
    frames = sorted({0, 1, 10**9, *(f + d for f, _ in at for d in (-1, 0, 1) if f + d >= 0)})
    rows = spark.createDataFrame([(f, "x") for f in frames], "frame bigint, other string")
    got = {r.frame: int(r.frame_beats) for r in timeline.beat_clock(rows, "frame", tempos, RATE).collect()}
    for f in frames:
        parts, here = 0, 0
        for k, (start, bpm) in enumerate(at):
            if start <= f:
                parts, here = (parts + (start - at[k - 1][0]) * at[k - 1][1] if k else 0), k
        assert got[f] == parts + (f - at[here][0]) * at[here][1]
    ticks = spark.createDataFrame([(t,) for t in range(0, 12_000, 7)], "tick bigint")
    there = timeline.beat_clock(timeline.ticks_to_frames(ticks, "tick", tempos, RATE, TPQ), "tick_frame", tempos, RATE)
    for r in there.collect():  # ticks to frames to ticks, within what a frame or two are worth
        assert abs(Fraction(int(r.tick_frame_beats) * TPQ, RATE * 60_000) - r.tick) <= Fraction(3 * 999_000 * TPQ, RATE * 60_000)


def test_exact_sums_are_the_same_at_any_number_of_partitions(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=4000) * 10.0 ** rng.integers(-30, 9, 4000)).astype(np.float32)
    x[:6] = [0.0, -0.0, 65536.0, np.float32(65535.996), 2.0**-32, -(2.0**-16)]
    frames = spark.createDataFrame([(i % 3, 0, i, float(v)) for i, v in enumerate(x)], "clip bigint, channel int, frame bigint, sample float")
    limbs = [sorted(tuple(r) for r in measure.exact_limbs(frames.repartition(n), ["clip"]).collect()) for n in (1, 7, 200)]
    levels = [sorted(tuple(r) for r in measure.exact_levels(frames.repartition(n)).collect()) for n in (1, 7, 200)]
    assert limbs[0] == limbs[1] == limbs[2] and levels[0] == levels[1] == levels[2]
    for clip in range(3):
        own = [Fraction(float(v)) for v in x[clip::3]]
        for power, name in ((1, "total"), (2, "squares")):
            found = sum(Fraction(int(r[2 + power])) * Fraction(2) ** ((16 * r[1] - 26) * power) for r in limbs[0] if r[0] == clip)
            assert found == sum(v**power for v in own), name
        assert levels[0][clip][3] == pytest.approx(float(sum(v * v for v in own) / len(own)), rel=1e-14)
    assert measure.exact_levels(frames.limit(0)).collect() == [] and frames.where(F.col("sample") == 0).count() == 2
