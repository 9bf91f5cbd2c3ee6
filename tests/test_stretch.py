"""Tempo and pitch over blocks against the plain form on whole clips, and how often their frames travel."""

import math
import re

import numpy as np
import pytest

import __spark_entry__
from sampleloom.operators import dsp, kernels
from sampleloom.sources import bindings

from .test_operators import plain_tempo

DATA = "/root/testdata/sf0.001"
FRAMES = "clip bigint, channel int, frame bigint, sample float"


def frame_table(spark, signals):
    return spark.createDataFrame([(clip, c, f, float(v)) for (clip, c), x in signals.items() for f, v in enumerate(x)], FRAMES)


def collected(df):
    out = {}
    for r in df.orderBy("clip", "channel", "frame").collect():
        assert r.frame == len(out.setdefault((r.clip, r.channel), []))
        out[r.clip, r.channel].append(r.sample)
    return out


def clips():
    rng = np.random.default_rng(11)
    return {i: [rng.normal(0, 0.3, n).astype(np.float32) for _ in range(1 + i % 2)] for i, n in enumerate([1, 2, 127, 128, 129, 256, 300, 999, 1500])}


def as_signals(all_clips):
    return {(i, c): x for i, channels in all_clips.items() for c, x in enumerate(channels)}


@pytest.mark.parametrize("factor", [0.8, 1.7, 0.3])
def test_tempo_over_blocks(spark, factor):
    made = clips()
    got = collected(dsp.tempo(frame_table(spark, as_signals(made)), factor, 4000, block=100))
    for i, channels in made.items():
        for c, want in enumerate(plain_tempo(channels, factor, 4000)):
            assert len(got.get((i, c), [])) == len(want) and np.allclose(got.get((i, c), []), want, atol=1e-5)


@pytest.mark.parametrize("semitones", [3.0, -5.0, 30.0, -31.0])
@pytest.mark.parametrize("block", [100, 1 << 14])
def test_pitch_over_blocks(spark, semitones, block):
    made, ratio = clips(), 2 ** (semitones / 12)
    got = collected(dsp.pitch(frame_table(spark, as_signals(made)), semitones, 4000, block=block))
    for i, channels in made.items():
        n = len(channels[0])
        for c, slow in enumerate(plain_tempo(channels, 1 / ratio, 4000)):
            want = kernels.resample(slow.astype(np.float32), 1 / ratio)[:n]
            want = np.concatenate([want, np.zeros(n - len(want))])
            assert len(got[i, c]) == n and np.allclose(got[i, c], want, atol=1e-5)


def test_pitch_fills_channels_up_to_the_clip(spark):
    """Channels that are shorter or missing have zeros, and a clip without its first channel is silent."""
    x = np.random.default_rng(2).normal(0, 0.3, 900).astype(np.float32)
    got = collected(dsp.pitch(frame_table(spark, {(1, 0): x, (1, 2): x[:400], (2, 1): x}), 3.0, 4000, block=100))
    assert {k: len(v) for k, v in got.items()} == {k: 900 for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1))}
    assert any(got[1, 0]) and any(got[1, 2][:300]) and not any(got[1, 2][600:])
    assert not any(got[1, 1]) and not any(got[2, 0]) and not any(got[2, 1])


@pytest.mark.parametrize("name", ["tempo", "pitch"])
def test_frames_travel_for_the_search_and_for_their_blocks_only(spark, name, monkeypatch):
    """No joins of frames, and tasks by the number of lines, not by the session's settings."""
    monkeypatch.setattr(bindings, "LINES_A_TASK", 100)
    out = __spark_entry__.queries()[name](spark, DATA)
    least = math.ceil(bindings.table(spark, DATA, "lineitem").count() / 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    dealt = re.findall(r"Exchange hashpartitioning\((.+), (\d+)\)", plan)
    assert {tuple(re.findall(r"(\w+)#", keys)) for keys, _ in dealt} == {("l_suppkey",), ("clip", "channel"), ("clip", "block")}
    assert {int(n) for _, n in dealt} == {least} and out.rdd.getNumPartitions() == least
