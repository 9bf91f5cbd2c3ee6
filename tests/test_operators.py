"""Operators on small fixtures whose results are known or computed the plain way."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import units
from sampleloom.operators import dsp, kernels, levels, measure, mixing, shape, synth, timeline, voice
from sampleloom.sources import containers


def frames_of(spark, clips, rate=None):
    rows = [(c, ch, i, float(np.float32(v))) for c, channels in clips.items() for ch, xs in enumerate(channels) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "clip long, channel int, frame long, sample float")


def samples(df, clip=1, channel=0):
    return [r.sample for r in df.where(f"clip = {clip} and channel = {channel}").orderBy("frame").collect()]


def near(a, b, tol=1e-6):
    return len(a) == len(b) and np.allclose(a, b, atol=tol)


def slow_biquad(x, c):
    b0, b1, b2, a1, a2 = c
    x1 = x2 = y1 = y2 = 0.0
    out = []
    for v in x:
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x1, x2, y1, y2 = v, x1, y, y1
        out.append(y)
    return out


def test_editing(spark):
    f = frames_of(spark, {1: [[1, 2, 3, 4]]})
    assert samples(shape.cut(f, 0.001, -0.001, 1000)) == [2, 3]
    assert samples(shape.remove(f, 0.001, 0.003, 1000)) == [1, 4]
    assert samples(shape.pad(f, 1, 2)) == [0, 1, 2, 3, 4, 0, 0]
    assert samples(shape.reverse(f)) == [4, 3, 2, 1]
    assert samples(shape.mix(f, f, -2, 0.5, True)) == [2.5, 4, 3, 4]
    assert samples(shape.mix(f, f, 3, 1.0, True)) == [1, 2, 3, 5, 2, 3, 4]
    assert samples(shape.mix(f, f, 3, 1.0, False)) == [1, 2, 3, 5]
    assert near(samples(shape.crossfade(f, f, 2)), [1, 2, 3, 2, 3, 4])
    assert samples(shape.as_frames(shape.as_clips(f))) == [1, 2, 3, 4]


def test_channels(spark):
    f = frames_of(spark, {1: [[1, 2], [3, 6]]})
    assert samples(shape.to_mono(f)) == [2, 4]
    assert [samples(shape.to_channels(f, 3), 1, c) for c in range(3)] == [[1, 2], [3, 6], [1, 2]]
    assert samples(shape.map_channels(f, [1, 1]), 1, 1) == [3, 6]
    assert samples(shape.deinterleave(shape.interleave(f), 2), 1, 1) == [3, 6]
    merged = shape.merge([f, frames_of(spark, {1: [[7]]})])
    assert samples(merged, 1, 2) == [7, 0]
    centre = shape.pan(f, 0.0)
    assert near(samples(centre, 1, 0), samples(centre, 1, 1)) and near(samples(centre), [2 * math.sqrt(0.5), 4 * math.sqrt(0.5)])


def test_measurements(spark):
    f = frames_of(spark, {1: [[-0.8, 0.9, -0.2, 0.1]], 2: [[0.0, 0.0]]})
    rows = {r.clip: r for r in measure.clip_levels(f).collect()}
    assert rows[1].peak == pytest.approx(0.9) and rows[2].peak_db == float("-inf") and rows[2].mean_square == 0
    wave = {(r.clip, r.bucket): (r.lo, r.hi) for r in measure.waveform(f, 2).collect()}
    assert wave[1, 0] == pytest.approx((-0.8, 0.9)) and wave[1, 1] == pytest.approx((-0.2, 0.1))
    few = {r.bucket: r.hi for r in measure.waveform(frames_of(spark, {1: [[0.5, 0.25]]}), 5).collect()}
    assert few == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.25, 4: 0.25}
    quiet = measure.threshold_silence(f, 0.15).orderBy("clip").collect()
    assert [(r.leading, r.trailing) for r in quiet] == [(0, 1), (2, 2)]


def test_silent_ranges_and_trim(spark):
    f = frames_of(spark, {1: [[0] * 8 + [0.9] * 4 + [0] * 6]})
    ranges = sorted((r.start, r.end) for r in measure.silent_ranges(f, -40.0, 4, 2).collect())
    assert ranges == [(0, 8), (12, 18)]
    assert near(samples(measure.trim_silence(f, -40.0, 4, 2)), [0.9] * 4)
    assert near(samples(measure.trim_silence(f, -40.0, 4, 2, padding=1)), [0] + [0.9] * 4 + [0])


def test_biquads_against_the_recurrence():
    x = np.random.default_rng(1).normal(size=1000)
    for kind in ("lowpass", "highpass", "bandpass", "notch", "allpass", "peaking", "lowshelf", "highshelf"):
        c = kernels.biquad_coefficients(kind, 900.0, 48_000, 0.9, 5.0)
        assert np.allclose(kernels.biquad(x, c), slow_biquad(x, c), atol=1e-9)
    with pytest.raises(ValueError):
        kernels.biquad_coefficients("lowpass", 30_000.0, 48_000)


def test_loudness_of_a_sine(spark):
    """A full-scale sine of 997 Hz in one channel reads -3.01 LUFS."""
    rate = 8000
    f = frames_of(spark, {1: [np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate)]})
    r = measure.loudness(f, rate).collect()[0]
    assert r.lufs == pytest.approx(-3.01, abs=0.1) and r.range_lu < 0.1 and r.momentary == pytest.approx(r.lufs, abs=0.1)
    silent = measure.loudness(frames_of(spark, {1: [np.zeros(rate)]}), rate).collect()[0]
    assert silent.lufs == float("-inf") and silent.momentary == float("-inf")


def test_true_peak_lies_between_samples(spark):
    x = np.sin(2 * np.pi * (np.arange(400) / 4 + 1 / 8))
    r = measure.true_peak(frames_of(spark, {1: [x]})).collect()[0]
    assert np.abs(x).max() < 0.71 and r.true_peak == pytest.approx(1.0, abs=0.03)


def test_limit_and_normalize(spark):
    f = frames_of(spark, {1: [np.sin(np.arange(600) / 7)], 2: [np.zeros(5)]})
    limited = samples(dsp.limit(f, 1000, -6.0, 5.0, 50.0))
    assert max(map(abs, limited)) <= 10 ** (-6 / 20) + 1e-6
    out, report = levels.normalize(f, -3.0)
    assert max(map(abs, samples(out))) == pytest.approx(10 ** (-3 / 20), abs=1e-6) and samples(out, 2) == [0] * 5
    assert {r.clip: r.gain_db for r in report.collect()}[2] == 0


def test_resample_keeps_a_sine():
    n = np.arange(2000)
    x = np.sin(2 * np.pi * 50 * n / 1000).astype(np.float32)
    y = kernels.resample(x, 1.5)
    want = np.sin(2 * np.pi * 50 * np.arange(3000) / 1500)
    assert len(y) == 3000 and np.abs(y - want)[200:-200].max() < 1e-3


def plain_tempo(channels, factor, rate):
    """Overlap and add by the sample; the first channel decides."""
    n = len(channels[0])
    frames = int(math.floor(n / factor + 0.5))
    window = max(256, int(math.floor(rate * 0.05 + 0.5))) & ~1
    hop, radius, out, weights, last = window // 2, window // 8, np.zeros((len(channels), frames)), np.zeros(frames), 0
    for block, at in enumerate(range(0, frames, hop)):
        due = int(math.floor(block * hop * factor + 0.5))
        if due >= n:
            break
        best = due
        if block and last + hop < n:
            top, template = -math.inf, last + hop
            for c in range(max(0, due - radius), min(due + radius, n - 1) + 1):
                size = min(hop, n - template, n - c)
                a, b = channels[0][template : template + size : 2].astype(float), channels[0][c : c + size : 2].astype(float)
                score = a @ b / math.sqrt(b @ b) if b @ b > 0 else 0.0
                if score > top + 1e-12:
                    top, best = score, c
        size = min(window, frames - at, n - best)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(size) + 0.5) / window)
        weights[at : at + size] += w
        for k, c in enumerate(channels):
            out[k, at : at + size] += c[best : best + size] * w
        last = best
    return np.where(weights > 1e-12, out / np.maximum(weights, 1e-12), 0)


def test_tempo_and_pitch_keep_what_they_promise(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 220 * np.arange(rate) / rate).astype(np.float32)
    f = frames_of(spark, {1: [x, 0.5 * x]})
    hz = lambda y: np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax() * rate / len(y)
    slow = dsp.tempo(f, 0.5, rate)
    left, right = np.array(samples(slow)), np.array(samples(slow, 1, 1))
    assert len(left) == 2 * rate and hz(left) == pytest.approx(220, abs=3) and np.allclose(right, 0.5 * left, atol=1e-6)  # channels stay in step
    high = np.array(samples(dsp.pitch(f, 12, rate)))
    assert len(high) == rate and hz(high) == pytest.approx(440, abs=6)


def test_tempo_against_the_plain_form(spark):
    rng, rate = np.random.default_rng(4), 4000
    channels = [rng.normal(0, 0.3, 1500).astype(np.float32), rng.normal(0, 0.3, 1500).astype(np.float32)]
    for factor in (0.8, 1.7):
        out = dsp.tempo(frames_of(spark, {1: channels}), factor, rate)
        want = plain_tempo(channels, factor, rate)
        for c in (0, 1):
            assert np.allclose(samples(out, 1, c), want[c], atol=1e-5)


def test_effects():
    x = np.zeros(4000, np.float32)
    x[0] = 1
    echo = kernels.delay(x, 100, 0.5, 1.0)
    assert [i for i in np.flatnonzero(np.abs(echo) > 1e-9)[:3]] == [100, 200, 300] and echo[200] == pytest.approx(0.5)
    low, high = kernels.one_pole(x, 500, 8000), kernels.one_pole(x, 500, 8000, True)
    assert np.allclose(low + high, x)
    assert len(set(kernels.bitcrush(np.linspace(-1, 1, 64).astype(np.float32), 3, 0.25).tolist())) <= 8
    steps = kernels.bitcrush(np.linspace(-1, 1, 999), 2.5, 1.0)  # half of each of two quantizers, below full scale
    assert steps.max() == pytest.approx((0.5 + 0.75) / 2) and steps.min() == -1
    gains = kernels.compressor_gains(np.full(3000, 1.0), 8000, -20.0, 4.0, 1.0, 10.0)
    assert gains[-1] == pytest.approx(10 ** (-15 / 20), abs=1e-3)


def test_recurrent_effects_against_their_plain_forms():
    rng, rate = np.random.default_rng(9), 2000
    rows = rng.normal(0, 0.3, (3, 500))

    def line(size):
        return [0.0] * size, [0]

    def plain_reverb(x, channel, decay, damping, wet):
        size = lambda s: max(1, int(math.floor((s + 0.0011 * channel) * rate + 0.5)))
        combs = [[[0.0] * size(s), 0, 0.0] for s in (0.0297, 0.0371, 0.0411, 0.0437)]
        passes = [[[0.0] * size(s), 0] for s in (0.005, 0.0017)]
        out = []
        for v in x:
            y = 0.0
            for c in combs:
                d = c[0][c[1]]
                c[2] = d * (1 - damping) + c[2] * damping
                c[0][c[1]] = v + c[2] * 10 ** (-60 * len(c[0]) / (rate * decay) / 20)
                c[1] = (c[1] + 1) % len(c[0])
                y += d / 4
            for p in passes:
                z = p[0][p[1]] - 0.5 * y
                p[0][p[1]] = y + 0.5 * z
                p[1] = (p[1] + 1) % len(p[0])
                y = z
            out.append(v * (1 - wet) + y * wet)
        return out

    def plain_modulated(x, channel, delay, depth, hz, feedback, spread, wet, taps):
        ring, out = [0.0] * 400, []
        for i, v in enumerate(x):
            heard = 0.0
            for k in range(taps):
                d = (delay + depth * math.sin(2 * math.pi * (i * hz / rate + channel * spread + k / 4))) * rate / 1000
                low = math.floor(i - d)
                rest = i - d - low
                heard += (ring[low % 400] * (1 - rest) + ring[(low + 1) % 400] * rest) / taps
            ring[i % 400] = v + feedback * heard
            out.append(v * (1 - wet) + heard * wet)
        return out

    def plain_phaser(x, channel, centre, depth, hz, feedback, spread, wet):
        state, last, out = [0.0] * 4, 0.0, []
        for i, v in enumerate(x):
            f = min(0.45 * rate, max(1.0, centre * 2 ** (depth * math.sin(2 * math.pi * (i * hz / rate + channel * spread)))))
            g = math.tan(math.pi * f / rate)
            a, y = (g - 1) / (g + 1), v + feedback * last
            for k in range(4):
                z = a * y + state[k]
                state[k], y = y - a * z, z
            last = y
            out.append(v * (1 - wet) + y * wet)
        return out

    for c in (0, 1):
        got = kernels.reverb(rows, rate, 0.8, 0.3, 0.6, c)
        assert all(np.allclose(g, plain_reverb(r, c, 0.8, 0.3, 0.6)) for g, r in zip(got, rows))
        for taps, longest in ((2, 80.0), (1, 20.0)):
            got = kernels.modulated_delay(rows, rate, 8.0, 5.0, 3.0, 0.4, 0.25, 0.5, taps, longest, c)
            assert all(np.allclose(g, plain_modulated(r, c, 8.0, 5.0, 3.0, 0.4, 0.25, 0.5, taps)) for g, r in zip(got, rows))
        got = kernels.phaser(rows, rate, 300.0, 1.5, 4.0, 0.3, 0.5, 0.7, c)
        assert all(np.allclose(g, plain_phaser(r, c, 300.0, 1.5, 4.0, 0.3, 0.5, 0.7)) for g, r in zip(got, rows))


def test_true_peak_limiter(spark):
    rate, n = 8000, np.arange(1200)
    x = 0.99 * np.sin(2 * np.pi * (n / 4 + 1 / 8)) / np.sin(np.pi / 4)  # samples stay near 1, what is between them does not
    f = frames_of(spark, {1: [x, 0.2 * x], 2: [np.full(40, 0.1)], 3: [np.zeros(1)]})
    assert measure.true_peak(f).where("clip = 1").first().true_peak > 1.2
    out = dsp.limit_true_peak(f, rate, -1.0)
    ceiling = 10 ** (-1.3 / 20)
    assert measure.true_peak(out).where("clip = 1").first().true_peak <= ceiling and measure.fine_peaks(out).groupBy().max("peak").first()[0] <= ceiling
    assert near(samples(out, 2), [0.1] * 40) and samples(out, 3) == [0.0] and len(samples(out, 1, 1)) == 1200
    assert np.allclose(np.array(samples(out, 1, 1)), 0.2 * np.array(samples(out)), atol=1e-6)  # linked


@pytest.mark.parametrize("box,kind", [("wav", "u8"), ("wav", "s16"), ("wav", "s24"), ("wav", "f32"), ("wav", "f64"), ("aiff", "s8"), ("aiff", "s16"), ("aiff", "s24"), ("aiff", "f32"), ("au", "s16"), ("au", "s32"), ("au", "f64"), ("caf", "s24"), ("caf", "f32")])
def test_container_round_trips(box, kind):
    x = np.random.default_rng(3).uniform(-1, 1, (33, 2)).astype(np.float32)
    y, rate, said = containers.decode(containers.encode(x, 44_100, box, kind))
    step = 0 if kind[0] == "f" else 1 / (1 << (int(kind[1:]) - 1))
    assert rate == 44_100 and said == kind and y.shape == x.shape and np.abs(x - y).max() <= step


def test_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(containers.encode(np.zeros((4, 1), np.float32), 8000, "wav", "s16"))
    (tmp_path / "b.wav").write_bytes(b"RIFF....WAVEjunk")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in containers.read_files(spark, str(tmp_path), "*.wav").collect()}
    assert rows["a.wav"].frames == 4 and rows["a.wav"].rate == 8000 and rows["a.wav"].error is None
    assert rows["b.wav"].channels is None and rows["b.wav"].error and len(rows) == 2
    big = containers.read_files(spark, str(tmp_path), "*.wav", max_bytes=20).collect()
    assert len(big) == 1


def test_companding(spark):
    codes = spark.range(-32768, 32768, 7).select(F.col("id").cast("int").alias("code"))
    mu = codes.select("code", levels.ulaw_encode(F.col("code")).alias("b")).select("code", "b", levels.ulaw_decode(F.col("b")).alias("d"))
    al = codes.select("code", levels.alaw_encode(F.col("code")).alias("b")).select("code", "b", levels.alaw_decode(F.col("b")).alias("d"))
    for r in [*mu.collect(), *al.collect()]:
        assert 0 <= r.b <= 255 and abs(r.code - r.d) <= max(8, abs(r.code) // 16 + 140)


def test_units(spark):
    texts = ["500ms", "1.5s", "2", "1:02.5", "1:02:03.5", "x", ""]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", units.parse_time(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [0.5, 1.5, 2.0, 62.5, 3723.5, None, None]
    names = {r.n: r.m for r in spark.createDataFrame([(x,) for x in ("C4", "A4", "Bb3", "F#-1", "H2", "C11")], "n string").select("n", units.note_to_midi(F.col("n")).alias("m")).collect()}
    assert names == {"C4": 60, "A4": 69, "Bb3": 58, "F#-1": 6, "H2": None, "C11": None}
    assert [r.h for r in spark.createDataFrame([(0, ""), (1, "a"), (2, "foobar")], "i int, t string").select("i", units.fnv1a(F.col("t")).alias("h")).orderBy("i").collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert spark.range(1).select(units.splitmix64(F.col("id"))).first()[0] == 0xE220A8397B1DCDAF - (1 << 64)
    assert spark.range(1).select(units.format_duration(F.lit(3723.4996))).first()[0] == "1:02:03.500"


def test_as_of_takes_the_last_change(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t long")
    changes = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", 2, 3)], "k string, t long, v int")
    got = sorted(tuple(r) for r in timeline.as_of(rows, changes, ["k"], "t", ["v"]).collect())
    assert got == [("a", 5, 1), ("a", 10, 2), ("b", 1, None)]


def test_boundary_is_strictly_after(spark):
    got = spark.createDataFrame([(0,), (23_999,), (24_000,), (24_001,)], "f long").select("f", timeline.boundary_after(F.col("f"), 0, 48_000, 120_000, 4, 4, False).alias("b")).collect()
    assert {r.f: r.b for r in got} == {0: 24_000, 23_999: 24_000, 24_000: 48_000, 24_001: 48_000}


def test_gap_and_admission(spark):
    t = spark.createDataFrame([(i, f, "x", 0, 0.0) for i, f in enumerate([0, 5, 10, 14, 20])], "seq long, frame long, name string, key long, gain double")
    assert [r.started for r in mixing.min_gap(t, 10).orderBy("seq").collect()] == [True, False, True, False, True]
    assert [r.admitted for r in mixing.admitted(t, 12, 2).orderBy("seq").collect()] == [True, True, False, True, True]


def test_routing_order():
    assert mixing.topological([(1, 2), (2, 3), (1, 3)]) == [1, 2, 3]
    with pytest.raises(ValueError):
        mixing.topological([(1, 2), (2, 1)])


def test_phase_is_exact_far_out(spark):
    step, frame = 123_456_789, 3_000_000_007
    got = spark.range(1).select(synth.phase(F.lit(step).cast("bigint"), F.lit(frame).cast("bigint"))).first()[0]
    assert got == (step * frame % (1 << 32)) / (1 << 32)
    assert synth.lfsr_period(1) == 32767 and synth.lfsr_period(6) == 93


def test_empty_tables(spark):
    f = frames_of(spark, {1: [[1.0]]}).where("false")
    for out in (shape.reverse(f), shape.to_mono(f), measure.clip_levels(f), levels.fade(f, 2, 2, "linear"), measure.silent_ranges(f, -40.0, 1, 1), dsp.filtered(f, "lowpass", 100.0, 1000)):
        assert out.count() == 0


@pytest.mark.parametrize("partitions", [2, 8, 200])
def test_loudness_at_any_partition_count(spark, partitions):
    """Clips shorter than a block, of its length and longer, in one plan; against windows summed by hand."""
    rate, rng = 4000, np.random.default_rng(8)
    clips = {i: [rng.normal(0, 0.3, n), rng.normal(0, 0.1, n)] for i, n in enumerate((480, 1599, 1600, 6920))}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(r.clip, r.block): r.power for r in measure.loudness_blocks(frames_of(spark, clips), rate).collect()}
        rows = {r.clip: r for r in measure.loudness(frames_of(spark, clips), rate).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for i, channels in clips.items():
        p = sum(kernels.k_weighting(np.asarray(c, np.float32), rate).astype(np.float64) ** 2 for c in channels)
        for b in range((len(p) - 1600) // 400 + 1) if len(p) >= 1600 else [-1]:
            want[i, b] = p.mean() if b < 0 else p[b * 400 : b * 400 + 1600].mean()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-5) for k in want)
    for i in (0, 1):
        assert rows[i].lufs == pytest.approx(-0.691 + 10 * math.log10(want[i, -1]), abs=1e-4) == rows[i].momentary and rows[i].range_lu == 0
    assert rows[3].momentary == pytest.approx(-0.691 + 10 * math.log10(max(want[3, b] for b in range(14))), abs=1e-4)


def test_loudness_where_blocks_are_no_multiple_of_steps(spark):
    rate = 4005  # blocks of 1602, steps of 401
    x = np.random.default_rng(2).normal(0, 0.2, 3300)
    got = {r.block: r.power for r in measure.loudness_blocks(frames_of(spark, {1: [x]}), rate).collect()}
    p = kernels.k_weighting(np.asarray(x, np.float32), rate).astype(np.float64) ** 2
    assert got == {b: pytest.approx(p[b * 401 : b * 401 + 1602].mean(), rel=1e-6) for b in range(5)}


def test_runs_over_many_batches_are_whole(spark):
    """Runs that span Arrow batches, end with them or are shorter reach the kernel whole and in order."""
    sizes = {0: 7, 1: 10, 2: 3, 3: 25, 4: 1, 5: 10}
    f = frames_of(spark, {i: [np.arange(n) + 100 * i] for i, n in sizes.items()})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = measure.per_channel(f.coalesce(1), lambda x: np.cumsum(x, axis=1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i, n in sizes.items():
        assert [r.sample for r in sorted((r for r in got if r.clip == i), key=lambda r: r.frame)] == np.cumsum(np.arange(n) + 100.0 * i).tolist()
    assert len(got) == sum(sizes.values())


def test_kernels_of_rows_equal_those_of_one_run():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 50, 700, 50, 33, 700, 2, 50, 50, 64, 300, 20, 20, 20, 20, 20, 20, 20])
    x = rng.normal(0, 0.5, sizes.sum()).astype(np.float32)
    runs = np.split(x, np.cumsum(sizes)[:-1])
    c = kernels.biquad_coefficients("peaking", 900.0, 8000, 0.9, 5.0)
    for kernel in (lambda r: kernels.biquad(r, c), lambda r: kernels.limiter_gains(np.abs(r), 0.5, 20.0), lambda r: kernels.compressor_gains(np.abs(r), 8000, -12.0, 4.0, 1.0, 20.0)):
        assert np.allclose(kernels.by_rows(kernel, x, sizes), np.concatenate([kernel(np.asarray(r, np.float64)) for r in runs]), atol=1e-9)
    out, made = kernels.resample_runs(x, sizes, 1.5)
    assert all(np.allclose(a, kernels.resample(r, 1.5), atol=1e-6) for a, r in zip(np.split(out, np.cumsum(made)[:-1]), runs))
    peaks = kernels.true_peaks(x, sizes)
    assert np.allclose(peaks, [kernels.true_peaks(r, np.array([len(r)]))[0] for r in runs])
    long = kernels.true_peaks(np.tile(x, 60), np.array([len(x) * 60]))[0]
    assert long >= np.abs(x).max()


def test_speech_segments(spark):
    texts = ["Don't stop, my 'dear' friend!", "well-known ... x", "Hello, world. ,, Again?", "e\u0301te\u0301", "\u30ab\u30fc\u30c9\u3001\u6f22\u5b57\u3002", ",.;", None, "a,,b, c,"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.words, r.syllables, r.pauses, r.phrases) for r in voice.segments(docs, "id").collect()}
    # don't: don, t; stop: sto, p; my; dear: dea, r; friend: fri, end
    assert got == {0: (5, 9, 1, 1), 1: (2, 5, 0, 2), 2: (3, 6, 1, 2), 3: (1, 1, 0, 1), 4: (2, 4, 1, 1), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0), 7: (3, 3, 3, 1)}
    placed = {(r.id, r.position): (r.word, r.on) for r in voice.placed_words(docs, "id", 1000).collect()}
    assert placed[0, 0] == ("Don't", 0) and placed[0, 1] == ("stop", 285) and placed[0, 2] == ("my", 285 + 460) and placed[2, 2] == ("Again", 240 + 220 + 240 + 36 + 380)


def test_stretches_change_nothing(spark):
    """Lookups, counts and folds dealt by stretches of time give what one task for each key gives; null keys and ties too."""
    rng = np.random.default_rng(3)
    rows = [(i, int(f), str(k) if k else None, int(k), float(f % 7)) for i, (f, k) in enumerate(zip(rng.integers(0, 2000, 1500), rng.integers(0, 4, 1500)))]
    t = spark.createDataFrame(rows, "seq long, frame long, name string, key long, gain double")
    changes = t.where("seq % 9 = 0").select("name", "frame", "gain")
    one = sorted(timeline.as_of(t.select("name", "frame", "seq"), changes, ["name"], "frame", ["gain"]).collect(), key=str)
    for span in (1, 64, 5000):
        assert sorted(timeline.as_of(t.select("name", "frame", "seq"), changes, ["name"], "frame", ["gain"], span).collect(), key=str) == one
    order, turns = sorted(rows, key=lambda r: (r[1], r[0])), {}
    want = {}
    for r in order:
        want[r[0]] = turns[r[2]] = (turns.get(r[2], -1) + 1) % 3
    for span in (1, 64, 5000):
        assert {r.seq: r.choice for r in mixing.sequence_choice(t, 3, span).collect()} == want
    last, ends, started, admitted, number, island = {}, {}, {}, {}, {}, {}
    for seq, f, name, _, _ in order:
        started[seq] = f - last.get(name, -100) >= 12
        if started[seq]:
            last[name] = f
        sounding = [e for e in ends.get(name, []) if e > f]
        admitted[seq] = len(sounding) < 3
        ends[name] = sounding + [f + 12] * admitted[seq]
        number[name] = number.get(name, (0, f))[0] + (f - number.get(name, (0, f))[1] >= 5), f
        island[seq] = number[name][0]
    assert {r.seq: r.started for r in mixing.min_gap(t, 12).collect()} == started
    assert {r.seq: r.admitted for r in mixing.admitted(t, 12, 3).collect()} == admitted
    for span in (1, 64, 5000):
        assert {r.seq: r.island for r in mixing.islands(t, 5, "name", span).collect()} == island


def test_tempo_maps_of_any_length(spark):
    ticks = spark.range(400).selectExpr("id as note", "id * 37 % 3000 as start")
    changes = spark.range(300).selectExpr("id * 9 as tick", "cast(60000 + id * 131 % 90000 as int) as milli_bpm")
    tempos = timeline.tempo_map(changes, 48_000, 48)
    long = {r.note: r.start_frame for r in timeline.ticks_to_frames(ticks, "start", tempos, 48_000, 48).collect()}
    short = {r.note: r.start_frame for r in timeline.ticks_to_frames(ticks.where("start < 900"), "start", tempos.where("tick < 900"), 48_000, 48).collect()}
    assert len(long) == 400 and len(short) > 50 and all(long[k] == v for k, v in short.items())


def test_faults_and_mismatches(spark):
    good = [(1, c, f, 0.5) for c in (0, 1) for f in range(4)]
    odd = [(2, 0, 0, float("nan")), (2, 0, 1, 0.0), (3, 0, 0, 0.0), (3, 0, 2, 0.0), (4, 1, 0, 0.0), (5, 0, 0, 0.0), (5, 0, 0, 0.0), (6, 0, -1, 0.0), (6, 0, 0, None), (7, 0, 0, 0.0), (7, 1, 0, 0.0), (7, 1, 1, 0.0)]
    f = spark.createDataFrame(good + odd, "clip long, channel int, frame long, sample float")
    assert sorted(map(tuple, shape.faults(f).collect())) == [(2, "not finite"), (3, "frames missing"), (4, "channels missing"), (5, "twice"), (6, "before the start"), (6, "not finite"), (7, "frames missing")]
    assert [tuple(r) for r in shape.mismatches(f, f.where("channel = 0")).orderBy("clip").collect()] == [(1, 2, 1), (7, 2, 1)]


def test_dither_is_of_a_place(spark):
    """The same noise for a frame whatever else is drawn, in range, triangular, other for other channels and seeds."""
    mask = (1 << 64) - 1

    def mix(x):
        for shift, by in units.COUNTER_MIX:
            x = (x ^ (x >> shift)) * by & mask
        return x ^ (x >> 31)

    def plain(channel, frames, seed):
        state, out = mix((seed ^ (channel + 1) * units.COUNTER_STEP) & mask), []
        for _ in range(2 * frames):
            state = (state + units.COUNTER_STEP) & mask
            out.append((mix(state) >> 11) / (1 << 53))
        return [a - b for a, b in zip(out[::2], out[1::2])]

    rows = spark.range(3000).selectExpr("id as frame", "cast(id % 2 as int) as channel")
    for seed in (7, -1):
        got = {r.frame: r.x for r in rows.select("frame", levels.dither(F.col("channel"), F.col("frame"), seed).alias("x")).collect()}
        want = [plain(c, 3000, seed) for c in (0, 1)]
        assert all(x == want[f % 2][f] for f, x in got.items()) and 0.35 < np.std(list(got.values())) < 0.46
    quiet = frames_of(spark, {1: [np.zeros(500)]})
    assert {r.code for r in levels.quantize(quiet, "s16", 3).collect()} <= {-1, 0, 1} and {r.code for r in levels.quantize(quiet, "s16").collect()} == {0}


def test_wav_as_users_have_it():
    x = np.random.default_rng(3).uniform(-1, 1, (40, 2)).astype(np.float32)
    plain = containers.encode(x, 8000, "wav", "s16")
    head, body = plain[12:36], plain[44:]
    chunk = lambda name, data, size=None: name + struct.pack("<I", len(data) if size is None else size) + data + bytes(len(data) % 2)
    riff = lambda chunks, kind=b"RIFF": kind + struct.pack("<I", 0xFFFFFFFF if kind != b"RIFF" else 4 + len(chunks)) + b"WAVE" + chunks
    want = containers.decode(plain)[0]
    info = chunk(b"LIST", b"INFO" + chunk(b"INAM", b"A name\0") + chunk(b"IART", "Éa".encode()))
    parted = riff(chunk(b"junk", b"odd") + head + chunk(b"data", body[:60]) + info + chunk(b"data", body[60:]))
    assert (containers.decode(parted)[0] == want).all() and containers.wav_tags(containers.wav_chunks(parted)) == {"INAM": "A name", "IART": "Éa"}
    wide = riff(chunk(b"ds64", struct.pack("<QQQI", 0, len(body), 40, 0)) + head + chunk(b"data", body, 0xFFFFFFFF) + info, b"RF64")
    assert (containers.decode(wide)[0] == want).all() and containers.wav_tags(containers.wav_chunks(wide))["INAM"] == "A name"
    for tag, kind in ((6, "alaw"), (7, "ulaw")):
        fmt = chunk(b"fmt ", struct.pack("<HHIIHH", tag, 1, 8000, 8000, 1, 8))
        y, rate, said = containers.decode(riff(fmt + chunk(b"fact", struct.pack("<I", 250)) + chunk(b"data", bytes(range(256)))))
        assert said == kind and len(y) == 250 and np.abs(y).max() < 1
    for bad in (plain[:-10], riff(head), riff(head + b"dat"), riff(head + chunk(b"data", body[:-1])), riff(head + chunk(b"data", body, 0xFFFFFFFF), b"RF64"), riff(chunk(b"fmt ", struct.pack("<HHIIHH", 2, 2, 8000, 1, 4, 16)) + chunk(b"data", body)), containers.encode(np.full((2, 1), np.nan, np.float32), 8000, "wav", "f32")):
        with pytest.raises((ValueError, KeyError, struct.error)):
            containers.decode(bad)


def test_companding_of_files_is_that_of_columns(spark):
    bytes_ = spark.range(256).select(F.col("id").cast("int").alias("b"))
    rows = bytes_.select("b", levels.ulaw_decode(F.col("b")).alias("u"), levels.alaw_decode(F.col("b")).alias("a")).orderBy("b").collect()
    assert [r.u for r in rows] == containers.companded("ulaw").tolist() and [r.a for r in rows] == containers.companded("alaw").tolist()


def test_speaker_pairs_and_looks(spark):
    """Straight at a speaker it sounds alone; between two at equal angles both equally; power is one all round."""
    rows = [(0, -0.5, 0.75**0.5), (1, 0.0, 1.0), (2, 0.0, 0.0), (3, 0.0, -1.0), *((10 + i, math.sin(i), math.cos(i)) for i in range(40))]
    d = spark.createDataFrame(rows, "i int, x double, z double")
    for layout, n in mixing.LAYOUT_CHANNELS.items():
        got = {r.i: r.g for r in d.select("i", mixing.speaker_gains(F.col("x"), F.col("z"), layout).alias("g")).collect()}
        assert all(len(g) == n and sum(x * x for x in g) == pytest.approx(1) and min(g) >= 0 and sum(x > 1e-9 for x in g) <= 2 for g in got.values())
        assert got[1] == pytest.approx(got[2]) and near([got[3][5 if n > 4 else 3]], [0.5**0.5])
        if n > 4:
            assert got[0][0] == pytest.approx(1) and got[1][2] == pytest.approx(1)
    right, ahead = spark.range(1).select(*mixing.seen_by(F.lit(1.0), F.lit(2.0), F.lit(3.0), (0.0, 0.0, -2.0), (0.0, 1.0, 0.0))).first()
    assert (right, ahead) == (1.0, -3.0)
    with pytest.raises(ValueError):
        mixing.seen_by(F.lit(1.0), F.lit(2.0), F.lit(3.0), (0.0, 1.0, 0.0), (0.0, 2.0, 0.0))


def test_markers_hold_frames(spark):
    rows = spark.createDataFrame([("a", f) for f in (0, 5, 9, 10, 14, 15, 30)] + [("b", 3)], "k string, frame long")
    markers = spark.createDataFrame([("a", 5, 10, "x"), ("a", 10, 15, "y")], "k string, start long, end long, v string")
    for span in (1, 7, 100):
        got = {(r.k, r.frame): r.v for r in timeline.marker_at(rows, markers, ["k"], ["v"], span).collect()}
        assert got == {("a", 0): None, ("a", 5): "x", ("a", 9): "x", ("a", 10): "y", ("a", 14): "y", ("a", 15): None, ("a", 30): None, ("b", 3): None}
