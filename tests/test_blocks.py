"""Operators on blocks with shared edges against their kernels on whole clips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.operators import dsp, kernels, measure

FRAMES = "clip bigint, channel int, frame bigint, sample float"


def clips(sizes, seed=1):
    rng = np.random.default_rng(seed)
    return {(i, c): (rng.random(n) * 2 - 1).astype(np.float32) for i, n in enumerate(sizes) for c in range(1 + i % 2)}


def frame_table(spark, signals):
    return spark.createDataFrame([(clip, c, f, float(v)) for (clip, c), x in signals.items() for f, v in enumerate(x)], FRAMES)


def collected(df, value="sample"):
    out = {}
    for r in df.orderBy("clip", "channel", "frame").collect():
        assert r.frame == len(out.setdefault((r.clip, r.channel), []))
        out[r.clip, r.channel].append(r[value])
    return out


SIZES = [1, 2, 99, 100, 101, 164, 165, 200, 399, 400, 401, 1000]


@pytest.mark.parametrize("ratio", [1.5, 2 / 3, 160 / 147, 3.0, 0.25])
def test_resampling_over_blocks(spark, ratio):
    signals = clips(SIZES)
    got = collected(dsp.speed(frame_table(spark, signals), 1 / ratio, block=100))
    for k, x in signals.items():
        want = kernels.resample(x, 1 / (1 / ratio))
        assert len(got.get(k, [])) == len(want) and np.allclose(got.get(k, []), want, atol=1e-6)
    got = collected(dsp.resample(frame_table(spark, signals), 44_100, 48_000, block=130))
    assert all(np.allclose(got[k], kernels.resample(x, 48_000 / 44_100), atol=1e-6) for k, x in signals.items())


def test_peaks_over_blocks(spark):
    signals = clips(SIZES, 2)
    frames = frame_table(spark, signals)
    sizes = lambda x: np.array([len(x)])
    got = collected(measure.fine_peaks(frames, block=100), "peak")
    for k, x in signals.items():
        assert np.allclose(got[k], kernels.fine_peaks(x, sizes(x)))
    tops = {r.clip: r.true_peak for r in measure.true_peak(frames, block=100).collect()}
    assert all(tops[i] == pytest.approx(max(kernels.true_peaks(x, sizes(x))[0] for (j, _), x in signals.items() if j == i)) for i in tops) and len(tops) == len(SIZES)


@pytest.mark.parametrize("size, hop", [(16, 8), (16, 16), (16, 5), (8, 20), (64, 1)])
def test_spectra_over_blocks(spark, size, hop, monkeypatch):
    monkeypatch.setattr(dsp, "BLOCK", 100)
    signals = clips([1, 7, 8, 100, 129, 300], 3)
    got = {(r.clip, r.channel, r.col, r.bin): (r.t, r.hz, r.magnitude) for r in dsp.spectrogram(frame_table(spark, signals), 1000, size, hop).collect()}
    n = 0
    for (clip, channel), x in signals.items():
        padded = np.concatenate([x, np.zeros(size)]).astype(np.float64)
        for col in range(-(-len(x) // hop)):
            want = kernels.spectra(padded[None, col * hop : col * hop + size])[0]
            for k in range(size // 2 + 1):
                t, hz, m = got[clip, channel, col, k]
                assert (t, hz) == (pytest.approx(col * hop / 1000), pytest.approx(k * 1000 / size)) and m == pytest.approx(want[k], abs=1e-9)
                n += 1
    assert n == len(got)


def test_a_long_clip_is_shared_out(spark):
    n = 400_000
    frames = spark.range(0, n, 1, 8).select(F.lit(5).cast("bigint").alias("clip"), F.lit(0).alias("channel"), F.col("id").alias("frame"), F.sin(F.col("id") / 7).cast("float").alias("sample"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    out = dsp.resample(frames, 48_000, 44_100)
    tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len(tasks) >= 8 and sum(r["count"] for r in tasks) == round(n * 147 / 160)
