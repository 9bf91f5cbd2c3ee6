"""Scans over blocks against recurrences one frame after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.operators import dsp, kernels, measure, mixing, scans

FRAMES = "clip bigint, channel int, frame bigint, sample float"


def clips(sizes, seed=1):
    rng = np.random.default_rng(seed)
    return {(i, c): (rng.random(n) * 2 - 1).astype(np.float32) for i, n in enumerate(sizes) for c in range(1 + i % 2)}


def as_rows(signals):
    return [(clip, c, f, float(v)) for (clip, c), x in signals.items() for f, v in enumerate(x)]


def collected(df, key, value="sample"):
    out = {}
    for r in df.orderBy(*key, "frame").collect():
        assert r.frame == len(out.setdefault(tuple(r[k] for k in key), []))
        out[tuple(r[k] for k in key)].append(r[value])
    return out


def plain_biquad(x, c):
    b0, b1, b2, a1, a2 = c
    out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for v in map(float, x):
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x1, x2, y1, y2 = v, x1, y, y1
        out.append(y)
    return out


@pytest.mark.parametrize("kind", ["lowpass", "highpass", "peaking", "one pole"])
def test_filters_over_blocks(spark, kind):
    signals = clips([1, 7, 8, 9, 100, 333])
    c = kernels.one_pole_coefficients(90, 8000) if kind == "one pole" else kernels.biquad_coefficients(kind, 60, 8000, 1.3, 6.0)
    got = collected(scans.filtered(spark.createDataFrame(as_rows(signals), FRAMES), c, block=8), ["clip", "channel"])
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        assert np.allclose(got[k], plain_biquad(x, c), atol=1e-11)


def test_filters_in_a_row_over_blocks(spark):
    signals = clips([1, 8, 9, 100, 333], 7)
    chain = (kernels.biquad_coefficients("highshelf", 900, 8000, 0.8, 4.0), kernels.biquad_coefficients("highpass", 60, 8000), kernels.one_pole_coefficients(700, 8000))
    got = collected(scans.filtered(spark.createDataFrame(as_rows(signals), FRAMES), *chain, block=16), ["clip", "channel"])
    for k, x in signals.items():
        want = x
        for c in chain:
            want = np.array(plain_biquad(np.float32(want), c))
        assert np.allclose(got[k], want, atol=2e-6)


def test_a_long_clip_is_filtered_by_many_tasks(spark):
    n, c = 10_000_000, kernels.biquad_coefficients("lowpass", 40, 48_000)
    frames = spark.range(0, n, 1, 16).select(F.lit(5).cast("bigint").alias("clip"), F.lit(0).alias("channel"), F.col("id").alias("frame"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1.0).cast("float").alias("sample"))
    out = scans.filtered(frames, c)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    dealt = out.where("frame % 4096 = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len([r for r in dealt if r["count"] > 50]) >= 8
    places = [0, 1, 4095, 4096, 4097, 1_234_567, 5_000_000, n - 1]
    got = {r.frame: r.sample for r in out.where(F.col("frame").isin(places)).collect()}
    x = frames.select("frame", "sample").toPandas().sort_values("frame")["sample"].to_numpy()
    want = kernels.biquad(x, c)
    assert all(abs(got[f] - want[f]) < 1e-9 for f in places)


def plain_gains(peak, ceiling, release):
    g, out = 1.0, []
    for p in peak:
        t = min(1.0, ceiling / max(p, 1e-300))
        g = t if t < g or release <= 0 else t + (g - t) * math.exp(-1 / release)
        out.append(g)
    return out


@pytest.mark.parametrize("release, block", [(0.0, None), (0.2, None), (1.0, None), (20.0, None), (20.0, 8), (500.0, 16), (5000.0, None)])
def test_limiter_gains_over_blocks(spark, release, block):
    rng = np.random.default_rng(3)
    peaks = {(i,): np.abs(rng.normal(size=n)) * rng.choice([0.0, 0.2, 3.0], n) for i, n in enumerate([1, 8, 17, 400])}
    rows = [(k[0], f, float(v)) for k, x in peaks.items() for f, v in enumerate(x)]
    got = collected(scans.limiter_gains(spark.createDataFrame(rows, "clip bigint, frame bigint, peak double"), 0.5, release, block), ["clip"], "gain")
    for k, x in peaks.items():
        assert np.allclose(got[k], plain_gains(x, 0.5, release), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("look", [0, 1, 2, 7, 50, 1000])
def test_sliding_maxima(spark, look):
    rng = np.random.default_rng(4)
    values = {(i,): rng.normal(size=n) for i, n in enumerate([1, 2, 8, 9, 200])}
    rows = [(k[0], f, float(v)) for k, x in values.items() for f, v in enumerate(x)]
    got = collected(scans.ahead_max(spark.createDataFrame(rows, "clip bigint, frame bigint, peak double"), "peak", look), ["clip"], "peak")
    for k, x in values.items():
        assert got[k] == [x[f : f + look + 1].max() for f in range(len(x))]


def test_limiters_keep_the_ceiling_on_a_clip_of_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=30_000) * np.repeat(rng.choice([0.1, 1.5], 30), 1000)).astype(np.float32)
    frames = spark.createDataFrame(as_rows({(1, 0): x}), FRAMES)
    out = np.array(collected(dsp.limit(frames, 8000, -6.0, 5.0, 50.0), ["clip", "channel"])[1, 0])
    peak = np.array([np.abs(x[f : f + 41]).max() for f in range(len(x))], np.float64)
    want = x * np.array(plain_gains(peak, 10 ** (-6 / 20), 400)).astype(np.float32)
    assert np.allclose(out, want, atol=1e-6) and np.abs(out).max() <= 10 ** (-6 / 20) + 1e-6
    assert measure.look_ahead_peak(frames, 40).count() == len(x)


def test_empty_tables(spark):
    frames = spark.createDataFrame([], FRAMES)
    assert scans.filtered(frames, kernels.one_pole_coefficients(90, 8000)).collect() == []
    peaks = spark.createDataFrame([], "clip bigint, frame bigint, peak double")
    assert scans.limiter_gains(peaks, 0.5, 20.0).collect() == [] and scans.ahead_max(peaks, "peak", 5).collect() == []


def test_routes_are_one_scan_however_long_the_chain(spark, tmp_path):
    rows = [(b, 0, f, float(b + 1)) for b in range(14) for f in range(3)]
    spark.createDataFrame(rows, "bus bigint, channel int, frame bigint, sample float").write.parquet(f"{tmp_path}/buses")
    buses = spark.read.parquet(f"{tmp_path}/buses")
    edges = [(b, b + 1, 0.5) for b in range(11)] + [(0, 5, 0.25), (3, 5, 2.0)]
    out = mixing.route(buses, edges)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    level = [float(b + 1) for b in range(14)]
    for b in range(12):
        level[b] += sum(level[s] * g for s, d, g in edges if d == b)
    got = {(r.bus, r.frame): r["sample"] for r in out.collect()}
    assert len(got) == len(rows) and all(got[b, f] == pytest.approx(level[b]) for b in range(14) for f in range(3))
    with pytest.raises(ValueError):
        mixing.path_gains([(1, 2, 1.0), (2, 1, 1.0)])
    with pytest.raises(ValueError):
        mixing.path_gains([(i, i + 1, 1.0) for i in range(2000)])
