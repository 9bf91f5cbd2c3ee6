"""Streams give what batches give, however the input is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.operators import kernels, mixing
from sampleloom.sources import bindings, containers
from sampleloom.streaming import events, pcm

DATA = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.table(name)


def stream_of(df, path, parts, order):
    """Files that come one per trigger, in order."""
    for i, rows in enumerate(parts):
        df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.mark.parametrize("cut", [3, 64])
def test_pcm_chunks(spark, tmp_path, cut):
    x = np.random.default_rng(2).uniform(-1, 1, (40, 2)).astype(np.float32)
    data = containers.to_pcm(x, "s24")
    chunks = [("a", i, bytearray(data[i * cut : (i + 1) * cut])) for i in range(-(-len(data) // cut))]
    df = spark.createDataFrame(chunks, "stream string, seq long, data binary")
    third = len(chunks) // 3 + 1
    stream = stream_of(df, str(tmp_path), [chunks[i : i + third] for i in range(0, len(chunks), third)], "seq")
    rows = drained(pcm.decode(stream, "s24", 2), f"pcm{cut}").orderBy("frame", "channel").collect()
    assert np.allclose([r["sample"] for r in rows], containers.from_pcm(data, "s24", 2).ravel()) and [r["frame"] for r in rows[::2]] == list(range(40))
    assert pcm.leftovers(df, "s24", 2).count() == 0
    frames = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "stream string, frame long, samples array<float>")
    packed = pcm.encode(frames, "s24").orderBy("frame").collect()
    assert b"".join(bytes(r.data) for r in packed) == data


@pytest.mark.parametrize("rate,to", [(1000, 1500), (1500, 1000), (44100, 48000)])
def test_resampling_as_in_a_batch(spark, tmp_path, rate, to):
    x = np.random.default_rng(rate).normal(0, 0.3, (2, 700)).astype(np.float32)
    cuts = [0, 1, 3, 90, 91, 400, 700]
    chunks = [[("s", c, i, x[c, a:e].tolist(), e == 700) for c in (0, 1)] for i, (a, e) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame([], "stream string, channel int, seq long, samples array<float>, last boolean")
    rows = drained(pcm.resample(stream_of(df, str(tmp_path), chunks, "seq"), rate, to), f"rate{to}{rate}").collect()
    for c in (0, 1):
        got = [r["sample"] for r in sorted((r for r in rows if r.channel == c), key=lambda r: r.frame)]
        want = kernels.resample(x[c], to / rate)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-6)


def test_min_gap_as_in_a_batch(spark, tmp_path):
    t = bindings.triggers(spark, DATA).orderBy("frame", "seq")
    rows = [tuple(r) for r in t.collect()]
    stream = stream_of(t, str(tmp_path), [rows[:300], rows[300:700], rows[700:]], "frame")
    got = {r.seq: r.started for r in drained(events.min_gap(stream, 40_000_000), "gaps").collect()}
    want = {r.seq: r.started for r in mixing.min_gap(t, 40_000_000).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_windows_as_in_a_batch(spark, tmp_path):
    t = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("gain"))
    stream_path = str(tmp_path / "in")
    t.repartition(2).write.parquet(stream_path)
    stream = spark.readStream.schema(t.schema).parquet(stream_path)
    got = {(r.name, r.start): (r.starts, r.loudest) for r in drained(events.levels(stream, "2 hours", "1 hour", "1 hour"), "levels", "complete").collect()}
    want = {(r.name, r["start"]): (r.starts, r.loudest) for r in events.levels(t, "2 hours", "1 hour", "1 hour").collect()}
    assert got == want
