"""Answers in order of event time, however the stream is shuffled, and state that ends."""

import random

import pytest
from pyspark.sql import functions as F

from sampleloom.operators import mixing
from sampleloom.streaming import events

RATE = 1000
ROWS = "name string, seq bigint, frame bigint, ts timestamp"


def run(spark, tmp_path, made, parts, name):
    schema = spark.createDataFrame([], ROWS).schema
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "name string, seq bigint, frame bigint").withColumn("ts", F.timestamp_millis("frame")).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(240)
    assert query.exception() is None
    left = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return spark.table(name), left


def shuffled(n, seed, delay):
    """Rows whose order in the stream differs from that of their times by less than the delay, then two that move time on."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 60_000)) for i in range(n)]
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, delay - 1))
    parts = [late[i : i + 60] for i in range(0, n, 60)]
    return rows, [*parts, [("end", n, 10_000_000)], [("end", n + 1, 20_000_000)], [("end", n + 2, 30_000_000)]]


@pytest.mark.parametrize("kind", ["gap", "admission"])
def test_shuffled_micro_batches_as_in_a_batch(spark, tmp_path, kind):
    rows, parts = shuffled(300, 4, 5000)
    batch = spark.createDataFrame(rows, "name string, seq bigint, frame bigint")
    if kind == "gap":
        found, left = run(spark, tmp_path, lambda s: events.min_gap_in_order(s, 900, RATE, "6 seconds"), parts, "gaps_in_order")
        want = {r.seq: r.started for r in mixing.min_gap(batch, 900).collect()}
        got = {r.seq: r.started for r in found.collect() if r.name != "end"}
    else:
        found, left = run(spark, tmp_path, lambda s: events.admitted_in_order(s, 1500, 2, RATE, "6 seconds"), parts, "admitted_in_order")
        want = {r.seq: r.admitted for r in mixing.admitted(batch, 1500, 2).collect()}
        got = {r.seq: r.admitted for r in found.collect() if r.name != "end"}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert max(left) >= 3 and left[-1] <= 1  # only the name that moves time on still waits
