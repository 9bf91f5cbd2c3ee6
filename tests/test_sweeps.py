"""Swept pitch and duty against adding up one frame after the other."""

import math

import pytest
from pyspark.sql import functions as F

from sampleloom.operators import synth

RATE = 48_000


@pytest.mark.parametrize("stretch", [1 << 14, 7])
def test_phases_of_swept_notes(spark, stretch):
    notes = [(1, 0.0, 0.0, 100), (2, -700.0, 3.5, 250), (3, 2400.0, -9.0, 40), (4, 0.0, 1.0, 1)]
    each = synth.exploded(spark.createDataFrame(notes, "note bigint, base double, slide double, n int"), F.col("n"))
    cents = synth.swept_cents(F.col("base"), F.col("frame"), F.col("slide"), (30.0, 16, 8), ([0, 4, 7], 6))
    duty = synth.swept_duty(F.col("frame"), 0.5, [0.125, 0.25, 0.75], 10)
    made = each.withColumn("cents", cents).withColumn("duty", duty).withColumn("step", synth.increment(440 * F.pow(F.lit(2.0), F.col("cents") / 1200), RATE))
    got = {(r.note, r.frame): r for r in synth.summed_phase(made, "note", F.col("step"), stretch).collect()}
    for note, base, slide, n in notes:
        total = 0
        for i in range(n):
            c = base + slide * i + (30 * math.sin(2 * math.pi * ((i - 8) % 16) / 16) if i >= 8 else 0) + [0, 4, 7][i // 6 % 3] * 100
            r = got.pop((note, i))
            assert r.cents == pytest.approx(c) and r.phase == total % (1 << 32) / (1 << 32)
            assert r.duty == (0.5 if i < 10 else [0.125, 0.25, 0.75][min(i // 10 - 1, 2)])
            total += r.step
    assert not got


def test_phases_broadcast_nothing(spark):
    """However many notes there are: a table with a row for each is no table for the driver."""
    notes = spark.range(3000).select(F.col("id").alias("note"), F.lit(5).alias("n"))
    made = synth.exploded(notes, F.col("n")).withColumn("step", F.col("frame") + 1)
    out = synth.summed_phase(made, "note", F.col("step"), 2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.frame, r.phase * synth.CYCLE) for r in out.collect()} == {(0, 0), (1, 1), (2, 3), (3, 6), (4, 10)} and out.count() == 15_000
