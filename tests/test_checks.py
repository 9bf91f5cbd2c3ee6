"""Predicates and checks of catalogues at their edges."""

import pytest
from pyspark.sql import functions as F

from sampleloom.functions import checks
from sampleloom.operators import dsp


def test_names_texts_and_bounds(spark):
    rows = [("a", 1 / 16, -48.0), ("x" * 64, 8.0, 48.0), ("x" * 65, 8.0001, 48.1), ("", float("nan"), float("inf")), ("a b", 0.0, 0.0), ("é", None, None), (None, 1.0, 1.0), ("a_-.9\n", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "name string, rate double, pitch double")
    got = [tuple(r) for r in df.select(checks.name_ok(F.col("name")), checks.rate_ok(F.col("rate")), checks.pitch_ok(F.col("pitch"))).collect()]
    assert got == [(True, True, True), (True, True, True), (False, False, False), (False, False, False), (False, False, True), (False, False, False), (False, True, True), (False, True, True)]
    texts = spark.createDataFrame([("plain",), ("a\0b",), (None,)], "t string").select(checks.text_ok(F.col("t"))).collect()
    assert [r[0] for r in texts] == [True, False, True]
    zero = spark.range(1).select(checks.inside(F.lit(0.0), 0.1, 0.9, True), checks.inside(F.lit(0.0), 0.1, 0.9)).first()
    assert tuple(zero) == (True, False)
    masks = spark.range(10).select(checks.channel_mask(F.col("id"))).collect()
    assert [r[0] for r in masks] == [None, 4, 3, None, 0x33, None, 0x3F, None, 0x63F, None]


def test_tags_and_fields(spark):
    tags = [(1, "INAM", "a"), (1, "title", "b"), (1, "Disc", "1"), (2, "Disc", "1"), (2, "mood", "x"), (3, "isrc", "a\0"), (4, "genre", None)]
    df = spark.createDataFrame(tags, "clip bigint, name string, value string")
    box = F.get(F.lit(["", "wav", "mp3", "au", "wav"]), F.col("clip").cast("int"))
    got = sorted(tuple(r) for r in checks.tag_faults(df, box).collect())
    assert got == [(1, "disc", "no place for this tag"), (1, "title", "several values"), (3, "isrc", "a zero character"), (3, "isrc", "no tags in this container")]
    effects = spark.createDataFrame([(1, 0.5, 1.0, 0.0, 1.0), (2, None, 0.0, 0.0, 0.0), (3, 2.0, 4.0, 4.0, 0.0), (4, 0.0, float("nan"), 0.0, 0.0)], "effect int, duty double, attack double, sustain double, decay double")
    got = sorted(tuple(r) for r in checks.field_faults(effects, "effect", {"duty": (0.1, 0.9, True)}, 5.0).collect())
    assert got == [(2, "duration"), (2, "duty"), (3, "duration"), (3, "duty"), (4, "duration")]
    assert [tuple(r) for r in checks.repeated(df, "clip").orderBy("clip").collect()] == [(1, 3), (2, 2)]
    assert tuple(checks.piece_length(spark.createDataFrame([], "start bigint, length bigint"), 120, 48).first()) == (0, 0.0)


def test_ducking_is_a_strong_compressor(spark):
    rows = [(1, 0, f, 0.5) for f in range(400)]
    music = spark.createDataFrame(rows, "clip bigint, channel int, frame bigint, sample float")
    speech = music.withColumn("sample", F.when(F.col("frame") >= 200, 0.8).otherwise(0.0).cast("float"))
    out = [r["sample"] for r in dsp.duck(music, speech, 1000).orderBy("frame").collect()]
    assert out[:200] == [0.5] * 200 and out[-1] == pytest.approx(0.5 * (10 ** (-30 / 20) / 0.8) ** 0.95, rel=1e-3)
