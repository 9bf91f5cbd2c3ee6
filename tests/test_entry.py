"""The driver contract: every query has rows and, where it has SQL, the same columns; SQL and Spark agree on a few."""

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["measure_levels", "silent_ranges", "crossfade", "filter_peaking", "tempo_map", "control_lanes", "min_gap", "instance_limit", "place_3d", "speaker_pan_51", "solo_routing", "effect_render", "round_trip_aiff_s24", "resample_3_2", "compressor", "normalize_lufs", "quantize_s16_dither", "clip_faults", "speech_segments", "spoken_at"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_agrees(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)
