"""Queries on lines deal them to tasks by their number, not by the session's settings."""

import math
import re

import pytest

import __spark_entry__
from sampleloom.sources import bindings

DATA = "/root/testdata/sf0.001"


def dealt(spark, name, monkeypatch):
    """Plan and number of tasks of a query whose tasks have 100 lines each, and how many there have to be."""
    monkeypatch.setattr(bindings, "LINES_A_TASK", 100, raising=False)
    out = __spark_entry__.queries()[name](spark, DATA)
    least = math.ceil(bindings.table(spark, DATA, "lineitem").count() / 100)
    return out, out._jdf.queryExecution().executedPlan().toString(), least


@pytest.mark.parametrize("name", ["deinterleave", "interleave", "to_channels_5", "bus_routing", "bus_sum", "remove_dc"])
def test_lines_are_dealt_by_their_number(spark, name, monkeypatch):
    _, plan, least = dealt(spark, name, monkeypatch)
    assert {int(n) for n in re.findall(r"hashpartitioning\(l_suppkey#\d+L, (\d+)\)", plan)} == {least}


def test_downmix_has_a_group_for_each_frame(spark, monkeypatch):
    """No exchange behind the one of the lines, and groups without the channels of the result."""
    out, plan, least = dealt(spark, "downmix_51", monkeypatch)
    assert out.rdd.getNumPartitions() == least
    assert not re.search(r"Aggregate\(keys=\[clip#\d+L, (_c|channel)#\d+", plan)


@pytest.mark.parametrize("name", ["effect_lowpass", "effect_highpass"])
def test_filtered_frames_are_dealt_by_their_number(spark, name, monkeypatch):
    out, plan, least = dealt(spark, name, monkeypatch)
    assert out.rdd.getNumPartitions() == least
    assert {int(n) for n in re.findall(r"hashpartitioning\(clip#\d+L, channel#\d+, block#\d+L, (\d+)\)", plan)} == {least}


@pytest.mark.parametrize("name", ["bitcrusher", "chorus", "delay", "flanger", "phaser", "reverb"])
def test_channels_for_effects_are_dealt_by_their_number(spark, name, monkeypatch):
    out, plan, least = dealt(spark, f"effect_{name}", monkeypatch)
    assert out.rdd.getNumPartitions() == least
