"""Recurrences and sliding maxima over clips of any length, as associative scans over bounded blocks of frames.

A recurrence whose step is a map of a small family that is closed under composition needs no order but that of blocks:
each block's steps are composed on their own, one small table with a row for each block is walked, and what a block was
entered with is put into its frames. Filters step by affine maps of two numbers, limiter gains by ``g -> min(a, b + c g)``.
Frames are shuffled by (clip, block), so a long clip is the work of many tasks; only the walk has a clip in one task, a row
for each block of thousands of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.units import f64
from . import kernels
from .runs import by_run

BLOCK = 4096
#: Powers of a limiter's release within a block stay within exp(12), so that sums of them keep eleven digits.
SPREAD = 12.0


def entered(ends: DataFrame, keys: list[str], values: list[str], step: Callable[[np.ndarray, np.ndarray], np.ndarray], start: list[float], names: list[str]) -> DataFrame:
    """(keys, block, names): with which state each block but the first is entered. ``ends`` has a row of ``values`` for each
    block, and ``step`` takes rows of states over one block each. A run's blocks are walked in order, many runs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.array(start)
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            v = np.stack([b.column(c).to_numpy() for c in values], 1)
            first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
            size = np.diff(np.append(first, len(v)))
            states = np.tile(np.array(start), (len(first), 1))
            if last == [c[0] for c in columns]:
                states[0] = state  # the run goes on
            out = np.empty((len(v), len(start)))
            for k in range(int(size.max())):
                on = np.flatnonzero(size > k)
                states[on] = out[first[on] + k] = step(states[on], v[first[on] + k])
            last, state = [c[-1] for c in columns], states[-1]
            yield pa.record_batch([*(b.column(k) for k in keys), pa.array(b.column("block").to_numpy() + 1), *map(pa.array, out.T)], target.names).cast(target)

    fields = StructType([*(ends.schema[k] for k in keys), *StructType.fromDDL("block bigint").fields, *(StructField(n, ends.schema[values[0]].dataType) for n in names)])
    target = to_arrow_schema(fields)
    return ends.select(*keys, "block", *values).repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(run, fields)


def _table(frames: DataFrame, **columns: np.ndarray) -> DataFrame:
    """Numbers for each place in a block, broadcast: as many rows as a block has frames."""
    size = len(next(iter(columns.values())))
    return F.broadcast(frames.sparkSession.createDataFrame(pa.table({"_at": np.arange(size), **columns})))


def filtered(frames: DataFrame, *chain: tuple[float, ...], block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(clip, channel, frame, sample) with the samples in 64-bit floats behind one filter, or several in a row that hand on
    32-bit floats.

    The state of a filter is what its last inputs and outputs add to the next two outputs, two numbers for each of the chain.
    Entered with none, a block ends with the sum of its samples times fixed numbers for each place, which is an aggregate; a
    state fades by a fixed matrix. States are those of the chain in 64-bit floats throughout. Frames are dealt to so many ``tasks`` where their
    number is known, as with ``by_run``.
    """

    def step(state: np.ndarray, x: float) -> tuple[list[float], float]:
        new = []
        for (b0, b1, b2, a1, a2), (z1, z2) in zip(chain, state.reshape(-1, 2)):
            y = b0 * x + z1
            new += [b1 * x - a1 * y + z2, b2 * x - a2 * y]
            x = y
        return new, x

    n = 2 * len(chain)
    fade, out = np.array([step(e, 0.0)[0] for e in np.eye(n)]).T, np.array([step(e, 0.0)[1] for e in np.eye(n)])
    seen, drive = np.eye(n), np.array(step(np.zeros(n), 1.0)[0])
    weights, powers = np.empty((block, n)), np.empty((block, n))
    for i in range(block):  # seen is fade to the power of i
        weights[block - 1 - i], powers[i] = seen @ drive, out @ seen
        seen = fade @ seen
    columns = lambda name, table: {f"{name}{k}": table[:, k] for k in range(n)}
    blocks = frames.select("clip", "channel", F.floor(F.col("frame") / block).cast("bigint").alias("block"), F.pmod("frame", F.lit(block)).alias("_at"), "frame", "sample")
    keys, numbers = ["clip", "channel"], range(n)
    weighted = blocks.join(_table(frames, **columns("_w", weights)), "_at")
    ends = weighted.groupBy(*keys, "block").agg(*(F.sum(f64(F.col("sample")) * F.col(f"_w{k}")).alias(f"e{k}") for k in numbers))
    states = entered(ends, keys, [f"e{k}" for k in numbers], lambda s, e: s @ seen.T + e, [0.0] * n, [f"s{k}" for k in numbers])

    def alone(rows: np.ndarray) -> np.ndarray:
        for k, coefficients in enumerate(chain):
            rows = kernels.biquad(rows.astype(np.float32) if k else rows, coefficients)
        return rows

    schema = f"clip {blocks.schema['clip'].dataType.simpleString()}, channel int, block bigint, frame bigint, sample double"
    local = by_run(blocks, [*keys, "block"], "sample", lambda x, n, _: (kernels.by_rows(alone, x, n), n), schema, tasks)
    if tasks:
        local, states = (t.repartition(tasks, *keys, "block") for t in (local, states))
    met = local.withColumnRenamed("frame", "_at").join(states, [*keys, "block"], "left").join(_table(frames, **columns("_r", powers)), "_at")
    rung = sum((F.col(f"_r{k}") * F.col(f"s{k}") for k in numbers[1:]), F.col("_r0") * F.col("s0"))
    return met.select(*keys, (F.col("block") * block + F.col("_at")).alias("frame"), (F.col("sample") + F.coalesce(rung, F.lit(0.0))).alias("sample"))


def limiter_gains(peaks: DataFrame, ceiling: float, release: float, block: int | None = None) -> DataFrame:
    """(clip, frame, gain) from (clip, frame, peak): down at once, up by an exponential that takes ``release`` frames.

    A step is g -> min(t, (1 - r) t + r g) for a target t and the release's factor r, and k steps are g -> min(a, b + r^k g).
    With targets divided by powers of r, b is a running sum and a follows from a running minimum.
    """
    target = F.least(F.lit(1.0), F.lit(float(ceiling)) / F.greatest(F.col("peak"), F.lit(1e-300)))
    if release <= 0:
        return peaks.select("clip", "frame", target.alias("gain"))
    rate = 1 / release
    block = block or max(1, min(1 << 15, int(SPREAD / rate)))
    at = (F.pmod("frame", F.lit(block)) + 1).cast("double")
    up, down = F.exp(at * rate), F.exp(-at * rate)
    order = Window.partitionBy("clip", "block").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = peaks.select("clip", F.floor(F.col("frame") / block).cast("bigint").alias("block"), "frame", target.alias("_t"), up.alias("_up"), down.alias("_down"))
    steps = steps.withColumn("_sum", F.sum((1 - math.exp(-rate)) * F.col("_t") * F.col("_up")).over(order))
    steps = steps.withColumn("_least", F.min(F.col("_t") * F.col("_up") - F.col("_sum")).over(order))
    steps = steps.select("clip", "block", "frame", (F.col("_down") * (F.col("_sum") + F.col("_least"))).alias("a"), (F.col("_down") * F.col("_sum")).alias("b"), F.col("_down").alias("c"))
    ends = steps.where(F.pmod("frame", F.lit(block)) == block - 1)
    states = entered(ends, ["clip"], ["a", "b", "c"], lambda g, v: np.minimum(v[:, :1], v[:, 1:2] + v[:, 2:] * g), [1.0], ["g"])
    met = steps.join(states, ["clip", "block"], "left")
    return met.select("clip", "frame", F.least("a", F.col("b") + F.col("c") * F.coalesce("g", F.lit(1.0))).alias("gain"))


def ahead_max(rows: DataFrame, value: str, look: int) -> DataFrame:
    """(clip, frame, value): the largest value from each frame on to ``look`` frames later.

    In blocks of look + 1 frames that stretch is the rest of a frame's own block and a beginning of the next one, so a block
    gets its own frames and the next one's, and two running maxima are enough, however far it looks.
    """
    if look <= 0:
        return rows.select("clip", "frame", value)
    size = look + 1
    block, at = F.floor(F.col("frame") / size).cast("bigint"), F.pmod("frame", F.lit(size))
    both = F.array(F.struct(block.alias("block"), at.alias("at"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), (at + 1).alias("at"), F.lit(False).alias("own")))
    dealt = rows.select("clip", "frame", F.col(value).alias("x"), F.explode(both).alias("p")).select("clip", "frame", "x", "p.*").where("block >= 0")
    group = Window.partitionBy("clip", "block")
    rest = F.max(F.when(F.col("own"), F.col("x"))).over(group.orderBy(F.desc("at"), "own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun = F.max(F.when(~F.col("own"), F.col("x"))).over(group.orderBy("at", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_rest", rest).withColumn("_begun", begun).where("own").select("clip", "frame", F.greatest("_rest", "_begun").alias(value))
