"""Kernels on many whole runs of rows at once, dealt by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import kernels


def by_run(rows: DataFrame, keys: list[str], value: str, kernel, schema: str, tasks: int | None = None) -> DataFrame:
    """Deals the rows by ``keys`` and calls ``kernel(values, sizes, last key of each run)`` with many whole runs at once, each
    in order of frames.

    The kernel gives (values, sizes) of as many runs; they are numbered from frame 0 on again. With a schema without a
    frame a run gives one value. A run that goes on in the next batch waits for its end. Who knows how many rows there are
    may say how many ``tasks`` they are dealt to, so that more rows make no larger tasks.
    """
    framed = " frame " in f" {schema} ".replace(",", " ")

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        columns = [t.column(k).to_numpy() for k in keys]
        starts = run_starts(columns)
        out, sizes = kernel(t.column(value).to_numpy(), np.diff(np.append(starts, t.num_rows)), columns[-1][starts])
        made = [np.repeat(c[starts], sizes) for c in columns] + ([kernels.ragged(sizes)] if framed else [])
        return pa.record_batch([*map(pa.array, made), pa.array(out)], names).cast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_runs(batches, keys):
            yield work(held)

    fields = StructType.fromDDL(schema)
    names, target = fields.names, to_arrow_schema(fields)
    order = [*keys, "frame"]
    return rows.select(*order, value).repartition(*dealt(keys, tasks)).sortWithinPartitions(*order).mapInArrow(run, fields)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows in pieces that end where a run of equal keys does."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
        same = np.logical_and.reduce([b.column(k).to_numpy() == v for k, v in zip(keys, last)])
        first = int(same.argmax())  # where the last run begins
        if first or held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] != last:
            if held or first:
                yield [*held, b.slice(0, first)] if first else held
            held = [b.slice(first)]
        else:
            held.append(b)
    if held:
        yield held


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def dealt(keys: list[str], tasks: int | None) -> list:
    """What ``repartition`` takes: the keys, and the number of tasks if it is known."""
    return [tasks, *keys] if tasks else keys


def per_channel(frames: DataFrame, kernel) -> DataFrame:
    """Runs a kernel on each channel of each clip; it takes and gives rows of samples of one width."""
    return by_run(frames, ["clip", "channel"], "sample", lambda x, n, _: (kernels.by_rows(kernel, x, n).astype(np.float32), n), "clip bigint, channel int, frame bigint, sample float")


def by_block(frames: DataFrame, size: int, before: int, after: int, kernel, schema: str) -> DataFrame:
    """Deals each channel of each clip in blocks of ``size`` frames, with ``before`` frames of the block before and ``after``
    of the one behind, so a long clip is the work of many tasks. ``kernel`` takes (samples, sizes, numbers of the blocks) of
    many runs at once; a run that has only frames of its neighbours is behind the clip's end. The schema has clip, channel
    and block first; the rest is as with ``by_run``."""
    at = F.col("frame")
    spread = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((at - after) / size).cast("bigint")), F.floor((at + before) / size).cast("bigint"))
    dealt = frames.select("clip", "channel", F.explode(spread).alias("block"), "frame", "sample")
    return by_run(dealt, ["clip", "channel", "block"], "sample", kernel, schema)
