"""Streams of triggers: gaps and instance limits by key in order of event time, with state that ends, and windows.

Rows may come in any order within the watermark's delay. They wait in their key's state until the watermark has passed them,
are answered in order of time, as in a batch, and a timer drops what nothing depends on any more. Rows later than the delay
are dropped by none of this: they are answered at once, at the time that the watermark has reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STARTED = "name string, seq bigint, frame bigint, started boolean"
ADMITTED = "name string, seq bigint, frame bigint, admitted boolean"
#: What waits, and the frames until which what has started matters.
STATE = "frames array<bigint>, seqs array<bigint>, held array<bigint>, now bigint"


def min_gap(triggers: DataFrame, gap: int) -> DataFrame:
    """(name, seq, frame, started): a trigger starts if the last one of its name that did is ``gap`` frames ago. Late triggers
    are taken at the frame of the newest one before them, never dropped; state is one number for each name, which stays. See
    ``min_gap_in_order`` for streams with a watermark."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = state.get if state.exists else (None, None)
        for rows in parts:
            rows, started = rows.sort_values(["frame", "seq"]), []
            for f in rows["frame"].tolist():
                now = f if now is None else max(now, f)
                ok = last is None or now - last >= gap
                last = now if ok else last
                started.append(ok)
            yield pd.DataFrame({"name": key[0], "seq": rows["seq"], "frame": rows["frame"], "started": started})
        state.update((last, now))

    return triggers.select("name", "seq", "frame").groupBy("name").applyInPandasWithState(run, STARTED, "last bigint, now bigint", "append", GroupStateTimeout.NoTimeout)


def _in_order(triggers: DataFrame, rate: int, delay: str, rule: Callable[[list[int], int], tuple[bool, list[int]]], schema: str, keep: int) -> DataFrame:
    """Answers each trigger of a name in order of frames, ``rate`` of them a second. ``rule(held, frame)`` gives the answer and
    the ends of what is held then; ``keep`` is how many frames a name's last rows may still matter."""
    answer = schema.split()[-2]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, seqs, held, now = state.get if state.exists else ([], [], [], None)
        frames, seqs, held = [np.array(x, np.int64) for x in (frames, seqs)] + [list(held)]
        passed = state.getCurrentWatermarkMs() * rate // 1000
        for rows in [None] if state.hasTimedOut else parts:
            if rows is not None:
                frames, seqs = np.concatenate([frames, rows["frame"].to_numpy(np.int64)]), np.concatenate([seqs, rows["seq"].to_numpy(np.int64)])
            ready = frames <= passed
            order = np.lexsort((seqs[ready], frames[ready]))
            said = []
            for f in frames[ready][order].tolist():
                now = f if now is None else max(now, f)
                ok, held = rule(held, now)
                said.append(ok)
            if said:
                yield pd.DataFrame({"name": key[0], "seq": seqs[ready][order], "frame": frames[ready][order], answer: said})
            frames, seqs = frames[~ready], seqs[~ready]
        # The next moment at which there is something to do: the first that waits, or the end of what is held.
        until = int(frames.min()) if len(frames) else (now or 0) + keep
        if not len(frames) and until <= passed:
            state.remove()
            return
        state.update((frames.tolist(), seqs.tolist(), held, now))
        state.setTimeoutTimestamp(max(until * 1000 // rate + 1, state.getCurrentWatermarkMs() + 1))

    timed = triggers.withWatermark("ts", delay).select("name", "seq", "frame", "ts")
    return timed.groupBy("name").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def min_gap_in_order(triggers: DataFrame, gap: int, rate: int, delay: str) -> DataFrame:
    """(name, seq, frame, started) of triggers with an event time ``ts`` that their frames count: starts at least ``gap`` frames
    apart, as in a batch."""

    def rule(held: list[int], frame: int) -> tuple[bool, list[int]]:
        ok = not held or frame >= held[0]
        return ok, [frame + gap] if ok else held

    return _in_order(triggers, rate, delay, rule, STARTED, gap)


def admitted_in_order(triggers: DataFrame, length: int, most: int, rate: int, delay: str) -> DataFrame:
    """(name, seq, frame, admitted): a start is refused while ``most`` instances of its name, each ``length`` frames long, still
    sound, as in a batch."""

    def rule(held: list[int], frame: int) -> tuple[bool, list[int]]:
        held = [e for e in held if e > frame]
        ok = len(held) < most
        return ok, [*held, frame + length] if ok else held

    return _in_order(triggers, rate, delay, rule, ADMITTED, length)


def levels(triggers: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    """(name, start, starts, loudest) of sliding windows of event time ``ts``; windows close ``delay`` after the newest event."""
    timed = triggers.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "name")
    return timed.agg(F.count(F.lit(1)).alias("starts"), F.max("gain").alias("loudest")).select("name", F.col("window.start").alias("start"), "starts", "loudest")
