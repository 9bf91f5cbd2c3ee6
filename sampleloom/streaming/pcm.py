"""Incremental decoding, encoding and resampling of PCM: chunks of any length give the frames that the whole would give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels
from ..sources.containers import from_pcm, to_pcm

FRAMES = "stream string, channel int, frame bigint, sample float"


def decode(chunks: DataFrame, kind: str, channels: int, big: bool = False) -> DataFrame:
    """(stream, channel, frame, sample) of a stream of chunks (stream, seq, data); chunks of a stream come in order of seq
    over triggers. State is less than one frame of bytes, and how many frames were given."""
    width = int(kind[1:]) // 8 * channels

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, done = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        data = bytes(pending) + b"".join(bytes(x) for x in rows["data"])
        whole = len(data) // width * width
        x = from_pcm(data[:whole], kind, channels, big)
        state.update((data[whole:], done + len(x)))
        n = len(x)
        yield pd.DataFrame({"stream": key[0], "channel": np.tile(np.arange(channels, dtype=np.int32), n), "frame": np.repeat(np.arange(done, done + n), channels), "sample": x.ravel()})

    return chunks.select("stream", "seq", "data").groupBy("stream").applyInPandasWithState(run, FRAMES, "pending binary, done bigint", "append", GroupStateTimeout.NoTimeout)


RESAMPLER = "pending binary, start bigint, head float, inputs bigint, outputs bigint"


def resample(chunks: DataFrame, rate: int, to: int) -> DataFrame:
    """(stream, channel, frame, sample) at another rate, of chunks (stream, channel, seq, samples, last) that come in order of
    seq over triggers; ``last`` marks a stream's last chunk. A sample is given once all samples that it needs are there, the
    rest with the last chunk, so the whole gives what resampling it at once gives. State is as many samples as one output
    needs, and counts."""
    ratio = to / rate
    half = 32 / (0.97 * min(ratio, 1.0))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, start, head, inputs, outputs = state.get if state.exists else (b"", 0, 0.0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        new = np.concatenate([np.zeros(0, np.float32), *(np.asarray(x, np.float32) for x in rows["samples"] if x is not None)])
        held = np.concatenate([np.frombuffer(bytes(pending), np.float32), new])
        head = float(new[0]) if not inputs and len(new) else head
        inputs, over = inputs + len(new), bool(rows["last"].any())
        target = int(np.floor(inputs * ratio + 0.5))
        ready = target if over else min(target, max(outputs, int(np.ceil((inputs - half) * ratio))))
        out, first = [np.zeros(0, np.float32)], outputs
        for lo in range(first, ready if len(held) else first, 4096):
            j, w = kernels.sinc_weights(np.arange(lo, min(lo + 4096, ready)) / ratio, ratio)
            x = held[np.clip(j - start, 0, len(held) - 1)]
            out.append((w * np.where(j < 0, head, x)).sum(1).astype(np.float32))
        made = np.concatenate(out)
        outputs = first + len(made)
        keep = max(start, min(int(max(0, np.ceil(outputs / ratio - half))), inputs - 1))
        if over:
            state.remove()
        else:
            state.update((held[keep - start :].tobytes(), keep, head, inputs, outputs))
        yield pd.DataFrame({"stream": key[0], "channel": np.full(len(made), key[1], np.int32), "frame": np.arange(first, outputs), "sample": made})

    slim = chunks.select("stream", "channel", "seq", "samples", "last")
    return slim.groupBy("stream", "channel").applyInPandasWithState(run, FRAMES, RESAMPLER, "append", GroupStateTimeout.NoTimeout)


def leftovers(chunks: DataFrame, kind: str, channels: int) -> DataFrame:
    """(stream, bytes): streams that end inside a frame, from all their chunks."""
    width = int(kind[1:]) // 8 * channels
    return chunks.groupBy("stream").agg((F.sum(F.length("data")) % width).alias("bytes")).where("bytes > 0")


def encode(frames: DataFrame, kind: str, big: bool = False) -> DataFrame:
    """(stream, frame, data): each frame of (stream, frame, samples) as bytes; it needs no state, so order does not matter."""

    @F.pandas_udf("binary")
    def pack(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: to_pcm(np.asarray(x, np.float32)[None, :], kind, big))

    return frames.select("stream", "frame", pack("samples").alias("data"))
