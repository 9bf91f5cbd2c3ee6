"""Numeric kernels for true recurrences and interpolation, on one channel's samples; nothing here knows Spark.

Recursive filters work in blocks: within a block the response is a matrix product, and only the state passes on.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK = 256
TURN = 2 * math.pi


def biquad_coefficients(kind: str, hz: float, rate: float, q: float = math.sqrt(0.5), gain_db: float = 0.0) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2 over a0 of the cookbook filters."""
    if not 0 < hz < rate / 2 or q <= 0:
        raise ValueError("a filter needs a frequency below half the rate and a positive q")
    s, c = math.sin(TURN * hz / rate), math.cos(TURN * hz / rate)
    alpha, a = s / (2 * q), 10 ** (gain_db / 40)
    beta = 2 * math.sqrt(a) * alpha
    up, down = a + 1, a - 1
    b, den = {
        "lowpass": (((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "highpass": (((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "bandpass": ((alpha, 0.0, -alpha), (1 + alpha, -2 * c, 1 - alpha)),
        "notch": ((1.0, -2 * c, 1.0), (1 + alpha, -2 * c, 1 - alpha)),
        "allpass": ((1 - alpha, -2 * c, 1 + alpha), (1 + alpha, -2 * c, 1 - alpha)),
        "peaking": ((1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)),
        "lowshelf": ((a * (up - down * c + beta), 2 * a * (down - up * c), a * (up - down * c - beta)), (up + down * c + beta, -2 * (down + up * c), up + down * c - beta)),
        "highshelf": ((a * (up + down * c + beta), -2 * a * (down + up * c), a * (up + down * c - beta)), (up - down * c + beta, 2 * (down - up * c), up - down * c - beta)),
    }[kind]
    return tuple(x / den[0] for x in (*b, *den[1:]))


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def in_rows(x: np.ndarray, sizes: np.ndarray, most: int = 1 << 22):
    """(which, places, inside, rows): runs of samples of about one size as rows that end in zeros, at most ``most`` samples at once
    unless one run is longer; ``places`` says where in ``x`` each sample of ``rows[inside]`` stands."""
    first, order, at = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        width = max(1, int(sizes[order[at]]))
        which = order[at : at + max(1, most // width)]
        which = which[sizes[which] * 2 >= width]
        which = order[at : at + max(1, len(which))]
        at += len(which)
        inside = np.arange(width) < sizes[which][:, None]
        places = (first[which][:, None] + np.arange(width))[inside]
        rows = np.zeros((len(which), width))
        rows[inside] = x[places]
        yield which, places, inside, rows


def own_part(sizes: np.ndarray, blocks: np.ndarray, size: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(skip, own): of runs that begin up to ``before`` frames before their block, how many frames come before it and how
    many belong to it."""
    skip = np.minimum(blocks * size, before)
    return skip, np.clip(sizes - skip, 0, size)


def by_rows(kernel, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``kernel`` makes of each run of samples; it takes and gives rows of one width, zeros behind shorter runs."""
    out = np.zeros(len(x))
    for _, places, inside, rows in in_rows(x, sizes):
        out[places] = kernel(rows)[inside]
    return out


def biquad(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    """The filtered samples of one run or of rows, in 64-bit floats; state never loses precision."""
    b0, b1, b2, a1, a2 = coefficients
    rows = np.atleast_2d(np.asarray(x, np.float64))
    n = min(BLOCK, max(1, rows.shape[1]))

    def ring(y1: float, y2: float) -> np.ndarray:
        out = []
        for _ in range(n):
            y1, y2 = -a1 * y1 - a2 * y2, y1
            out.append(y1)
        return np.array(out)

    r1, r2 = ring(1.0, 0.0), ring(0.0, 1.0)
    # The all-pole impulse response, as an upper triangular matrix.
    impulse = np.concatenate([[1.0], r1[:-1]])
    matrix = np.triu(impulse[np.subtract.outer(np.arange(n), np.arange(n)).T.clip(0)])
    drive = b0 * rows
    drive[:, 1:] += b1 * rows[:, :-1]
    drive[:, 2:] += b2 * rows[:, :-2]
    y1 = y2 = np.zeros((len(rows), 1))
    for i in range(0, rows.shape[1], n):
        m = min(n, rows.shape[1] - i)
        y = drive[:, i : i + m] @ matrix[:m, :m] + y1 * r1[:m] + y2 * r2[:m]
        drive[:, i : i + m] = y
        y1, y2 = y[:, -1:], (y[:, -2:-1] if m > 1 else y1)
    return drive.reshape(np.shape(x))


def k_weights(rate: float) -> tuple[tuple[float, ...], ...]:
    """The two filters before loudness; the second reads what the first gives in 32-bit floats (fixed values)."""
    k = math.tan(math.pi * 1681.974450955533 / rate)
    vh = 10 ** (3.999843853973347 / 20)
    vb, q = vh**0.4996667741545416, 0.7071752369554196
    den = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / den, 2 * (k * k - vh) / den, (vh - vb * k / q + k * k) / den, 2 * (k * k - 1) / den, (1 - k / q + k * k) / den)
    k, q = math.tan(math.pi * 38.13547087602444 / rate), 0.5003270373238773
    den = 1 + k / q + k * k
    high = (1.0, -2.0, 1.0, 2 * (k * k - 1) / den, (1 - k / q + k * k) / den)
    return shelf, high


def k_weighting(x: np.ndarray, rate: float) -> np.ndarray:
    """Both filters on samples or rows that are at hand."""
    for coefficients in k_weights(rate):
        x = biquad(x, coefficients).astype(np.float32)
    return x


def true_peak_kernel() -> np.ndarray:
    """Weights of 32 samples at each of the four places between two: a sinc under a Blackman window."""
    i = np.arange(128)
    return (np.sinc(i / 4 - 16) * (0.42 - 0.5 * np.cos(TURN * i / 127) + 0.08 * np.cos(2 * TURN * i / 127))).reshape(32, 4)


def true_peaks(x: np.ndarray, sizes: np.ndarray, skip: np.ndarray | int = 0, own: np.ndarray | None = None) -> np.ndarray:
    """For each run, the largest magnitude at four places between samples, zeros beyond the ends; of ``own`` samples behind
    the first ``skip`` ones, if given."""
    kernel, out = true_peak_kernel(), np.zeros(len(sizes))
    skip, own = np.broadcast_to(skip, sizes.shape), sizes if own is None else own
    for which, _, _, rows in in_rows(x, sizes, 1 << 17):
        at = np.arange(rows.shape[1])
        inside = (at >= skip[which][:, None]) & (at < (skip + own)[which][:, None])
        padded = np.pad(rows, ((0, 0), (16, 16)))
        top = np.where(inside, np.abs(rows), 0).max(1)
        for lo in range(0, rows.shape[1], 1 << 15):
            taps = np.lib.stride_tricks.sliding_window_view(padded[:, lo : lo + (1 << 15) + 31], 32, axis=1)[:, : rows.shape[1] - lo]
            between = np.abs(taps @ kernel).max(2)
            top = np.maximum(top, np.where(inside[:, lo : lo + (1 << 15)], between, 0).max(1))
        out[which] = top
    return out


def followed(target: np.ndarray, down: float, up: float) -> np.ndarray:
    """Gains that start at 1 and approach their targets in rows, by ``down`` where these are lower and ``up`` where higher:
    over many rows all at once, over few one by one."""
    shape, target = target.shape, np.atleast_2d(target)
    out = np.empty(target.shape)
    if len(target) >= 16:
        g = np.ones(len(target))
        for i in range(target.shape[1]):
            t = target[:, i]
            g = t + (g - t) * np.where(t < g, down, up)
            out[:, i] = g
        return out.reshape(shape)
    for row, given in zip(out, target.tolist()):
        g, made = 1.0, []
        for t in given:
            g = t + (g - t) * (down if t < g else up)
            made.append(g)
        row[:] = made
    return out.reshape(shape)


def limiter_gains(peak: np.ndarray, ceiling: float, release: float) -> np.ndarray:
    """Gains of rows of look-ahead peaks that are at hand: down at once, up by an exponential that takes ``release`` frames."""
    return followed(np.minimum(1.0, ceiling / np.maximum(peak, 1e-300)), 0.0, math.exp(-1 / release) if release > 0 else 0.0)


def kaiser_table() -> np.ndarray:
    """A sinc under a Kaiser window of beta 10 at steps of 1/512 up to 32."""
    d = np.arange(16385) / 512
    return np.sinc(d) * np.i0(10 * np.sqrt(np.maximum(0, 1 - (d / 32) ** 2))) / np.i0(10.0)


def sinc_weights(centre: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(samples, weights) for each place between samples: a windowed sinc that is cut at 97 % of the lower rate; weights sum to 1."""
    table, cutoff = kaiser_table(), 0.97 * min(ratio, 1.0)
    half = 32 / cutoff
    j = np.ceil(centre - half).astype(np.int64)[:, None] + np.arange(int(2 * half) + 2)
    at = np.abs(centre[:, None] - j) * cutoff * 512
    k = np.minimum(at.astype(np.int64), len(table) - 2)
    w = np.where(at <= 16384, table[k] + (table[k + 1] - table[k]) * (at - k), 0.0)
    return j, w / w.sum(1, keepdims=True)


def resample(x: np.ndarray, ratio: float, frames: int | None = None, start: float = 0.0) -> np.ndarray:
    """Samples of one run or of rows at places start + i / ratio; samples beyond an end are the last one."""
    rows = np.atleast_2d(x)
    size = rows.shape[1]
    n = int(math.floor(size * ratio + 0.5)) if frames is None else frames
    out = np.zeros((len(rows), n), np.float32)
    for lo in range(0, n if size else 0, 4096):
        centre = start + np.arange(lo, min(lo + 4096, n)) / ratio
        j, w = sinc_weights(centre, ratio)
        j = np.clip(j, 0, size - 1)
        if len(rows) < 4:
            out[:, lo : lo + 4096] = [(w * r[j]).sum(1) for r in rows]
        else:  # all rows by one matrix, which has a column for each place and is narrow
            low = int(j.min())
            matrix = np.zeros((len(centre), int(j.max()) + 1 - low))
            np.add.at(matrix, (np.arange(len(centre))[:, None], j - low), w)
            out[:, lo : lo + 4096] = rows[:, low : low + matrix.shape[1]] @ matrix.T
    return out.reshape((*np.shape(x)[:-1], n))


def resample_reach(ratio: float) -> int:
    """Frames on either side that a resampled place reads."""
    return int(math.ceil(32 / (0.97 * min(ratio, 1.0)))) + 2


def resampled_first(blocks: np.ndarray, size: int, ratio: float) -> np.ndarray:
    """The first resampled place of each block of ``size`` frames."""
    return np.ceil(blocks * size * ratio).astype(np.int64)


def resample_blocks(x: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, size: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Every block resampled from runs that reach over it on both sides, and the new sizes; runs that look alike go together.
    A run that ends before its reach does is the end of its clip."""
    reach = resample_reach(ratio)
    skip, own = own_part(sizes, blocks, size, reach)
    begin, end = resampled_first(blocks, size, ratio), resampled_first(blocks + 1, size, ratio)
    frames = blocks * size - skip + sizes  # of the clip, where it ends in sight
    end = np.where(frames < (blocks + 1) * size + reach, np.minimum(end, np.floor(frames * ratio + 0.5).astype(np.int64)), end)
    made = np.where(own > 0, np.maximum(end - begin, 0), 0)
    first, to = np.cumsum(sizes) - sizes, np.cumsum(made) - made
    out = np.zeros(int(made.sum()), np.float32)
    start = begin / ratio - (blocks * size - skip)
    kinds, number = np.unique(np.stack([sizes, made, start], 1), axis=0, return_inverse=True)
    order = np.argsort(number.ravel(), kind="stable")
    cuts = np.searchsorted(number.ravel()[order], np.arange(len(kinds) + 1))
    for k, (n, new, at) in enumerate(kinds.tolist()):
        n, new, same = int(n), int(new), order[cuts[k] : cuts[k + 1]]
        for i in range(0, len(same) if new else 0, step := max(1, (1 << 20) // max(1, n))):
            part = same[i : i + step]
            rows = x[first[part][:, None] + np.arange(n)].astype(np.float64)
            out[to[part][:, None] + np.arange(new)] = resample(rows, ratio, new, at)
    return out, made


def resample_runs(x: np.ndarray, sizes: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Every run resampled as a whole, and the new sizes."""
    return resample_blocks(x, sizes, np.zeros(len(sizes), np.int64), 1 << 40, ratio)


def tempo_sizes(rate: int) -> tuple[int, int, int]:
    """Window, hop and search radius of changes of tempo."""
    window = max(256, int(math.floor(0.05 * rate + 0.5))) & ~1
    return window, window // 2, window // 8


def tempo_places(x: np.ndarray, factor: float, rate: int) -> np.ndarray:
    """Where each block of another tempo is taken from: near its due place, where every other sample of half a window is
    most like what follows the block before."""
    window, hop, radius = tempo_sizes(rate)
    n, frames = len(x), int(math.floor(len(x) / factor + 0.5))
    source, last, out = np.concatenate([x, np.zeros(hop)]).astype(np.float64), 0, []
    for block in range(-(-frames // hop)):
        due = int(math.floor(block * hop * factor + 0.5))
        if due >= n:
            break
        best = due
        if block and last + hop < n:
            size = min(hop, n - last - hop)
            template = source[last + hop : last + hop + size : 2]
            places = np.arange(max(0, due - radius), min(n - 1, due + radius) + 1)
            views = np.lib.stride_tricks.sliding_window_view(source, size)[places][:, ::2]
            energy = (views**2).sum(1)
            score = np.where(energy > 0, views @ template / np.sqrt(np.where(energy > 0, energy, 1.0)), 0.0)
            best = int(places[score.argmax()])
        out.append(best)
        last = best
    return np.array(out, np.int64)


def tempo_overlap(run: np.ndarray, channel: np.ndarray, frame: np.ndarray, x: np.ndarray, channels: np.ndarray, begin: np.ndarray, size: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray], rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Another tempo's samples in ranges of ``size`` frames from ``begin`` on, for each channel of many runs one after the
    other, and which of them hold nulls only. Samples (run, channel, frame, x; a masked array where some are null) are
    added under windows at their (run, number, place), and the sums of the windows divided out."""
    (window, hop, _), (of, number, place) = tempo_sizes(rate), places
    shares = (0.5 - 0.5 * np.cos((np.arange(window) + 0.5) / window * TURN)).astype(np.float32).astype(np.float64)
    low, high = np.full(len(channels), np.iinfo(np.int64).max), np.zeros(len(channels), np.int64)
    np.minimum.at(low, of, place)
    np.maximum.at(high, of, place + window)
    first, which = np.cumsum(channels) - channels, np.repeat(np.arange(len(channels)), channels)
    width = np.maximum(high - low, 0)[which]
    base, to = np.cumsum(width) - width, np.cumsum(size[which]) - size[which]
    inside = (frame >= low[run]) & (frame < high[run])
    at = base[first[run[inside]] + channel[inside]] + frame[inside] - low[run[inside]]
    heard, total = ~np.ma.getmaskarray(x)[inside], int(width.sum())
    dense = np.bincount(at, np.where(heard, np.ma.getdata(x)[inside], 0.0), total)
    there, known = np.bincount(at, minlength=total), np.bincount(at, heard, total)
    each = np.repeat(np.arange(len(of)), channels[of])
    lane = first[of][each] + ragged(channels[of])
    target = (number * hop - begin[of])[each][:, None] + np.arange(window)
    kept = (target >= 0) & (target < size[of][each][:, None])
    source = ((base[lane] + (place - low[of])[each])[:, None] + np.arange(window))[kept]
    target, share, made = (to[lane][:, None] + target)[kept], np.broadcast_to(shares, kept.shape)[kept], int(size[which].sum())
    sums = np.bincount(target, (dense[source] * share).astype(np.float32), made).astype(np.float32).astype(np.float64)
    weights = np.bincount(target, there[source] * share, made)
    loud = weights > 1e-12
    out = np.where(loud, sums / np.where(loud, weights, 1.0).astype(np.float32), 0.0).astype(np.float32)
    return out, loud & (np.bincount(target, known[source], made) == 0)


def one_pole_coefficients(hz: float, rate: float, high: bool = False) -> tuple[float, ...]:
    """A first-order low-pass by the trapezoid rule, or what is left above it, as a biquad."""
    g = math.tan(math.pi * min(hz, 0.49 * rate) / rate)
    a = g / (1 + g)
    return (1 - a, a - 1, 0.0, 2 * a - 1, 0.0) if high else (a, a, 0.0, 2 * a - 1, 0.0)


def one_pole(x: np.ndarray, hz: float, rate: float, high: bool = False) -> np.ndarray:
    """That filter on samples or rows that are at hand."""
    return biquad(x, one_pole_coefficients(hz, rate, high))


def compressor_gains(peak: np.ndarray, rate: float, threshold_db: float, ratio: float, attack_ms: float, release_ms: float, makeup_db: float = 0.0, depth: float = 1.0) -> np.ndarray:
    """Gains from the magnitudes of a key signal: a hard knee, then attack and release."""
    threshold, makeup = 10 ** (threshold_db / 20), 10 ** (makeup_db / 20)
    down, up = (math.exp(-1000 / (ms * rate)) if ms > 0 else 0.0 for ms in (attack_ms, release_ms))
    target = 1 - depth * (1 - np.where(peak > threshold, (threshold / np.maximum(peak, threshold)) ** (1 - 1 / ratio), 1.0))
    return followed(target, down, up) * makeup


def delay(x: np.ndarray, frames: float, feedback: float, wet: float) -> np.ndarray:
    """An echo that feeds back, of rows, between samples by straight lines; blocks are as long as the echo allows."""
    rows = np.atleast_2d(x).astype(np.float64)
    whole, rest, width = int(frames), frames - int(frames), rows.shape[1]
    line, heard = np.concatenate([np.zeros((len(rows), whole + 2)), rows], 1), np.zeros_like(rows)
    base, step = whole + 2, max(1, whole)
    for i in range(0, width, step):
        at = np.arange(i, min(i + step, width)) + base - whole
        heard[:, i : i + step] = line[:, at] * (1 - rest) + line[:, at - 1] * rest
        line[:, base + i : base + i + len(at)] += feedback * heard[:, i : i + step]
    return (rows * (1 - wet) + heard * wet).reshape(np.shape(x))


def modulated_delay(x: np.ndarray, rate: float, delay_ms: float, depth_ms: float, hz: float, feedback: float, spread: float, wet: float, taps: int, longest_ms: float, channel: int = 0) -> np.ndarray:
    """Chorus (two taps a quarter turn apart) and flanger (one) of rows: delays that a sine moves, fed back; ``spread`` turns
    the sine of the second channel."""
    rows = np.atleast_2d(x).astype(np.float64)
    width = rows.shape[1]
    turns = np.arange(width) * hz / rate + channel * spread
    delays = [np.clip((delay_ms + depth_ms * np.sin(TURN * (turns + k / 4))) * rate / 1000, 1.0, longest_ms * rate / 1000) for k in range(taps)]
    before = int(longest_ms * rate / 1000) + 2
    line, heard = np.concatenate([np.zeros((len(rows), before)), rows], 1), np.zeros_like(rows)
    # A block is shorter than every delay, so what it reads is there.
    step = max(1, int(math.ceil(min(d.min() for d in delays))) - 1) if feedback and width else max(1, width)
    for i in range(0, width, step):
        at = np.arange(i, min(i + step, width))
        for d in delays:
            place = at + before - d[at]
            low = np.floor(place).astype(np.int64)
            rest = place - low
            heard[:, at] += (line[:, low] * (1 - rest) + line[:, np.minimum(low + 1, at + before)] * rest) / taps
        line[:, at + before] += feedback * heard[:, at]
    return (rows * (1 - wet) + heard * wet).reshape(np.shape(x))


def reverb(x: np.ndarray, rate: float, decay_s: float, damping: float, wet: float, channel: int = 0) -> np.ndarray:
    """Four damped combs side by side and two all-passes in a row, of rows (lengths in seconds are fixed values)."""
    rows = np.atleast_2d(x).astype(np.float64)
    width = rows.shape[1]
    size_of = lambda seconds: max(1, int(math.floor((seconds + 0.0011 * channel) * rate + 0.5)))
    y = np.zeros_like(rows)
    for seconds in (0.0297, 0.0371, 0.0411, 0.0437):
        size = size_of(seconds)
        back = 10 ** (-60 * size / (rate * decay_s) / 20)
        line, memory = np.concatenate([np.zeros((len(rows), size)), rows], 1), np.zeros((len(rows), 1))
        for i in range(0, width, size):
            d = line[:, i : i + size][:, : width - i]
            damped = biquad(d, (1 - damping, 0.0, 0.0, -damping, 0.0)) + memory * damping ** np.arange(1, d.shape[1] + 1)
            line[:, size + i : size + i + d.shape[1]] += back * damped
            memory = damped[:, -1:]
        y += line[:, :width] / 4
    for seconds in (0.005, 0.0017):
        size = size_of(seconds)
        line, out = np.zeros((len(rows), size + width)), np.empty_like(y)
        for i in range(0, width, size):
            m = min(size, width - i)
            out[:, i : i + m] = line[:, i : i + m] - 0.5 * y[:, i : i + m]
            line[:, size + i : size + i + m] = y[:, i : i + m] + 0.5 * out[:, i : i + m]
        y = out
    return (rows * (1 - wet) + y * wet).reshape(np.shape(x))


def phaser(x: np.ndarray, rate: float, centre_hz: float, depth: float, hz: float, feedback: float, spread: float, wet: float, channel: int = 0) -> np.ndarray:
    """Four all-pass stages whose frequency a sine moves, fed back from the last sample, of rows all at once."""
    rows = np.atleast_2d(x).astype(np.float64)
    f = np.clip(centre_hz * 2 ** (depth * np.sin(TURN * (np.arange(rows.shape[1]) * hz / rate + channel * spread))), 1.0, 0.45 * rate)
    g = np.tan(np.pi * f / rate)
    state, last, out = [np.zeros(len(rows)) for _ in range(4)], np.zeros(len(rows)), np.empty_like(rows)
    for i, a in enumerate(((g - 1) / (g + 1)).tolist()):
        y = rows[:, i] + feedback * last
        for k in range(4):
            z = a * y + state[k]
            state[k], y = y - a * z, z
        last = out[:, i] = y
    return (rows * (1 - wet) + out * wet).reshape(np.shape(x))


def bitcrush(x: np.ndarray, bits: float, ratio: float, wet: float = 1.0) -> np.ndarray:
    """Holds samples of rows at a lower rate and rounds them to a number of bits, between two numbers by their mix."""
    rows = np.atleast_2d(x).astype(np.float64)
    held = np.floor(np.arange(rows.shape[1]) * ratio + 1e-9)
    v = np.clip(rows[:, np.searchsorted(held, held, "left")], -1, 1)

    def rounded(b: int) -> np.ndarray:
        full = 2.0 ** (b - 1)
        return np.clip(np.sign(v) * np.floor(np.abs(v) * full + 0.5), -full, full - 1) / full

    low = rounded(int(bits))
    crushed = low + (rounded(min(24, int(bits) + 1)) - low) * (bits - int(bits))
    return (rows * (1 - wet) + crushed * wet).reshape(np.shape(x))


def fine_kernel() -> np.ndarray:
    """Weights of 64 samples at seven places between two, each place's summing to 1: a sinc under a Blackman window."""
    t = np.arange(64)[:, None] - 31 - np.arange(1, 8) / 8
    w = np.sinc(t) * (0.42 + 0.5 * np.cos(TURN * t / 64) + 0.08 * np.cos(TURN * t / 32))
    return w / w.sum(0)


def fine_peaks(x: np.ndarray, sizes: np.ndarray, begins: np.ndarray | bool = True, ends: np.ndarray | bool = True) -> np.ndarray:
    """For each sample of each run the largest magnitude from it to the next one by eightfold reconstruction; the first
    and last samples of a clip answer for what rings before and after it, too. Runs may be without their clip's beginning or
    end; there, 32 samples on either side only serve the others."""
    kernel, out = fine_kernel(), np.zeros(len(x))
    begins, ends = np.broadcast_to(begins, sizes.shape), np.broadcast_to(ends, sizes.shape)
    for which, places, inside, rows in in_rows(x, sizes, 1 << 16):
        n, width = sizes[which], rows.shape[1]
        padded = np.pad(rows, ((0, 0), (63, 64)))
        top = np.empty((len(rows), width + 64))  # from 32 places before the run on
        for lo in range(0, width + 64, 1 << 14):
            views = np.lib.stride_tricks.sliding_window_view(padded[:, lo : lo + (1 << 14) + 63], 64, axis=1)[:, : width + 64 - lo]
            top[:, lo : lo + (1 << 14)] = np.abs(views @ kernel).max(2)
        peak = np.maximum(np.abs(rows), top[:, 32 : 32 + width])
        peak[:, 0] = np.maximum(peak[:, 0], np.where(begins[which], top[:, :32].max(1), 0))
        at = np.arange(width + 64) - 32
        rings = np.where((at >= n[:, None]) & (at < n[:, None] + 32), top, 0).max(1)
        peak[np.arange(len(rows)), n - 1] = np.maximum(peak[np.arange(len(rows)), n - 1], np.where(ends[which], rings, 0))
        out[places] = peak[inside]
    return out


def columns_of(x: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, size: int, hop: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes of all bins of each column that begins in each block of ``columns`` hops, and their number; columns reach
    over the block's end, and over the clip's into zeros."""
    made = np.clip(-(-sizes // hop), 0, columns)
    first = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(sizes)), made)
    start = ragged(made) * hop
    bins, out, step = size // 2 + 1, np.zeros((len(run), size // 2 + 1)), max(1, (1 << 20) // size)
    padded = np.append(x, np.float32(0))
    for lo in range(0, len(run), step):
        r, at = run[lo : lo + step], start[lo : lo + step][:, None] + np.arange(size)
        out[lo : lo + step] = spectra(padded[np.where(at < sizes[r][:, None], first[r][:, None] + at, len(x))].astype(np.float64))
    return out.ravel(), made * bins


def spectra(rows: np.ndarray) -> np.ndarray:
    """Magnitudes of rows of samples under a symmetric Hann window."""
    size = rows.shape[1]
    window = 0.5 - 0.5 * np.cos(TURN * np.arange(size) / (size - 1))
    m = np.abs(np.fft.rfft(rows * window, axis=1)) / window.sum()
    m[:, 1:-1] *= 2
    return m
