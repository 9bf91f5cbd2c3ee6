"""Queries over the tables read as signals, with their SQL: editing, channels, levels, measurements, filters."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.units import f32, f64, format_duration, frame_index, parse_time, rounded
from ..operators import dsp, kernels, levels, measure, shape
from ..sources import bindings as b
from ..sources.bindings import EMB_SQL, LINE_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shown(frames):
    """Frames with samples rounded for comparison."""
    return frames.select(F.col("clip").cast("bigint").alias("clip"), F.col("channel").cast("int").alias("channel"), F.col("frame").cast("bigint").alias("frame"), rounded(F.col("sample")).alias("sample"))


R = "round(CAST({} AS DOUBLE), 6) + 0.0 AS sample"
N = "n AS (SELECT clip, max(frame) + 1 AS n FROM frames GROUP BY clip)"


def frames_sql(body: str, base: str = EMB_SQL, more: str = "") -> str:
    return f"WITH {base}, {N}{', ' + more if more else ''} SELECT CAST(clip AS BIGINT) AS clip, CAST(channel AS INT) AS channel, CAST(frame AS BIGINT) AS frame, {body}"


LEVEL_SQL = f"""WITH {LINE_SQL}, s AS (SELECT clip, max(frame) + 1 AS frames, max(abs(CAST(sample AS DOUBLE))) AS peak, avg(CAST(sample AS DOUBLE) * CAST(sample AS DOUBLE)) AS ms FROM frames GROUP BY clip)
SELECT clip, frames, round(peak, 6) + 0.0 AS peak, round(20 * log10(peak), 6) + 0.0 AS peak_db, round(ms, 6) + 0.0 AS mean_square, round(sqrt(ms), 6) + 0.0 AS rms, round(20 * log10(sqrt(ms)), 6) + 0.0 AS rms_db FROM s"""


@query("measure_levels", LEVEL_SQL)
def measure_levels(spark, d):
    out = measure.clip_levels(b.line_frames(spark, d))
    return out.select("clip", "frames", *(rounded(F.col(c)).alias(c) for c in ("peak", "peak_db", "mean_square", "rms", "rms_db")))


@query("dc_means", f"WITH {LINE_SQL} SELECT clip, channel, round(avg(CAST(sample AS DOUBLE)), 6) + 0.0 AS mean FROM frames GROUP BY clip, channel")
def dc_means(spark, d):
    return measure.dc_means(b.line_frames(spark, d)).select("clip", "channel", rounded(F.col("mean")).alias("mean"))


@query(
    "waveform_32",
    f"""WITH {LINE_SQL}, {N}, k AS (SELECT clip, n, i AS bucket, i * n // 32 AS lo, greatest((i + 1) * n // 32, i * n // 32 + 1) AS hi FROM n, generate_series(0, 31) t(i))
SELECT k.clip, CAST(bucket AS BIGINT) AS bucket, round(CAST(least(0, min(sample)) AS DOUBLE), 6) + 0.0 AS lo, round(CAST(greatest(0, max(sample)) AS DOUBLE), 6) + 0.0 AS hi
FROM k JOIN frames f ON f.clip = k.clip AND f.frame >= k.lo AND f.frame < k.hi GROUP BY k.clip, bucket""",
)
def waveform_32(spark, d):
    return measure.waveform(b.line_frames(spark, d), 32).select("clip", F.col("bucket").cast("bigint").alias("bucket"), rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))


@query(
    "stereo_statistics",
    f"""WITH {LINE_SQL}, x AS (SELECT clip, CAST(l AS DOUBLE) AS l, CAST(r AS DOUBLE) AS r FROM line)
SELECT clip, count(*) AS frames, round(corr(l, r), 6) + 0.0 AS correlation, round(avg(l * l), 6) + 0.0 AS left_ms, round(avg(r * r), 6) + 0.0 AS right_ms,
round(avg((l + r) * 0.5 * (l + r) * 0.5), 6) + 0.0 AS mid_ms, round(avg((l - r) * 0.5 * (l - r) * 0.5), 6) + 0.0 AS side_ms FROM x GROUP BY clip""",
)
def stereo_statistics(spark, d):
    out = measure.stereo_statistics(b.line_stereo(spark, d))
    return out.select("clip", "frames", *(rounded(F.col(c)).alias(c) for c in ("correlation", "left_ms", "right_ms", "mid_ms", "side_ms")))


@query(
    "threshold_silence",
    f"""WITH {EMB_SQL}, {N}, s AS (SELECT clip, min(frame) FILTER (WHERE abs(CAST(sample AS DOUBLE)) > 0.3) AS a, max(frame) FILTER (WHERE abs(CAST(sample AS DOUBLE)) > 0.3) AS e FROM frames GROUP BY clip)
SELECT n.clip, coalesce(a, n) AS leading, coalesce(n - 1 - e, n) AS trailing FROM n JOIN s ON s.clip = n.clip""",
)
def threshold_silence(spark, d):
    return measure.threshold_silence(b.emb_frames(spark, d), 0.3)


SILENCE = {"threshold_db": -18.0, "least": 8, "window": 4}
SILENCE_SQL = f"""{EMB_SQL}, {N}, w AS (SELECT clip, frame // 4 AS w, channel, avg(CAST(sample AS DOUBLE) * CAST(sample AS DOUBLE)) AS p, max(frame) + 1 AS e FROM frames GROUP BY 1, 2, 3),
q AS (SELECT clip, w, max(p) <= pow(10.0::DOUBLE, -36.0 / 20) AS silent, max(e) AS e FROM w GROUP BY 1, 2),
g AS (SELECT *, w - row_number() OVER (PARTITION BY clip, silent ORDER BY w) AS run FROM q),
r AS (SELECT clip, min(w) * 4 AS a, max(e) AS e FROM g WHERE silent GROUP BY clip, run),
silent AS (SELECT clip, a AS start, e AS end_ FROM r WHERE e - a >= 8)"""


@query("silent_ranges", f'WITH {SILENCE_SQL} SELECT clip, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS "end" FROM silent')
def silent_ranges(spark, d):
    return measure.silent_ranges(b.emb_frames(spark, d), **SILENCE)


@query(
    "trim_silence",
    f"""WITH {SILENCE_SQL}, c AS (SELECT s.clip, max(CASE WHEN start = 0 THEN end_ END) AS a, max(CASE WHEN end_ = n THEN start END) AS e FROM silent s JOIN n ON n.clip = s.clip GROUP BY s.clip)
SELECT f.clip, channel, frame - coalesce(a, 0) AS frame, {R.format('sample')} FROM frames f LEFT JOIN c ON c.clip = f.clip WHERE frame >= coalesce(a, 0) AND (e IS NULL OR frame < e)""",
)
def trim_silence(spark, d):
    return shown(measure.trim_silence(b.emb_frames(spark, d), **SILENCE))


@query(
    "boundary_steps",
    f"""WITH {EMB_SQL}, q AS (SELECT DISTINCT clip, 1 AS request, 16 AS place FROM frames UNION ALL SELECT DISTINCT clip, 2, 48 FROM frames)
SELECT q.clip, request, f.channel, round(CAST(p.sample AS DOUBLE), 6) + 0.0 AS before, round(CAST(f.sample AS DOUBLE), 6) + 0.0 AS after, round(CAST(f.sample AS DOUBLE) - CAST(p.sample AS DOUBLE), 6) + 0.0 AS step
FROM q JOIN frames f ON f.clip = q.clip AND f.frame = place JOIN frames p ON p.clip = q.clip AND p.channel = f.channel AND p.frame = place - 1""",
)
def boundary_steps(spark, d):
    frames = b.emb_frames(spark, d)
    asked = frames.select("clip").distinct().select("clip", F.explode(F.array(F.struct(F.lit(1).alias("request"), F.lit(16).cast("bigint").alias("frame")), F.struct(F.lit(2).alias("request"), F.lit(48).cast("bigint").alias("frame")))).alias("q")).select("clip", "q.request", "q.frame")
    out = measure.boundaries(frames, asked)
    return out.select("clip", "request", "channel", *(rounded(F.col(c)).alias(c) for c in ("before", "after", "step")))


@query(
    "look_ahead_peak",
    f"""WITH {LINE_SQL}, p AS (SELECT clip, frame, greatest(abs(CAST(l AS DOUBLE)), abs(CAST(r AS DOUBLE))) AS x FROM line)
SELECT clip, frame, round(max(x) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 48 FOLLOWING), 6) + 0.0 AS peak FROM p""",
)
def look_ahead_peak(spark, d):
    return measure.look_ahead_peak(b.line_frames(spark, d), 48).select("clip", "frame", rounded(F.col("peak")).alias("peak"))


# Pointwise ---------------------------------------------------------------------------------------------------------

S = "CAST(sample AS DOUBLE)"


def f32_sql(x: str) -> str:
    return R.format(f"CAST({x} AS FLOAT)")


@query("gain_db", frames_sql(f32_sql(f"{S} * pow(10.0::DOUBLE, -6.0 / 20)") + " FROM frames"))
def gain_db(spark, d):
    return shown(levels.gain_db(b.emb_frames(spark, d), -6.0))


for _kind, _curve in {"linear": "{0}", "equal_power": "sin({0} / 4 * 6.283185307179586)", "exponential": "{0} * {0}"}.items():

    def _fade(spark, d, kind=_kind):
        return shown(levels.fade(b.emb_frames(spark, d), 16, 24, kind))

    _in, _out = (_curve.format(f"(CAST({x} AS DOUBLE))") for x in ("frame / 15.0::DOUBLE", "(n - 1 - frame) / 23.0::DOUBLE"))
    query(f"fade_{_kind}", frames_sql(f32_sql(f"{S} * (CASE WHEN frame < 16 THEN {_in} ELSE 1.0 END) * (CASE WHEN frame >= n - 24 THEN {_out} ELSE 1.0 END)") + " FROM frames JOIN n USING (clip)"))(_fade)


@query("remove_dc", frames_sql(f32_sql(f"{S} - avg({S}) OVER (PARTITION BY clip, channel)") + " FROM frames", LINE_SQL))
def remove_dc(spark, d):
    return shown(levels.remove_dc(b.line_frames(spark, d)))


@query("normalize_peak", frames_sql(f32_sql(f"{S} * pow(10.0::DOUBLE, (-1.0 - 20 * log10(max(abs({S})) OVER (PARTITION BY clip))) / 20)") + " FROM frames"))
def normalize_peak(spark, d):
    return shown(levels.normalize(b.emb_frames(spark, d), -1.0)[0])


@query("normalize_rms", f"WITH {LINE_SQL} SELECT clip, round(10 * log10(avg({S} * {S})), 6) + 0.0 AS measured, round(-20.0 - 10 * log10(avg({S} * {S})), 6) + 0.0 AS gain_db FROM frames GROUP BY clip")
def normalize_rms(spark, d):
    report = levels.normalize(b.line_frames(spark, d), -20.0, "rms")[1]
    return report.select("clip", rounded(F.col("measured")).alias("measured"), rounded(F.col("gain_db")).alias("gain_db"))


def _k_weighting_sql(rate: int) -> str:
    """w(clip, channel, frame, x): the two filters before loudness, the second over what the first gives in 32 bits."""

    def stage(k: float, q: float, gain: float | None) -> list[float]:
        den = 1 + k / q + k * k
        top = gain**0.4996667741545416 if gain else 0.0
        b = [(gain + top * k / q + k * k) / den, 2 * (k * k - gain) / den, (gain - top * k / q + k * k) / den] if gain else [1.0, -2.0, 1.0]
        return [*b, 2 * (k * k - 1) / den, (1 - k / q + k * k) / den]

    one = stage(math.tan(math.pi * 1681.974450955533 / rate), 0.7071752369554196, 10 ** (3.999843853973347 / 20))
    two = stage(math.tan(math.pi * 38.13547087602444 / rate), 0.5003270373238773, None)
    filtered = lambda c, x, x1, x2, y1, y2: f"({c[0]!r}::DOUBLE * {x} + {c[1]!r}::DOUBLE * {x1} + {c[2]!r}::DOUBLE * {x2} - ({c[3]!r}::DOUBLE) * {y1} - ({c[4]!r}::DOUBLE) * {y2})"
    y = filtered(one, S, "r.x1", "r.x2", "r.y1", "r.y2")
    return f"""r(clip, channel, frame, x1, x2, y1, y2, z1, z2) AS (SELECT clip, channel, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT clip, channel FROM frames)
UNION ALL SELECT clip, channel, frame, x, x1, y, y1, {filtered(two, 'CAST(CAST(y AS FLOAT) AS DOUBLE)', 'CAST(CAST(y1 AS FLOAT) AS DOUBLE)', 'CAST(CAST(y2 AS FLOAT) AS DOUBLE)', 'z1', 'z2')}, z1
FROM (SELECT r.clip, r.channel, f.frame, {S} AS x, r.x1, {y} AS y, r.y1, r.y2, r.z1, r.z2 FROM r JOIN frames f ON f.clip = r.clip AND f.channel = r.channel AND f.frame = r.frame + 1)),
w AS (SELECT clip, channel, frame, CAST(CAST(z1 AS FLOAT) AS DOUBLE) AS x FROM r WHERE frame >= 0)"""


@query(
    "normalize_lufs",
    f"""WITH RECURSIVE {LINE_SQL}, {_k_weighting_sql(48_000)}, n AS (SELECT clip, max(frame) + 1 AS n FROM w GROUP BY clip),
b AS (SELECT n.clip, CASE WHEN n < 19200 THEN -1 ELSE i END AS block, least(n, 19200) AS size, CASE WHEN n < 19200 THEN 0 ELSE i * 4800 END AS a FROM n, generate_series(0, CASE WHEN n < 19200 THEN 0 ELSE (n - 19200) // 4800 END) t(i)),
p AS (SELECT b.clip, block, sum(x * x) / any_value(size) AS p FROM b JOIN w ON w.clip = b.clip AND w.frame >= a AND w.frame < a + size GROUP BY 1, 2),
l AS (SELECT *, -0.691::DOUBLE + 10 * log10(p) AS l FROM p), g AS (SELECT *, -0.691::DOUBLE + 10 * log10(avg(p) FILTER (WHERE l >= -70) OVER (PARTITION BY clip)) - 10 AS gate FROM l),
m AS (SELECT clip, -0.691::DOUBLE + 10 * log10(avg(p)) AS measured FROM g WHERE block < 0 OR (l >= -70 AND l >= gate) GROUP BY clip)
SELECT clip, round(measured, 6) + 0.0 AS measured, round(-16.0 - measured, 6) + 0.0 AS gain_db FROM m""",
)
def normalize_lufs(spark, d):
    report = levels.normalize(b.line_frames(spark, d), -16.0, "lufs", b.LINE_RATE)[1]
    return report.select("clip", rounded(F.col("measured")).alias("measured"), rounded(F.col("gain_db")).alias("gain_db"))


_LINES = LINE_SQL.partition(",\nframes")[0]  # without the long form
_QUIET = "CASE WHEN clip % 4 < 3 AND clip // 4 % 3 = 0 THEN 1e-6::DOUBLE WHEN clip % 4 < 3 AND clip // 4 % 3 = 1 THEN 1e-3::DOUBLE ELSE 1.0::DOUBLE END"


@query(
    "loudness_gates",
    f"""WITH RECURSIVE {_LINES},
part AS MATERIALIZED (SELECT clip // 4 AS clip, row_number() OVER (PARTITION BY clip // 4 ORDER BY clip, frame) - 1 AS frame, CAST(CAST(l AS DOUBLE) * {_QUIET} AS FLOAT) AS l, CAST(CAST(r AS DOUBLE) * {_QUIET} AS FLOAT) AS r FROM line),
frames AS MATERIALIZED (SELECT clip, 0 AS channel, frame, l AS sample FROM part UNION ALL SELECT clip, 1, frame, r FROM part), {_k_weighting_sql(4000)},
n AS (SELECT clip, max(frame) + 1 AS n FROM w GROUP BY clip), b AS (SELECT n.clip, CASE WHEN n < 1600 THEN -1 ELSE i END AS block, least(n, 1600) AS size, CASE WHEN n < 1600 THEN 0 ELSE i * 400 END AS a FROM n, generate_series(0, CASE WHEN n < 1600 THEN 0 ELSE (n - 1600) // 400 END) t(i)),
p AS (SELECT b.clip, block, sum(x * x) / any_value(size) AS p FROM b JOIN w ON w.clip = b.clip AND w.frame >= a AND w.frame < a + size GROUP BY 1, 2),
l AS (SELECT *, -0.691::DOUBLE + 10 * log10(p) AS l FROM p), g AS (SELECT *, -0.691::DOUBLE + 10 * log10(avg(p) FILTER (WHERE l >= -70) OVER (PARTITION BY clip)) - 10 AS gate FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY l) - 1 AS r, count(*) OVER (PARTITION BY clip) AS n FROM g WHERE block >= 0 AND l >= -70 AND l >= gate),
m AS (SELECT clip, -0.691::DOUBLE + 10 * log10(avg(p)) AS lufs, max(CASE WHEN r = least(n * 95 // 100, n - 1) THEN l END) - max(CASE WHEN r = n // 10 THEN l END) AS range_lu, any_value(n) AS gated FROM k GROUP BY clip),
t AS (SELECT clip, max(l) AS top, min(block) AS least, count(*) AS blocks FROM l GROUP BY clip)
SELECT t.clip, blocks, coalesce(gated, 0) AS gated, round(CASE WHEN least < 0 THEN top ELSE lufs END, 4) + 0.0 AS lufs, round(coalesce(range_lu, 0.0), 4) + 0.0 AS range_lu, round(top, 4) + 0.0 AS momentary FROM t LEFT JOIN m ON m.clip = t.clip WHERE least < 0 OR lufs IS NOT NULL""",
)
def loudness_gates(spark, d):
    """Clips of four suppliers each, three of them far below the fourth in two clips of three, so that both gates bite."""
    line = b.line_stereo(spark, d)
    loud = F.when(F.col("clip") % 4 < 3, F.element_at(F.array(F.lit(1e-6), F.lit(1e-3), F.lit(1.0)), (F.floor(F.col("clip") / 4) % 3 + 1).cast("int"))).otherwise(1.0)
    group = F.floor(F.col("clip") / 4).cast("bigint")
    place = F.row_number().over(Window.partitionBy(group).orderBy("clip", "frame")) - 1
    parts = line.select(group.alias("clip"), place.cast("bigint").alias("frame"), F.array(*(f32(f64(F.col(c)) * loud) for c in "lr")).alias("both"))
    parts = parts.select("clip", "frame", F.posexplode("both").alias("channel", "sample"))
    blocks = measure.loudness_blocks(parts.select("clip", "channel", "frame", "sample"), 4000)
    kept = measure.gated_blocks(blocks).groupBy("clip").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("_kept") & (F.col("block") >= 0), 1)).alias("gated"))
    out = measure.gated(blocks).join(kept, "clip").where(F.col("momentary") > float("-inf"))
    return out.select("clip", "blocks", "gated", *(rounded(F.col(c), 4).alias(c) for c in ("lufs", "range_lu", "momentary")))


_LIMBS = f"SELECT clip, CAST(CASE WHEN sample = 0 THEN 0 ELSE floor(log2(abs({S})) / 16) END AS INT) AS limb, {S} AS x FROM frames"


@query(
    "exact_limbs",
    f"""WITH {LINE_SQL}, l AS ({_LIMBS}), w AS (SELECT clip, limb, CAST(x * pow(2.0::DOUBLE, 26 - limb * 16) AS HUGEINT) AS w FROM l)
SELECT clip, limb, count(*) AS n, CAST(sum(w) AS VARCHAR) AS total, CAST(sum(w * w) AS VARCHAR) AS squares FROM w GROUP BY 1, 2""",
)
def exact_limbs(spark, d):
    out = measure.exact_limbs(b.line_frames(spark, d), ["clip"])
    return out.select("clip", "limb", "n", F.col("total").cast("string").alias("total"), F.col("squares").cast("string").alias("squares"))


@query(
    "exact_levels",
    f"""WITH {LINE_SQL}, l AS ({_LIMBS}), w AS (SELECT clip, limb, CAST(x * pow(2.0::DOUBLE, 26 - limb * 16) AS HUGEINT) AS w FROM l),
s AS (SELECT clip, limb, count(*) AS n, CAST(sum(w) AS DOUBLE) * pow(2.0::DOUBLE, limb * 16 - 26) AS t, CAST(sum(w * w) AS DOUBLE) * pow(2.0::DOUBLE, (limb * 16 - 26) * 2) AS q FROM w GROUP BY 1, 2),
a AS (SELECT clip, CAST(sum(n) AS BIGINT) AS n, list_sum(list(t ORDER BY limb)) / sum(n) AS mean, list_sum(list(q ORDER BY limb)) / sum(n) AS ms FROM s GROUP BY clip)
SELECT clip, n, round(mean, 12) + 0.0 AS mean, round(ms, 12) + 0.0 AS mean_square, round(sqrt(ms), 9) + 0.0 AS rms, round(20 * log10(sqrt(ms)), 9) + 0.0 AS rms_db FROM a""",
)
def exact_levels(spark, d):
    out = measure.exact_levels(b.line_frames(spark, d))
    return out.select("clip", "n", *(rounded(F.col(c), 12).alias(c) for c in ("mean", "mean_square")), *(rounded(F.col(c), 9).alias(c) for c in ("rms", "rms_db")))


_V = f"({S} * pow(10.0::DOUBLE, 12.0 / 20))"


@query("saturation", frames_sql(f32_sql(f"(CASE WHEN abs({_V}) < 1 THEN {_V} - {_V} * {_V} * {_V} / 3 ELSE sign({_V}) * (2.0::DOUBLE / 3.0) END) * pow(10.0::DOUBLE, -3.0 / 20)") + " FROM frames"))
def saturation(spark, d):
    return shown(levels.saturate(b.emb_frames(spark, d), 12.0, -3.0))


for _kind in ("u8", "s16", "s24"):

    def _quantize(spark, d, kind=_kind):
        return levels.quantize(b.line_frames(spark, d), kind)

    _full = float(1 << (levels.BITS[_kind] - 1))
    query(f"quantize_{_kind}", f"WITH {LINE_SQL} SELECT clip, channel, frame, CAST(greatest(-{_full}, least({_full} - 1, sign({S}) * floor(abs({S}) * {_full} + 0.5))) AS BIGINT) + {128 if _kind == 'u8' else 0} AS code FROM frames")(_quantize)


def _mixed_sql(x: str) -> str:
    """Two rounds of multiplying and shifting in 64 bits."""
    for by, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"(CAST(CAST(xor({x}, {x} >> {by}) AS UHUGEINT) * {k}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT))"
    return x


def _draw_sql(k: int) -> str:
    return f"(SELECT xor(z, z >> 31) >> 11 FROM (SELECT {_mixed_sql('y')} AS z FROM (SELECT CAST((CAST(start AS UHUGEINT) + (frame * 2 + {k + 1})::UHUGEINT * {levels.COUNTER_STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS y)))"


@query(
    "quantize_s16_dither",
    f"""WITH {LINE_SQL}, c AS MATERIALIZED (SELECT DISTINCT channel FROM frames), s AS MATERIALIZED (SELECT channel, xor(z, z >> 31) AS start FROM (SELECT channel, {_mixed_sql('y')} AS z FROM
(SELECT channel, xor(7::UBIGINT, CAST((channel + 1)::UHUGEINT * {levels.COUNTER_STEP}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)) AS y FROM c))),
d AS (SELECT clip, f.channel, frame, {S} * 32768 + ({_draw_sql(0)} / 9007199254740992.0::DOUBLE - {_draw_sql(1)} / 9007199254740992.0::DOUBLE) AS x FROM frames f JOIN s ON s.channel = f.channel)
SELECT clip, channel, frame, CAST(greatest(-32768.0, least(32767.0, sign(x) * floor(abs(x) + 0.5))) AS BIGINT) AS code FROM d""",
)
def quantize_s16_dither(spark, d):
    return levels.quantize(b.line_frames(spark, d), "s16", 7)


@query(
    "clip_faults",
    f"""WITH {LINE_SQL}, o AS (SELECT clip, CAST(channel + clip % 3 // 2 AS INT) AS channel, CASE WHEN clip % 5 = 0 AND frame = 3 THEN 4 WHEN clip % 7 = 0 THEN frame - 1 ELSE frame END AS frame, CASE WHEN clip % 4 = 0 AND frame = 2 THEN 'nan'::FLOAT ELSE sample END AS sample FROM frames),
k AS (SELECT clip, channel, frame, count(*) AS n, count(*) FILTER (WHERE isnan(sample)) AS odd FROM o GROUP BY 1, 2, 3),
h AS (SELECT clip, channel, sum(odd) AS odd, sum(n - 1) AS twice, count(*) AS places, min(frame) AS a, max(frame) AS e FROM k GROUP BY 1, 2),
c AS (SELECT clip, sum(odd) AS odd, sum(twice) AS twice, min(places) AS places, min(a) AS a, max(e) AS e, count(*) AS channels, max(channel) AS high FROM h GROUP BY 1)
SELECT clip, 'not finite' AS fault FROM c WHERE odd > 0 UNION ALL SELECT clip, 'twice' FROM c WHERE twice > 0 UNION ALL SELECT clip, 'before the start' FROM c WHERE a < 0
UNION ALL SELECT clip, 'frames missing' FROM c WHERE places < e + 1 UNION ALL SELECT clip, 'channels missing' FROM c WHERE channels < high + 1""",
)
def clip_faults(spark, d):
    """What is wrong with clips that were damaged in four ways."""
    c, f = F.col("clip"), F.col("frame")
    odd = b.line_frames(spark, d).select("clip", (F.col("channel") + (c % 3 / 2).cast("int")).cast("int").alias("channel"), F.when((c % 5 == 0) & (f == 3), 4).when(c % 7 == 0, f - 1).otherwise(f).alias("frame"), F.when((c % 4 == 0) & (f == 2), F.lit(float("nan")).cast("float")).otherwise(F.col("sample")).alias("sample"))
    return shape.faults(odd)


_CODE = f"CAST(greatest(-32768.0, least(32767.0, sign({S}) * floor(abs({S}) * 32768.0 + 0.5))) AS INT)"


@query(
    "ulaw",
    f"""WITH {LINE_SQL}, c AS (SELECT clip, channel, frame, {_CODE} AS code FROM frames), m AS (SELECT *, least(abs(code), 32635) + 132 AS m FROM c),
e AS (SELECT *, CASE WHEN m >= 16384 THEN 7 WHEN m >= 8192 THEN 6 WHEN m >= 4096 THEN 5 WHEN m >= 2048 THEN 4 WHEN m >= 1024 THEN 3 WHEN m >= 512 THEN 2 WHEN m >= 256 THEN 1 ELSE 0 END AS x FROM m),
y AS (SELECT *, 255 - ((CASE WHEN code < 0 THEN 128 ELSE 0 END) + x * 16 + ((m >> (x + 3)) & 15)) AS byte, ((((m >> (x + 3)) & 15) * 8 + 132) << x) - 132 AS back FROM e)
SELECT clip, channel, frame, CAST(byte AS INT) AS byte, CAST(CASE WHEN code < 0 THEN -back ELSE back END AS INT) AS decoded FROM y""",
)
def ulaw(spark, d):
    codes = levels.quantize(b.line_frames(spark, d), "s16").withColumn("byte", levels.ulaw_encode(F.col("code")).cast("int"))
    return codes.select("clip", "channel", "frame", "byte", levels.ulaw_decode(F.col("byte")).cast("int").alias("decoded"))


@query(
    "alaw",
    f"""WITH {LINE_SQL}, c AS (SELECT clip, channel, frame, {_CODE} AS code FROM frames), m AS (SELECT *, CASE WHEN code >= 0 THEN code ELSE -code - 1 END AS m FROM c),
e AS (SELECT *, CASE WHEN m >= 16384 THEN 7 WHEN m >= 8192 THEN 6 WHEN m >= 4096 THEN 5 WHEN m >= 2048 THEN 4 WHEN m >= 1024 THEN 3 WHEN m >= 512 THEN 2 WHEN m >= 256 THEN 1 ELSE 0 END AS x FROM m),
y AS (SELECT *, (m >> (greatest(x, 1) + 3)) & 15 AS k FROM e)
SELECT clip, channel, frame, CAST(xor(x * 16 + k, CASE WHEN code >= 0 THEN 213 ELSE 85 END) AS INT) AS byte,
CAST((CASE WHEN code >= 0 THEN 1 ELSE -1 END) * (CASE WHEN x = 0 THEN k * 16 + 8 ELSE (k * 16 + 264) << (x - 1) END) AS INT) AS decoded FROM y""",
)
def alaw(spark, d):
    codes = levels.quantize(b.line_frames(spark, d), "s16").withColumn("byte", levels.alaw_encode(F.col("code")).cast("int"))
    return codes.select("clip", "channel", "frame", "byte", levels.alaw_decode(F.col("byte")).cast("int").alias("decoded"))


# Shape -------------------------------------------------------------------------------------------------------------

_PLAIN = R.format("sample")


def _moved(frame: str, rest: str, base: str = EMB_SQL, channel: str = "channel", more: str = "", value: str = _PLAIN) -> str:
    return f"WITH {base}, {N}{', ' + more if more else ''} SELECT CAST(clip AS BIGINT) AS clip, CAST({channel} AS INT) AS channel, CAST({frame} AS BIGINT) AS frame, {value} {rest}"


@query("cut", _moved("frame - 10", "FROM frames WHERE frame >= 10 AND frame < 44"))
def cut(spark, d):
    return shown(shape.cut(b.emb_frames(spark, d), 0.01, -0.02, b.EMB_RATE))


@query("remove", _moved("CASE WHEN frame >= 44 THEN frame - 34 ELSE frame END", "FROM frames WHERE frame < 10 OR frame >= 44"))
def remove(spark, d):
    return shown(shape.remove(b.emb_frames(spark, d), 0.01, 0.044, b.EMB_RATE))


@query("silence", "SELECT CAST(vec_id AS BIGINT) AS clip, c AS channel, CAST(i AS BIGINT) AS frame, 0.0::DOUBLE AS sample FROM embeddings, (VALUES (0), (1)) t(c), generate_series(0, 7) u(i)")
def silence(spark, d):
    return shown(shape.silence(b.emb_clips(spark, d), 8, 2))


@query("pad", _moved("frame + 4", "FROM frames", more="z AS (SELECT clip, channel, i AS frame FROM (SELECT DISTINCT clip, channel FROM frames), generate_series(0, 3) t(i) UNION ALL SELECT clip, 0, n + 4 + i FROM n, generate_series(0, 5) t(i))") + " UNION ALL SELECT clip, channel, frame, 0.0 FROM z")
def pad(spark, d):
    return shown(shape.pad(b.emb_frames(spark, d), 4, 6))


@query("reverse", _moved("n - 1 - frame", "FROM frames JOIN n USING (clip)", LINE_SQL))
def reverse(spark, d):
    return shown(shape.reverse(b.line_frames(spark, d)))


@query("concat", _moved("frame", "FROM frames UNION ALL SELECT clip, channel, frame + 64, round(CAST(sample AS DOUBLE), 6) + 0.0 FROM frames"))
def concat(spark, d):
    frames = b.emb_frames(spark, d)
    return shown(shape.concat(frames, frames))


#: Both signals of a mix side by side, each frame's values in one group.
_MIX = "u AS (SELECT clip, channel, frame, sample AS x, CAST(NULL AS FLOAT) AS y FROM frames UNION ALL SELECT clip + 1, channel, {frames}, NULL, sample FROM frames WHERE {some})"
_MIXED = "coalesce(max(x), 0) + CAST(coalesce(max(y), 0) * 0.5::FLOAT AS FLOAT)"


@query("mix_offset", f"WITH {EMB_SQL}, {_MIX.format(frames='frame + 20', some='frame + 20 >= 0')} SELECT clip, channel, frame, {R.format(_MIXED)} FROM u GROUP BY 1, 2, 3 HAVING count(x) > 0")
def mix_offset(spark, d):
    frames = b.emb_frames(spark, d)
    return shown(shape.mix(frames, frames.withColumn("clip", F.col("clip") + 1), 20, 0.5, False))


@query("mix_extend", f"WITH {EMB_SQL}, {_MIX.format(frames='frame + 5', some='frame >= 5')} SELECT clip, channel, frame, {R.format(_MIXED)} FROM u GROUP BY 1, 2, 3")
def mix_extend(spark, d):
    frames = b.emb_frames(spark, d)
    late = frames.where("frame >= 5").withColumn("clip", F.col("clip") + 1)
    return shown(shape.mix(frames, late, 5, 0.5, True))


@query(
    "crossfade",
    f"""WITH {EMB_SQL}, {N}, x AS (SELECT clip, channel, frame, {S} AS v, 1 AS side FROM frames UNION ALL SELECT clip, channel, frame + 48, {S}, 2 FROM frames),
y AS (SELECT clip, channel, frame, CASE WHEN count(*) = 1 THEN max(v) ELSE sum(v * CASE WHEN side = 1 THEN cos((frame - 48) / 15.0::DOUBLE / 4 * 6.283185307179586) ELSE sin((frame - 48) / 15.0::DOUBLE / 4 * 6.283185307179586) END) END AS sample FROM x GROUP BY 1, 2, 3)
SELECT clip, channel, frame, {f32_sql('sample')} FROM y""",
)
def crossfade(spark, d):
    frames = b.emb_frames(spark, d)
    return shown(shape.crossfade(frames, frames, 16))


_MONO = "mono AS (SELECT clip, frame, CAST((l + r) / 2.0::FLOAT AS FLOAT) AS sample FROM line)"


@query("to_mono", f"WITH {LINE_SQL}, {_MONO} SELECT clip, 0 AS channel, frame, {_PLAIN} FROM mono")
def to_mono(spark, d):
    return shown(shape.to_mono(b.line_frames(spark, d)))


@query("to_stereo", f"WITH {EMB_SQL} SELECT clip, c AS channel, frame, {_PLAIN} FROM frames, (VALUES (0), (1)) t(c)")
def to_stereo(spark, d):
    return shown(shape.to_channels(b.emb_frames(spark, d), 2))


@query("to_channels_5", f"WITH {LINE_SQL} SELECT clip, CAST(c AS INT) AS channel, frame, {_PLAIN} FROM frames JOIN generate_series(0, 4) t(c) ON c % 2 = channel")
def to_channels_5(spark, d):
    return shown(shape.to_channels(b.line_frames(spark, d), 5))


@query("map_channels", f"WITH {LINE_SQL} SELECT clip, c AS channel, frame, {_PLAIN} FROM frames JOIN (VALUES (0, 1), (1, 1), (2, 0)) t(c, s) ON s = channel")
def map_channels(spark, d):
    return shown(shape.map_channels(b.line_frames(spark, d), [1, 1, 0]))


@query("split", f"WITH {LINE_SQL} SELECT clip, channel AS part, 0 AS channel, frame, {_PLAIN} FROM frames")
def split(spark, d):
    return shape.split(b.line_frames(spark, d)).select("clip", "part", "channel", "frame", rounded(F.col("sample")).alias("sample"))


@query("merge", f"WITH {EMB_SQL}, m AS (SELECT clip, frame, sample, coalesce(lead(sample, 16) OVER (PARTITION BY clip ORDER BY frame), 0) AS later FROM frames), c AS (SELECT clip, frame, unnest([0, 1]) AS channel, unnest([sample, later]) AS sample FROM m) SELECT clip, channel, frame, {R.format('sample')} FROM c")
def merge(spark, d):
    frames = b.emb_frames(spark, d)
    return shown(shape.merge([frames, shape.cut(frames, 0.016, 1.0, b.EMB_RATE)]))


@query("pan", f"WITH {LINE_SQL}, {_MONO} SELECT clip, c AS channel, frame, {f32_sql(S + ' * CASE WHEN c = 0 THEN sin((0.25 - 1.5 / 8) * 6.283185307179586::DOUBLE) ELSE sin(1.5 / 8 * 6.283185307179586::DOUBLE) END')} FROM mono, (VALUES (0), (1)) t(c)")
def pan(spark, d):
    return shown(shape.pan(b.line_frames(spark, d), 0.5))


@query("interleave", f"WITH {LINE_SQL} SELECT clip, frame * 2 + channel AS position, {_PLAIN} FROM frames")
def interleave(spark, d):
    return shape.interleave(b.line_frames(spark, d)).select("clip", F.col("position").cast("bigint").alias("position"), rounded(F.col("sample")).alias("sample"))


@query("deinterleave", f"WITH {LINE_SQL} SELECT clip, channel, frame, {_PLAIN} FROM frames")
def deinterleave(spark, d):
    return shown(shape.deinterleave(shape.interleave(b.line_frames(spark, d)), 2))


_SHARES = ", ".join(f"({c}, {o}, {row[o]!r}::DOUBLE)" for c, row in enumerate(shape.DOWNMIX["5.1"]) for o in (0, 1))


@query("downmix_51", f"WITH {LINE_SQL} SELECT clip, o AS channel, frame, {f32_sql(f'sum({S} * share)')} FROM frames JOIN generate_series(0, 5) t(c) ON c % 2 = channel JOIN (VALUES {_SHARES}) m(k, o, share) ON k = c GROUP BY clip, o, frame")
def downmix_51(spark, d):
    return shown(shape.downmix(shape.to_channels(b.line_frames(spark, d), 6), "5.1"))


@query("block_levels", f"WITH {LINE_SQL} SELECT clip, channel, frame // 256 AS block, count(*) AS frames, round(max(abs({S})), 6) + 0.0 AS peak FROM frames GROUP BY 1, 2, 3")
def block_levels(spark, d):
    blocks = shape.as_blocks(b.line_frames(spark, d), 256)
    return blocks.select("clip", "channel", "block", F.size("samples").cast("bigint").alias("frames"), rounded(F.array_max(F.transform("samples", lambda x: F.abs(f64(x))))).alias("peak"))


@query("durations", f"WITH {LINE_SQL} SELECT clip, printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS duration FROM (SELECT clip, CAST(floor((max(frame) + 1) / 7.0::DOUBLE * 1000 + 0.5) AS BIGINT) AS ms FROM frames GROUP BY clip)")
def durations(spark, d):
    return shape.lengths(b.line_frames(spark, d)).select("clip", format_duration(F.col("frames") / 7.0).alias("duration"))


@query("positions", "SELECT p_partkey AS part, CAST(greatest(0, least(640, CASE WHEN k < 0 THEN 640 + k ELSE k END)) AS BIGINT) AS frame FROM (SELECT p_partkey, CAST(sign(s) * floor(abs(s) * 1000 + 0.5) AS BIGINT) AS k FROM (SELECT p_partkey, (p_size - 25) / 32.0::DOUBLE AS s FROM part))")
def positions(spark, d):
    part = b.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("part"), frame_index((F.col("p_size") - 25) / 32.0, 1000, F.lit(640).cast("bigint")).alias("frame"))


@query("parsed_times", "SELECT p_partkey AS part, CASE p_size % 4 WHEN 0 THEN p_size * 10 / 1000.0::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 2 THEN p_size * 60 + 2.5::DOUBLE ELSE 3600.0::DOUBLE + p_size * 60 + 3 END AS seconds FROM part")
def parsed_times(spark, d):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, F.concat((n * 10).cast("string"), F.lit("ms"))).when(n % 4 == 1, F.concat(n.cast("string"), F.lit(".5s"))).when(n % 4 == 2, F.concat(n.cast("string"), F.lit(":02.5"))).otherwise(F.concat(F.lit("1:"), n.cast("string"), F.lit(":03")))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), parse_time(text).alias("seconds"))


# Filters and spectra -------------------------------------------------------------------------------------------------

for _kind in ("lowpass", "highpass", "bandpass", "notch", "allpass", "peaking", "lowshelf", "highshelf"):
    _c = kernels.biquad_coefficients(_kind, 120.0, b.EMB_RATE, 0.9, 6.0)

    def _filter(spark, d, kind=_kind):
        return shown(dsp.filtered(b.emb_frames(spark, d), kind, 120.0, b.EMB_RATE, 0.9, 6.0))

    _b0, _b1, _b2, _a1, _a2 = (f"({x!r}::DOUBLE)" for x in _c)
    query(
        f"filter_{_kind}",
        f"""WITH RECURSIVE {EMB_SQL}, x AS (SELECT clip, frame, {_b0} * {S} + {_b1} * coalesce(lag({S}, 1) OVER w, 0) + {_b2} * coalesce(lag({S}, 2) OVER w, 0) AS v FROM frames WINDOW w AS (PARTITION BY clip ORDER BY frame)),
y(clip, frame, y1, y2) AS (SELECT clip, -1, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT clip FROM frames)
UNION ALL SELECT y.clip, x.frame, x.v - {_a1} * y1 - {_a2} * y2, y1 FROM y JOIN x ON x.clip = y.clip AND x.frame = y.frame + 1)
SELECT clip, 0 AS channel, CAST(frame AS BIGINT) AS frame, {f32_sql('y1')} FROM y WHERE frame >= 0""",
    )(_filter)


@query(
    "limiter",
    f"""WITH RECURSIVE {EMB_SQL}, p AS (SELECT clip, frame, least(1.0::DOUBLE, pow(10.0::DOUBLE, -12.0 / 20) / max(abs({S})) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS t FROM frames),
g(clip, frame, gain) AS (SELECT clip, -1, 1.0::DOUBLE FROM (SELECT DISTINCT clip FROM frames)
UNION ALL SELECT g.clip, p.frame, CASE WHEN t < gain THEN t ELSE t + (gain - t) * exp(-1.0::DOUBLE / 20) END FROM g JOIN p ON p.clip = g.clip AND p.frame = g.frame + 1)
SELECT f.clip, f.channel, f.frame, {R.format('CAST(f.sample * CAST(gain AS FLOAT) AS FLOAT)')} FROM frames f JOIN g ON g.clip = f.clip AND g.frame = f.frame""",
)
def limiter(spark, d):
    return shown(dsp.limit(b.emb_frames(spark, d), b.EMB_RATE, -12.0, 5.0, 20.0))


def _taps() -> str:
    rows = []
    for i in range(128):
        t, w = i / 4 - 16, i / 127
        sinc = 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
        rows.append(f"({i // 4}, {i % 4}, {sinc * (0.42 - 0.5 * math.cos(2 * math.pi * w) + 0.08 * math.cos(4 * math.pi * w))!r}::DOUBLE)")
    return ", ".join(rows)


@query(
    "true_peak",
    f"""WITH {EMB_SQL}, k(tap, phase, v) AS (VALUES {_taps()}), s AS (SELECT f.clip, g.frame AS i, phase, sum(CAST(f.sample AS DOUBLE) * v) AS x
FROM frames g JOIN k ON true JOIN frames f ON f.clip = g.clip AND f.frame = g.frame + tap - 16 GROUP BY 1, 2, 3),
t AS (SELECT clip, greatest(max(abs(x)), (SELECT max(abs({S})) FROM frames q WHERE q.clip = s.clip)) AS p FROM s GROUP BY clip)
SELECT clip, round(p, 6) + 0.0 AS true_peak, round(20 * log10(p), 6) + 0.0 AS true_peak_db FROM t""",
)
def true_peak(spark, d):
    return measure.true_peak(b.emb_frames(spark, d)).select("clip", rounded(F.col("true_peak")).alias("true_peak"), rounded(F.col("true_peak_db")).alias("true_peak_db"))


def _between_sql(frames: str, name: str) -> str:
    """``name`` (clip, p): the largest magnitude of mono clips at and between samples, by fourfold interpolation."""
    return f"""{name}_s AS (SELECT f.clip, g.frame AS i, phase, sum(CAST(f.sample AS DOUBLE) * v) AS x FROM {frames} g JOIN k4 ON true JOIN {frames} f ON f.clip = g.clip AND f.frame = g.frame + tap - 16 GROUP BY 1, 2, 3),
{name} AS (SELECT clip, max(p) AS p FROM (SELECT clip, max(abs(x)) AS p FROM {name}_s GROUP BY 1 UNION ALL SELECT clip, max(abs({S})) FROM {frames} GROUP BY 1) GROUP BY 1)"""


@query(
    "normalize_true_peak",
    f"""WITH {EMB_SQL}, k4(tap, phase, v) AS (VALUES {_taps()}), {_between_sql('frames', 't')}, g AS (SELECT clip, 20 * log10(p) AS measured FROM t)
SELECT f.clip, frame, round(measured, 6) + 0.0 AS measured, round(-2.0 - measured, 6) + 0.0 AS gain_db, false AS limited_by_peak, {f32_sql(f'{S} * pow(10.0::DOUBLE, (-2.0 - measured) / 20)')} FROM frames f JOIN g ON g.clip = f.clip""",
)
def normalize_true_peak(spark, d):
    frames, report = levels.normalize(b.emb_frames(spark, d), -2.0, "true_peak", b.EMB_RATE)
    out = frames.select("clip", "frame", "sample").join(report, "clip")
    return out.select("clip", "frame", rounded(F.col("measured")).alias("measured"), rounded(F.col("gain_db")).alias("gain_db"), "limited_by_peak", rounded(F.col("sample")).alias("sample"))


def _fine_sql(frames: str, name: str) -> str:
    """``name`` (clip, frame, peak) of mono clips of 64 samples: magnitudes up to the next sample by eightfold reconstruction,
    what rings before and behind a clip with its first and last samples."""
    zeros = lambda n: f"list_resize([0.0::DOUBLE], {n}, 0.0::DOUBLE)"
    return f"""{name}_l AS MATERIALIZED (SELECT clip, list_concat(list_concat({zeros(63)}, list({S} ORDER BY frame)), {zeros(64)}) AS s FROM {frames} GROUP BY clip),
{name}_s AS (SELECT clip, place, abs(list_inner_product(s[place + 33 : place + 96], w)) AS peak FROM {name}_l, generate_series(-32, 95) t(place), k8),
{name} AS MATERIALIZED (SELECT clip, frame, max(peak) AS peak FROM (SELECT clip, greatest(0, least(63, place)) AS frame, peak FROM {name}_s UNION ALL SELECT clip, frame, abs({S}) FROM {frames}) GROUP BY 1, 2)"""


def _fine_taps() -> str:
    rows = []
    for j in range(1, 8):
        times = [i - 31 - j / 8 for i in range(64)]
        w = [math.sin(math.pi * t) / (math.pi * t) * (0.42 + 0.5 * math.cos(2 * math.pi * t / 64) + 0.08 * math.cos(2 * math.pi * t / 32)) for t in times]
        rows.append(f"([{', '.join(f'{x / sum(w)!r}::DOUBLE' for x in w)}])")
    return ", ".join(rows)


_HELD = f"{10 ** (-12.3 / 20) * (1 - 8 * 2.0**-23)!r}::DOUBLE"
_LIMITED = f"""WITH RECURSIVE {EMB_SQL}, k4(tap, phase, v) AS MATERIALIZED (VALUES {_taps()}), k8(w) AS MATERIALIZED (VALUES {_fine_taps()}), {_fine_sql('frames', 'a')},
p AS (SELECT clip, frame, least(1.0::DOUBLE, {_HELD} / max(peak) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS t FROM a),
g(clip, frame, gain) AS (SELECT clip, -1, 1.0::DOUBLE FROM (SELECT DISTINCT clip FROM frames)
UNION ALL SELECT g.clip, p.frame, CASE WHEN t < gain THEN t ELSE t + (gain - t) * exp(-1.0::DOUBLE / 50) END FROM g JOIN p ON p.clip = g.clip AND p.frame = g.frame + 1),
o AS MATERIALIZED (SELECT f.clip, f.frame, CAST({S} * gain AS FLOAT) AS sample FROM frames f JOIN g ON g.clip = f.clip AND g.frame = f.frame), {_fine_sql('o', 'c')}, {_between_sql('o', 't')},
m AS (SELECT clip, least(1.0::DOUBLE, {_HELD} / max(p)) AS q FROM (SELECT clip, peak AS p FROM c UNION ALL SELECT clip, p FROM t) GROUP BY 1)
SELECT o.clip, 0 AS channel, o.frame, {f32_sql(f'{S} * q')} FROM o JOIN m ON m.clip = o.clip"""
_W = "(0.5 - 0.5 * cos(6.283185307179586::DOUBLE * i / 15))"


def _spectral(hop: int, cols: str) -> str:
    return f"""WITH {EMB_SQL}, c AS (SELECT clip, channel, frame, {S} AS x, col, frame - col * {hop} AS i FROM frames JOIN generate_series(0, {cols}) t(col) ON frame >= col * {hop} AND frame < col * {hop} + 16),
m AS (SELECT clip, channel, col, bin, sqrt(pow(sum(x * {_W} * cos(6.283185307179586::DOUBLE * bin * i / 16)), 2) + pow(sum(x * {_W} * sin(6.283185307179586::DOUBLE * bin * i / 16)), 2)) AS a FROM c, generate_series(0, 8) u(bin) GROUP BY 1, 2, 3, 4)
SELECT clip, channel, CAST(col AS BIGINT) AS col, CAST(bin AS INT) AS bin, bin * 62.5::DOUBLE AS hz, round(a / (SELECT sum({_W}) FROM generate_series(0, 15) v(i)) * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END, 6) + 0.0 AS magnitude FROM m"""


@query("spectrogram_16_8", _spectral(8, "7"))
def spectrogram(spark, d):
    out = dsp.spectrogram(b.emb_frames(spark, d), b.EMB_RATE, 16, 8)
    return out.select("clip", "channel", F.col("col").cast("bigint").alias("col"), "bin", "hz", rounded(F.col("magnitude")).alias("magnitude"))


@query("spectrum_16", _spectral(16, "0").replace("CAST(col AS BIGINT) AS col, ", ""))
def spectrum(spark, d):
    return dsp.spectrum(b.emb_frames(spark, d), b.EMB_RATE, 16).select("clip", "channel", "bin", "hz", rounded(F.col("magnitude")).alias("magnitude"))


def _named(name: str, run, sql: str | None = None):
    query(name, sql)(lambda spark, d: shown(run(spark, d)))


def _resample_weights(num: int, den: int) -> str:
    """(phase, tap, weight) of resampling by den / num, where places between samples repeat after ``den``: a sinc under a
    Kaiser window of beta 10, read from a table with steps of 1/512 by straight lines, cut at 97 % of the lower rate, weights
    made to sum to 1."""
    import numpy as np

    d, cut = np.arange(16385) / 512, 0.97 * min(1.0, den / num)
    table = np.sinc(d) * np.i0(10 * np.sqrt(np.maximum(0, 1 - (d / 32) ** 2))) / np.i0(10.0)
    rows = []
    for phase in range(den):
        taps = np.arange(-50, 51)
        at = np.abs(phase * num % den / den - taps) * cut * 512
        w = np.where(at <= 16384, np.interp(at, np.arange(16385), table), 0)
        rows += [f"({phase}, {t}, {x!r}::DOUBLE)" for t, x in zip(taps.tolist(), (w / w.sum()).tolist()) if x]
    return ", ".join(rows)


def _resample_sql(num: int, den: int) -> str:
    made = (64 * den * 2 + num) // (2 * num)
    return f"""WITH {EMB_SQL}, w(phase, tap, v) AS (VALUES {_resample_weights(num, den)}), i AS (SELECT i, i % {den} AS phase, i * {num} // {den} AS base FROM generate_series(0, {made - 1}) t(i))
SELECT clip, 0 AS channel, CAST(i AS BIGINT) AS frame, round(CAST(CAST(sum({S} * v) AS FLOAT) AS DOUBLE), 6) + 0.0 AS sample
FROM i JOIN w USING (phase) JOIN frames f ON f.frame = greatest(0, least(63, base + tap)) GROUP BY clip, i"""


_named("resample_3_2", lambda s, d: dsp.resample(b.emb_frames(s, d), 1000, 1500), _resample_sql(2, 3))
_named("speed", lambda s, d: dsp.speed(b.emb_frames(s, d), 1.25), _resample_sql(5, 4))
_named("tempo", lambda s, d: dsp.tempo(b.line_frames(s, d), 0.8, 4000, b.line_tasks(s, d)))
_named("pitch", lambda s, d: dsp.pitch(b.line_frames(s, d), 3.0, 4000, b.line_tasks(s, d)))
_named(
    "compressor",
    lambda s, d: dsp.compress(b.line_frames(s, d), b.line_frames(s, d), 48_000, -12.0, 4.0, 1.0, 20.0),
    f"""WITH RECURSIVE {LINE_SQL}, p AS MATERIALIZED (SELECT clip, frame, greatest(abs(CAST(l AS DOUBLE)), abs(CAST(r AS DOUBLE))) AS x FROM line),
t AS MATERIALIZED (SELECT clip, frame, CASE WHEN x > pow(10.0::DOUBLE, -0.6) THEN pow(pow(10.0::DOUBLE, -0.6) / x, 0.75) ELSE 1.0::DOUBLE END AS t FROM p),
g(clip, frame, gain) AS (SELECT clip, -1, 1.0::DOUBLE FROM (SELECT DISTINCT clip FROM line)
UNION ALL SELECT g.clip, t.frame, t + (gain - t) * CASE WHEN t < gain THEN exp(-1000.0::DOUBLE / 48000) ELSE exp(-1000.0::DOUBLE / (20 * 48000)) END FROM g JOIN t ON t.clip = g.clip AND t.frame = g.frame + 1)
SELECT f.clip, f.channel, f.frame, {f32_sql(f'{S} * gain')} FROM frames f JOIN g ON g.clip = f.clip AND g.frame = f.frame""",
)
_named("limit_true_peak", lambda s, d: dsp.limit_true_peak(b.emb_frames(s, d), b.EMB_RATE, -12.0), _LIMITED)
_G = math.tan(math.pi * 2000 / 48_000)
_ONE_POLE = f"""WITH RECURSIVE {LINE_SQL}, y(clip, channel, frame, v, low, m) AS (SELECT clip, channel, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT clip, channel FROM frames)
UNION ALL SELECT y.clip, y.channel, f.frame, {S}, ({S} - m) * {_G / (1 + _G)!r}::DOUBLE + m, 2 * ({S} - m) * {_G / (1 + _G)!r}::DOUBLE + m FROM y JOIN frames f ON f.clip = y.clip AND f.channel = y.channel AND f.frame = y.frame + 1)
SELECT clip, channel, CAST(frame AS BIGINT) AS frame, {f32_sql('{0}')} FROM y WHERE frame >= 0"""
#: The echo of 1 ms reaches back 48 frames exactly; each further one is weaker by the feedback.
_ECHO = f"""WITH {LINE_SQL}, e AS (SELECT f.clip, f.channel, f.frame, sum(CAST(p.sample AS DOUBLE) * pow(0.4::DOUBLE, k - 1)) AS heard FROM frames f JOIN generate_series(1, 60) t(k) ON f.frame >= 48 * k JOIN frames p ON p.clip = f.clip AND p.channel = f.channel AND p.frame = f.frame - 48 * k GROUP BY 1, 2, 3)
SELECT f.clip, f.channel, f.frame, {f32_sql('CAST(f.sample AS DOUBLE) * 0.5 + coalesce(heard, 0) * 0.5')} FROM frames f LEFT JOIN e ON e.clip = f.clip AND e.channel = f.channel AND e.frame = f.frame"""
#: Six bits, held for four frames.
_CRUSHED = f"""WITH {LINE_SQL}, h AS (SELECT clip, channel, frame, CASE frame % 4 WHEN 0 THEN sample WHEN 1 THEN lag(sample, 1) OVER w WHEN 2 THEN lag(sample, 2) OVER w ELSE lag(sample, 3) OVER w END AS held FROM frames WINDOW w AS (PARTITION BY clip, channel ORDER BY frame))
SELECT clip, channel, frame, {f32_sql("greatest(-32.0, least(31.0, sign(held) * floor(abs(greatest(-1.0, least(1.0, CAST(held AS DOUBLE)))) * 32 + 0.5))) / 32")} FROM h"""
for _name, _settings, _sql in (
    ("lowpass", {"hz": 2000.0}, _ONE_POLE.replace("{0}", "low")),
    ("highpass", {"hz": 2000.0}, _ONE_POLE.replace("{0}", "v - low")),
    ("delay", {"seconds": 0.001, "feedback": 0.4, "wet": 0.5}, _ECHO),
    ("reverb", {"decay_s": 1.0, "damping": 0.3, "wet": 0.3}, None),
    ("chorus", {"delay_ms": 3.0, "depth_ms": 1.0, "hz": 2.0, "feedback": 0.2, "stereo_phase": 0.5, "wet": 0.5}, None),
    ("flanger", {"delay_ms": 2.0, "depth_ms": 1.0, "hz": 1.0, "feedback": 0.5, "wet": 0.5}, None),
    ("phaser", {"centre_hz": 1000.0, "depth": 1.0, "hz": 2.0, "feedback": 0.3, "stereo_phase": 0.5, "wet": 0.5}, None),
    ("bitcrusher", {"bits": 6.0, "ratio": 0.25}, _CRUSHED),
):
    _named(f"effect_{_name}", lambda s, d, n=_name, k=_settings: dsp.effect(b.line_frames(s, d), n, b.LINE_RATE, b.line_tasks(s, d), **k), _sql)


@query("loudness")
def loudness(spark, d):
    """Loudness of long programmes: the lines of all suppliers one after the other, four clips at 4 kHz."""
    line = b.line_stereo(spark, d)
    before = F.sum("n").over(Window.partitionBy("group").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1))
    place = line.groupBy("clip", (F.col("clip") % 4).alias("group")).agg(F.count(F.lit(1)).alias("n")).select("clip", "group", F.coalesce(before, F.lit(0)).alias("before"))
    frames = line.join(place, "clip").select(F.col("group").alias("clip"), (F.col("frame") + F.col("before")).alias("frame"), F.posexplode(F.array("l", "r")).alias("channel", "sample"))
    return measure.loudness(frames, 4000).select("clip", *(rounded(F.col(c), 4).alias(c) for c in ("lufs", "range_lu", "momentary")))


# Reports beyond single clips -------------------------------------------------------------------------------------------


@query("level_rollup", f"WITH {LINE_SQL} SELECT clip, channel, round(avg({S} * {S}), 6) + 0.0 AS mean_square, count(*) AS samples FROM frames GROUP BY ROLLUP (clip, channel)")
def level_rollup(spark, d):
    x = f64(F.col("sample"))
    return b.line_frames(spark, d).rollup("clip", "channel").agg(rounded(F.avg(x * x)).alias("mean_square"), F.count(F.lit(1)).alias("samples"))


@query("level_cube", f"WITH {LINE_SQL} SELECT clip % 5 AS family, channel, round(max(abs({S})), 6) + 0.0 AS peak FROM frames GROUP BY CUBE (clip % 5, channel)")
def level_cube(spark, d):
    frames = b.line_frames(spark, d).withColumn("family", F.col("clip") % 5)
    return frames.cube("family", "channel").agg(rounded(F.max(F.abs(f64(F.col("sample"))))).alias("peak"))
