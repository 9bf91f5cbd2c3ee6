"""Queries over notes, events and texts: tempo, controls, choice and admission, space, routing, generators, containers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks, units
from ..functions.units import f64, rounded
from ..operators import levels, measure, mixing, shape, synth, timeline, voice
from ..sources import bindings as b
from ..sources import containers, files
from ..sources.bindings import EMB_SQL, LINE_SQL, NOTE_SQL, TRIGGER_SQL
from .signal_queries import N, S, f32_sql, shown

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# Notes and tempo -----------------------------------------------------------------------------------------------------

RATE, TPQ = 48_000, 48
TEMPOS = [(0, 120_000), (4000, 97_500), (9000, 151_250), (15_000, 80_000)]


@query(
    "note_frames",
    f"""WITH {NOTE_SQL}, t AS (SELECT *, start * 2880000 // 5760 AS a, (start + length) * 2880000 // 5760 AS e FROM notes)
SELECT note, track, a AS "on", a + (e - a) * gate // 8 AS "off", {r6('volume / 15.0::DOUBLE * (velocity / 127.0::DOUBLE)')} AS amplitude, (midi - 69) * 100 AS cents FROM t""",
)
def note_frames(spark, d):
    out = timeline.note_frames(b.notes(spark, d), RATE, 120, TPQ)
    return out.withColumn("amplitude", rounded(F.col("amplitude")))


_BEFORE, _sum = [], 0.0
_T = ", ".join(f"({t}, {m})" for t, m in TEMPOS)


@query(
    "tempo_map",
    f"""WITH {NOTE_SQL}, c(tick, m) AS (VALUES {_T}), g AS (SELECT tick, m, tick - lag(tick, 1, 0) OVER (ORDER BY tick) AS span, coalesce(lag(m) OVER (ORDER BY tick), m) AS pm FROM c),
f AS (SELECT tick, m, sum(span * 48000.0::DOUBLE * 60000 / (pm * 48.0::DOUBLE)) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS before FROM g)
SELECT note, start, CAST(floor(before + (start - tick) * 48000.0::DOUBLE * 60000 / (m * 48.0::DOUBLE) + 0.5) AS BIGINT) AS start_frame FROM notes ASOF JOIN f ON notes.start >= f.tick""",
)
def tempo_map(spark, d):
    tempos = timeline.tempo_map(spark.createDataFrame(TEMPOS, "tick bigint, milli_bpm int"), RATE, TPQ)
    return timeline.ticks_to_frames(b.notes(spark, d).select("note", "start"), "start", tempos, RATE, TPQ).select("note", "start", "start_frame")


@query(
    "beat_clock",
    f"""WITH {NOTE_SQL}, c(tick, m) AS (VALUES {_T}), g AS (SELECT tick, m, tick - lag(tick, 1, 0) OVER (ORDER BY tick) AS span, coalesce(lag(m) OVER (ORDER BY tick), m) AS pm FROM c),
f AS (SELECT tick, m, CAST(floor(sum(span * 48000.0::DOUBLE * 60000 / (pm * 48.0::DOUBLE)) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) + 0.5) AS BIGINT) AS fr FROM g),
h AS (SELECT tick, m, fr, sum((fr - coalesce(lag_fr, 0)) * coalesce(lag_m, 0)) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS parts FROM (SELECT *, lag(fr) OVER (ORDER BY tick) AS lag_fr, lag(m) OVER (ORDER BY tick) AS lag_m FROM f)),
x AS (SELECT note, start * 711 AS frame FROM notes), y AS (SELECT note, frame, CAST(parts AS BIGINT) + (frame - fr) * m AS parts FROM x ASOF JOIN h ON x.frame >= h.fr)
SELECT note, frame, parts, parts // 2880000000 AS beat, parts % 2880000000 * 48 // 2880000000 AS tick FROM y""",
)
def beat_clock(spark, d):
    """The exact beat, and the tick in it, of a frame for each note."""
    tempos = timeline.tempo_map(spark.createDataFrame(TEMPOS, "tick bigint, milli_bpm int"), RATE, TPQ)
    rows = b.notes(spark, d).select("note", (F.col("start") * 711).alias("frame"))
    parts, whole = F.col("frame_beats").cast("bigint"), F.lit(RATE * 60_000).cast("bigint")
    out = timeline.beat_clock(rows, "frame", tempos, RATE)
    return out.select("note", "frame", parts.alias("parts"), F.floor(parts / whole).cast("bigint").alias("beat"), F.floor(parts % whole * TPQ / whole).cast("bigint").alias("tick"))


@query("note_hertz", f"WITH {NOTE_SQL} SELECT note, {r6('440 * pow(2.0::DOUBLE, (midi - 69) / 12.0::DOUBLE)')} AS hz, CAST(greatest(0, least(2047, floor(1789773 / (16 * 440 * pow(2.0::DOUBLE, (midi - 69) / 12.0::DOUBLE)) - 1 + 0.5))) AS INT) AS timer FROM notes")
def note_hertz(spark, d):
    hz = units.midi_to_hz(F.col("midi"))
    return b.notes(spark, d).select("note", rounded(hz).alias("hz"), synth.timer(hz).alias("timer"))


@query("note_names", f"WITH {NOTE_SQL} SELECT note, midi FROM notes")
def note_names(spark, d):
    names = F.lit(["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"])
    name = F.concat(F.element_at(names, F.col("midi") % 12 + 1), (F.floor(F.col("midi") / 12) - 1).cast("string"))
    return b.notes(spark, d).select("note", units.note_to_midi(name).cast("int").alias("midi"))


@query(
    "control_lanes",
    f"""WITH {TRIGGER_SQL}, r AS (SELECT seq, key % 5 AS instrument, key AS note, frame FROM triggers),
i AS (SELECT key % 5 AS instrument, frame, max(gain) AS v FROM triggers WHERE seq % 7 = 0 GROUP BY 1, 2), o AS (SELECT key AS note, frame, max(gain) AS v FROM triggers WHERE seq % 11 = 0 GROUP BY 1, 2),
a AS (SELECT r.*, o.v AS own FROM r ASOF LEFT JOIN o ON r.note = o.note AND r.frame >= o.frame)
SELECT a.seq, a.instrument, a.note, a.frame, {r6('coalesce(own, i.v)')} AS value FROM a ASOF LEFT JOIN i ON a.instrument = i.instrument AND a.frame >= i.frame""",
)
def control_lanes(spark, d):
    t = b.triggers(spark, d)
    rows = t.select("seq", (F.col("key") % 5).alias("instrument"), F.col("key").alias("note"), "frame")
    instrument = t.where("seq % 7 = 0").groupBy((F.col("key") % 5).alias("instrument"), "frame").agg(F.max("gain").alias("value"))
    own = t.where("seq % 11 = 0").groupBy((F.col("key") % 5).alias("instrument"), F.col("key").alias("note"), "frame").agg(F.max("gain").alias("value"))
    return timeline.lanes(rows, own, instrument).select("seq", "instrument", "note", "frame", rounded(F.col("value")).alias("value"))


@query(
    "ramp_values",
    f"""WITH {TRIGGER_SQL}, t AS (SELECT seq, frame % 1000 AS f, gain / 500 AS a, (key % 10) / 10.0::DOUBLE AS z FROM triggers),
u AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (f - 100) / 800.0::DOUBLE)) AS t FROM t)
SELECT seq, {r6('CASE WHEN f >= 900 THEN z WHEN z >= a THEN a + (z - a) * t * t ELSE z + abs(z - a) * (1 - t) * (1 - t) END')} AS value FROM u""",
)
def ramp_values(spark, d):
    frame = F.col("frame") % 1000
    value = timeline.ramp_value(frame, F.lit(100).cast("bigint"), F.lit(800).cast("bigint"), F.col("gain") / 500, (F.col("key") % 10) / 10.0, "exponential")
    return b.triggers(spark, d).select("seq", rounded(value).alias("value"))


@query("macro_values", f"WITH {TRIGGER_SQL}, s AS (SELECT seq, frame % 5000 * 60 // 1000 AS s FROM triggers) SELECT seq, least(s, 5) AS held, CASE WHEN s < 6 THEN s ELSE 2 + (s - 2) % 4 END AS looped FROM s")
def macro_values(spark, d):
    age = F.col("frame") % 5000
    return b.triggers(spark, d).select("seq", timeline.macro_index(age, 60, 1000, 6, None).alias("held"), timeline.macro_index(age, 60, 1000, 6, 2).alias("looped"))


@query("lfo_values", f"WITH {TRIGGER_SQL} SELECT seq, {r6('sin(frame * 3700 % 48000000 / 48000000.0::DOUBLE * 6.283185307179586)')} AS value FROM (SELECT seq, frame % 1000000 AS frame FROM triggers)")
def lfo_values(spark, d):
    return b.triggers(spark, d).select("seq", rounded(timeline.lfo(F.col("frame") % 1_000_000, 3700, 48_000)).alias("value"))


_K = "(f - 700) * 390000 // 11520000000"
_AT = "700 + (2 * (k + {0}) * 11520000000 * {1} + 390000) // 780000"


@query(
    "music_boundaries",
    f"""WITH {TRIGGER_SQL}, t AS (SELECT seq, frame % 3000000 AS f FROM triggers),
b AS (SELECT seq, f, (f - 700) * 390000 // 11520000000 AS k, (f - 700) * 390000 // 34560000000 AS kb FROM t),
g AS (SELECT seq, f, 700 + (2 * k * 11520000000 + 390000) // 780000 AS b0, 700 + (2 * (k + 1) * 11520000000 + 390000) // 780000 AS b1, 700 + (2 * (k + 2) * 11520000000 + 390000) // 780000 AS b2,
700 + (2 * kb * 34560000000 + 390000) // 780000 AS c0, 700 + (2 * (kb + 1) * 34560000000 + 390000) // 780000 AS c1, 700 + (2 * (kb + 2) * 34560000000 + 390000) // 780000 AS c2 FROM b)
SELECT seq, CAST(CASE WHEN f < 700 THEN 700 WHEN b0 > f THEN b0 WHEN b1 > f THEN b1 ELSE b2 END AS BIGINT) AS beat, CAST(CASE WHEN f < 700 THEN 700 WHEN c0 > f THEN c0 WHEN c1 > f THEN c1 ELSE c2 END AS BIGINT) AS bar FROM g""",
)
def music_boundaries(spark, d):
    f = F.col("frame") % 3_000_000
    return b.triggers(spark, d).select("seq", timeline.boundary_after(f, 700, 48_000, 97_500, 3, 4, False).alias("beat"), timeline.boundary_after(f, 700, 48_000, 97_500, 3, 4, True).alias("bar"))


# Events and voices ---------------------------------------------------------------------------------------------------


@query("sequence_choice", f"WITH {TRIGGER_SQL} SELECT seq, name, CAST((row_number() OVER (PARTITION BY name ORDER BY frame, seq) - 1) % 3 AS INT) AS choice FROM triggers")
def sequence_choice(spark, d):
    return mixing.sequence_choice(b.triggers(spark, d), 3).select("seq", "name", F.col("choice").cast("int").alias("choice"))


def _draw_sql(name: str, number: str, what: str = "") -> str:
    return f"CAST(CAST('0x' || substr(md5({name} || ':{what}:' || CAST({number} AS VARCHAR)), 1, 13) AS BIGINT) AS BIGINT)"


@query("random_choice", f"WITH {TRIGGER_SQL}, n AS (SELECT seq, name, row_number() OVER (PARTITION BY name ORDER BY frame, seq) AS n FROM triggers) SELECT seq, name, CAST({_draw_sql('name', 'n')} % 5 AS INT) AS choice FROM n")
def random_choice(spark, d):
    return mixing.random_choice(b.triggers(spark, d), 5).select("seq", "name", "choice")


@query(
    "shuffled_choice",
    f"""WITH {TRIGGER_SQL}, n AS (SELECT seq, name, row_number() OVER (PARTITION BY name ORDER BY frame, seq) - 1 AS n FROM triggers),
d AS (SELECT name, n // 5 AS cycle, i, row_number() OVER (PARTITION BY name, n // 5 ORDER BY {_draw_sql('name', 'n // 5 * 5 + i')}, i) - 1 AS place FROM (SELECT DISTINCT name, n // 5 * 5 AS n FROM n), generate_series(0, 4) t(i)),
o AS (SELECT name, cycle, list(i ORDER BY place) AS o FROM d GROUP BY 1, 2),
e AS (SELECT name, cycle, o, coalesce(o[1] = lag(o[5]) OVER (PARTITION BY name ORDER BY cycle), false) AS twice, CAST(1 + {_draw_sql('name', 'cycle', 'edge')} % 3 AS INT) AS other FROM o)
SELECT seq, n.name, CAST(o[1 + CASE WHEN twice AND n % 5 = 0 THEN other WHEN twice AND n % 5 = other THEN 0 ELSE n % 5 END] AS INT) AS choice FROM n JOIN e ON e.name = n.name AND e.cycle = n.n // 5""",
)
def shuffled_choice(spark, d):
    return mixing.shuffled_choice(b.triggers(spark, d), 5).select("seq", "name", "choice")


@query(
    "retargeted_ramps",
    f"""WITH RECURSIVE {TRIGGER_SQL}, c AS (SELECT seq, key, frame, gain AS value, seq % 4 * 40000000 AS length, row_number() OVER (PARTITION BY key ORDER BY frame, seq) AS i FROM triggers),
o(key, i, seq, frame, value, length, origin) AS (SELECT key, i, seq, frame, value, length, 1.0::DOUBLE FROM c WHERE i = 1
UNION ALL SELECT c.key, c.i, c.seq, c.frame, c.value, c.length, o.origin + (o.value - o.origin) * CASE WHEN o.length > 0 THEN least(1.0::DOUBLE, (c.frame - o.frame) / o.length::DOUBLE) ELSE 1.0 END FROM o JOIN c ON c.key = o.key AND c.i = o.i + 1)
SELECT seq, key, {r6('origin')} AS origin FROM o""",
)
def retargeted_ramps(spark, d):
    """Where the gain of each user's sound stands when it is sent to another value."""
    t = b.triggers(spark, d)
    changes = t.select("seq", "key", "frame", F.col("gain").alias("value"), (F.col("seq") % 4 * 40_000_000).alias("length"))
    return mixing.retargeted_ramps(changes, "key").select("seq", "key", rounded(F.col("origin")).alias("origin"))


@query(
    "min_gap",
    f"""WITH RECURSIVE {TRIGGER_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY frame, seq) AS i FROM triggers),
g(key, i, seq, last, started) AS (SELECT key, i, seq, frame, true FROM o WHERE i = 1
UNION ALL SELECT o.key, o.i, o.seq, CASE WHEN o.frame - g.last >= 60000000 THEN o.frame ELSE g.last END, o.frame - g.last >= 60000000 FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)
SELECT seq, key, started FROM g""",
)
def min_gap(spark, d):
    return mixing.min_gap(b.triggers(spark, d), 60_000_000, "key").select("seq", "key", "started")


@query(
    "instance_limit",
    f"""WITH RECURSIVE {TRIGGER_SQL}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY frame, seq) AS i FROM triggers),
g(name, i, seq, ends, admitted) AS (SELECT name, i, seq, [frame + 40000000], true FROM o WHERE i = 1
UNION ALL SELECT o.name, o.i, o.seq, CASE WHEN len(list_filter(g.ends, lambda e: e > o.frame)) < 4 THEN list_append(list_filter(g.ends, lambda e: e > o.frame), o.frame + 40000000) ELSE list_filter(g.ends, lambda e: e > o.frame) END,
len(list_filter(g.ends, lambda e: e > o.frame)) < 4 FROM g JOIN o ON o.name = g.name AND o.i = g.i + 1)
SELECT seq, name, admitted FROM g""",
)
def instance_limit(spark, d):
    return mixing.admitted(b.triggers(spark, d), 40_000_000, 4, "name").select("seq", "name", "admitted")


_VOICES = f"{TRIGGER_SQL}, v AS (SELECT frame // 100000000 AS quantum, seq AS voice, key % 4 AS priority, gain AS level, frame AS start FROM triggers)"


def _voices(spark, d):
    return b.triggers(spark, d).select(F.floor(F.col("frame") / 100_000_000).cast("bigint").alias("quantum"), F.col("seq").alias("voice"), (F.col("key") % 4).alias("priority"), F.col("gain").alias("level"), F.col("frame").alias("start"))


@query("physical_voices", f"WITH {_VOICES} SELECT quantum, voice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY quantum ORDER BY priority DESC, level DESC, start, voice) AS rank FROM v) WHERE rank <= 8")
def physical_voices(spark, d):
    return mixing.physical_voices(_voices(spark, d), 8).select("quantum", "voice", F.col("rank").cast("int").alias("rank"))


@query("steal_victims", f"WITH {_VOICES} SELECT quantum, voice FROM (SELECT *, row_number() OVER (PARTITION BY quantum ORDER BY priority, start, voice) AS r FROM v) WHERE r = 1")
def steal_victims(spark, d):
    return mixing.steal_victim(_voices(spark, d))


# Space ---------------------------------------------------------------------------------------------------------------


@query(
    "place_2d",
    f"""WITH {TRIGGER_SQL}, p AS (SELECT seq, CAST(key % 21 - 10 AS DOUBLE) AS x, gain / 50 AS y FROM triggers), q AS (SELECT *, sqrt(x * x + y * y) AS d FROM p)
SELECT seq, {r6('greatest(-1.0, least(1.0, x / 8.0::DOUBLE))')} AS pan, {r6('CASE WHEN d <= 2 THEN 1.0 WHEN d >= 9 THEN 0.0 ELSE 1 - (d - 2) / 7.0::DOUBLE END')} AS linear, {r6('CASE WHEN d <= 2 THEN 1.0 WHEN d >= 9 THEN 0.0 ELSE (2 / d - 2.0::DOUBLE / 9) / (1 - 2.0::DOUBLE / 9) END')} AS inverse FROM q""",
)
def place_2d(spark, d):
    x, y = (F.col("key") % 21 - 10).cast("double"), F.col("gain") / 50
    (pan, linear), (_, inverse) = (mixing.place_2d(x, y, 8.0, 2.0, 9.0, m) for m in ("linear", "inverse"))
    return b.triggers(spark, d).select("seq", rounded(pan).alias("pan"), rounded(linear).alias("linear"), rounded(inverse).alias("inverse"))


@query(
    "attenuation",
    f"""WITH {TRIGGER_SQL}, q AS (SELECT seq, greatest(1.0, least(100.0, gain / 3)) AS d FROM triggers)
SELECT seq, {r6('greatest(0.0, least(1.0, 1 - 0.8::DOUBLE * (d - 1) / 99))')} AS linear, {r6('1 / (1 + 0.8::DOUBLE * (d - 1))')} AS inverse, {r6('pow(d, -0.8::DOUBLE)')} AS exponential FROM q""",
)
def attenuation(spark, d):
    kinds = ("linear", "inverse", "exponential")
    return b.triggers(spark, d).select("seq", *(rounded(mixing.attenuation(F.col("gain") / 3, 1.0, 100.0, 0.8, m)).alias(m) for m in kinds))


@query(
    "place_3d",
    f"""WITH {TRIGGER_SQL}, e AS (SELECT seq, key % 31 - 15.5::DOUBLE AS x, gain / 100 AS y, key % 17 - 8.5::DOUBLE AS z, gain / 10 AS vx FROM triggers),
g AS (SELECT *, sqrt((x - 1) * (x - 1) + y * y + (z - 2) * (z - 2)) AS d, sqrt((x - 1) * (x - 1) + (z - 2) * (z - 2)) AS flat FROM e),
h AS (SELECT *, (x - 1) / flat AS s, 1 / (1 + 1.0::DOUBLE * (greatest(1.0, least(50.0, d)) - 1)) AS gain, (x - 1) * 3 / d AS lv, (x - 1) * vx / d AS v FROM g)
SELECT seq AS voice, {r6('d')} AS distance, {r6('gain')} AS gain, {r6('gain * sin((0.25 - (s + 1) / 8) * 6.283185307179586)')} AS "left", {r6('gain * sin((s + 1) / 8 * 6.283185307179586)')} AS "right",
{r6('greatest(0.25, least(4.0, (343.3::DOUBLE + greatest(-308.97, least(308.97, lv))) / (343.3::DOUBLE + greatest(-308.97, least(308.97, v)))))')} AS ratio FROM h""",
)
def place_3d(spark, d):
    emitters = b.triggers(spark, d).select(F.col("seq").alias("voice"), (F.col("key") % 31 - 15.5).alias("x"), (F.col("gain") / 100).alias("y"), (F.col("key") % 17 - 8.5).alias("z"), (F.col("gain") / 10).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    listener = spark.createDataFrame([(1.0, 0.0, 2.0, 3.0, 0.0, 0.0)], "lx double, ly double, lz double, lvx double, lvy double, lvz double")
    out = mixing.place_3d(emitters, listener, 1.0, 50.0, 1.0, "inverse")
    return out.select("voice", *(rounded(F.col(c)).alias(c) for c in ("distance", "gain", "left", "right", "ratio")))


_SPEAKERS = ", ".join(f"({i}, {a[0]}, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {b_[0]}, {b_[1]!r}::DOUBLE, {b_[2]!r}::DOUBLE)" for i, (a, b_) in enumerate(zip(mixing.SPEAKERS["5.1"], [*mixing.SPEAKERS["5.1"][1:], mixing.SPEAKERS["5.1"][0]])))


@query(
    "speaker_pan_51",
    f"""WITH {TRIGGER_SQL}, e AS (SELECT seq, key % 31 - 15.5::DOUBLE AS x, gain / 100 AS y, key % 17 - 8.5::DOUBLE AS z FROM triggers),
q AS (SELECT seq, (x + 2 * z) / sqrt(5.0::DOUBLE) AS r, (2 * x - z) / sqrt(5.0::DOUBLE) AS f FROM e), d AS (SELECT seq, r / sqrt(r * r + f * f) AS x, f / sqrt(r * r + f * f) AS z FROM q),
p(i, a, ax, az, b, bx, bz) AS (VALUES {_SPEAKERS}), g AS (SELECT seq, i, a, b, (x * bz - z * bx) / (ax * bz - bx * az) AS ga, (z * ax - x * az) / (ax * bz - bx * az) AS gb FROM d, p),
h AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY i) AS k FROM g WHERE ga >= -1e-12 AND gb >= -1e-12)
SELECT seq, CAST(c AS INT) AS channel, {r6('CASE WHEN c = a THEN greatest(ga, 0.0) / sqrt(ga * ga + gb * gb) WHEN c = b THEN greatest(gb, 0.0) / sqrt(ga * ga + gb * gb) ELSE 0.0 END')} AS gain FROM h, generate_series(0, 5) t(c) WHERE k = 1""",
)
def speaker_pan_51(spark, d):
    """Gains of six channels for a listener who looks along (2, 0, -1)."""
    right, ahead = mixing.seen_by((F.col("key") % 31 - 15.5), F.col("gain") / 100, (F.col("key") % 17 - 8.5), (2.0, 0.0, -1.0), (0.0, 1.0, 0.0))
    return b.triggers(spark, d).select("seq", F.posexplode(mixing.speaker_gains(right, ahead, "5.1")).alias("channel", "gain")).withColumn("gain", rounded(F.col("gain")))


@query(
    "place_3d_51",
    f"""WITH {TRIGGER_SQL}, e AS (SELECT seq, key % 31 - 15.5::DOUBLE - 1 AS x, gain / 100 AS y, key % 17 - 8.5::DOUBLE - 2 AS z FROM triggers),
q AS (SELECT seq, 1 / (1 + 1.0::DOUBLE * (greatest(1.0, least(50.0, sqrt(x * x + y * y + z * z))) - 1)) AS gain, (x + 2 * z) / sqrt(5.0::DOUBLE) AS r, (2 * x - z) / sqrt(5.0::DOUBLE) AS f FROM e), d AS (SELECT seq, gain, r / sqrt(r * r + f * f) AS x, f / sqrt(r * r + f * f) AS z FROM q),
p(i, a, ax, az, b, bx, bz) AS (VALUES {_SPEAKERS}), g AS (SELECT seq, gain, i, a, b, (x * bz - z * bx) / (ax * bz - bx * az) AS ga, (z * ax - x * az) / (ax * bz - bx * az) AS gb FROM d, p),
h AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY i) AS k FROM g WHERE ga >= -1e-12 AND gb >= -1e-12)
SELECT seq AS voice, CAST(c AS INT) AS channel, {r6('gain * CASE WHEN c = a THEN greatest(ga, 0.0) / sqrt(ga * ga + gb * gb) WHEN c = b THEN greatest(gb, 0.0) / sqrt(ga * ga + gb * gb) ELSE 0.0 END')} AS gain FROM h, generate_series(0, 5) t(c) WHERE k = 1""",
)
def place_3d_51(spark, d):
    """Six channels round a listener who looks along (2, 0, -1)."""
    emitters = b.triggers(spark, d).select(F.col("seq").alias("voice"), (F.col("key") % 31 - 15.5).alias("x"), (F.col("gain") / 100).alias("y"), (F.col("key") % 17 - 8.5).alias("z"), *(F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")))
    listener = spark.createDataFrame([(1.0, 0.0, 2.0, 3.0, 0.0, 0.0)], "lx double, ly double, lz double, lvx double, lvy double, lvz double")
    out = mixing.place_3d(emitters, listener, 1.0, 50.0, 1.0, "inverse", forward=(2.0, 0.0, -1.0), layout="5.1")
    return out.select("voice", F.posexplode("gains").alias("channel", "gain")).withColumn("gain", rounded(F.col("gain")))


@query("quietest_victims", f"WITH {_VOICES} SELECT quantum, voice FROM (SELECT *, row_number() OVER (PARTITION BY quantum ORDER BY level, start, voice) AS r FROM v) WHERE r = 1")
def quietest_victims(spark, d):
    return mixing.quietest_victim(_voices(spark, d))


# Buses ---------------------------------------------------------------------------------------------------------------

_BUS_SQL = f"""{LINE_SQL}, v AS (SELECT f.clip % 4 AS bus, channel, frame + f.clip % 7 * 10 AS frame, CAST(CAST({S} * 0.5 AS FLOAT) AS DOUBLE) AS x FROM frames f),
s AS (SELECT bus, channel, frame, CAST(sum(x) AS FLOAT) AS sample FROM v GROUP BY 1, 2, 3)"""


def _buses(spark, d):
    frames = b.line_frames(spark, d)
    voices = frames.select("clip").distinct().select("clip", (F.col("clip") % 4).alias("bus"), (F.col("clip") % 7 * 10).alias("start"), F.lit(0.5).alias("gain"))
    return mixing.sum_to_buses(voices, frames)


@query("bus_sum", f"WITH {_BUS_SQL} SELECT bus, channel, frame, round({S}, 4) + 0.0 AS sample FROM s")
def bus_sum(spark, d):
    return _buses(spark, d).select("bus", "channel", "frame", rounded(F.col("sample"), 4).alias("sample"))


@query(
    "bus_routing",
    f"""WITH {_BUS_SQL}, w(bus, src, g) AS (VALUES (0, 0, 1.0::DOUBLE), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (2, 1, 0.5), (3, 2, 0.25), (3, 1, 0.125), (0, 3, 0.5), (0, 2, 0.125), (0, 1, 0.0625))
SELECT CAST(w.bus AS BIGINT) AS bus, channel, frame, round(CAST(CAST(sum({S} * g) AS FLOAT) AS DOUBLE), 3) + 0.0 AS sample FROM s JOIN w ON w.src = s.bus GROUP BY 1, 2, 3""",
)
def bus_routing(spark, d):
    out = mixing.route(_buses(spark, d), [(1, 2, 0.5), (2, 3, 0.25), (3, 0, 0.5)])
    return out.select("bus", "channel", "frame", rounded(F.col("sample"), 3).alias("sample"))


@query(
    "solo_routing",
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, c_nationkey + 1 + CAST(c_custkey % 3 AS INT) AS dst FROM customer),
down(bus) AS (SELECT 7 UNION SELECT dst FROM e JOIN down ON e.src = down.bus), up(bus) AS (SELECT 7 UNION SELECT src FROM e JOIN up ON e.dst = up.bus)
SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT bus FROM down) OR (src IN (SELECT bus FROM up) AND dst IN (SELECT bus FROM up))""",
)
def solo_routing(spark, d):
    c = b.table(spark, d, "customer")
    edges = c.select(F.col("c_nationkey").alias("src"), (F.col("c_nationkey") + 1 + (F.col("c_custkey") % 3).cast("int")).alias("dst")).distinct()
    return mixing.solo_edges(edges, [7])


# Generators ------------------------------------------------------------------------------------------------------------

_INC = "CAST(floor(greatest(0.0, least(24000.0, {0})) / 48000 * 4294967296.0 + 0.5) AS BIGINT)"


@query(
    "oscillators",
    f"""WITH {NOTE_SQL}, p AS (SELECT note, {_INC.format('440 * pow(2.0::DOUBLE, (midi - 69) * 100 / 1200.0::DOUBLE)')} AS inc FROM notes),
t AS (SELECT note, i AS frame, (inc * i) % 4294967296 / 4294967296.0 AS t, inc / 4294967296.0 AS dt FROM p, generate_series(0, 31) g(i)),
c AS (SELECT *, CASE WHEN t < dt THEN 2 * (t / dt) - (t / dt) * (t / dt) - 1 WHEN t > 1 - dt THEN ((t - 1) / dt) * ((t - 1) / dt) + 2 * ((t - 1) / dt) + 1 ELSE 0 END AS edge FROM t)
SELECT note, CAST(frame AS BIGINT) AS frame, {r6('CASE WHEN t < 0.25 THEN 1.0 ELSE -1.0 END')} AS pulse, {r6('CASE WHEN t < 0.5 THEN 4 * t - 1 ELSE 3 - 4 * t END')} AS triangle, {r6('2 * t - 1 - edge')} AS saw FROM c""",
)
def oscillators(spark, d):
    each = synth.exploded(b.notes(spark, d), F.lit(32))
    step = synth.increment(units.cents_to_hz((F.col("midi") - 69) * 100), 48_000)
    t = synth.phase(step, F.col("frame"))
    return each.select("note", "frame", rounded(synth.wave(t, "pulse", 0.25)).alias("pulse"), rounded(synth.wave(t, "triangle")).alias("triangle"), rounded(synth.smooth_wave(t, step / float(synth.CYCLE), "saw")).alias("saw"))


_SWEPT_CENTS = "(midi - 69) * 100 + (midi % 5 - 2) * 2400 / 48000.0::DOUBLE * i + CASE WHEN i >= 8 THEN 30 * sin((i - 8) % 16 / 16.0::DOUBLE * 6.283185307179586) ELSE 0 END + [0, 4, 7][1 + i // 6 % 3] * 100"
_EDGE = "CASE WHEN {0} < dt THEN 2 * ({0} / dt) - ({0} / dt) * ({0} / dt) - 1 WHEN {0} > 1 - dt THEN (({0} - 1) / dt) * (({0} - 1) / dt) + 2 * (({0} - 1) / dt) + 1 ELSE 0 END"


@query(
    "swept_notes",
    f"""WITH {NOTE_SQL}, p AS (SELECT note, i, {_INC.format(f'440 * pow(2.0::DOUBLE, ({_SWEPT_CENTS}) / 1200.0::DOUBLE)')} AS inc FROM notes, generate_series(0, length - 1) g(i)),
t AS (SELECT note, i, inc / 4294967296.0::DOUBLE AS dt, coalesce(sum(inc) OVER (PARTITION BY note ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4294967296 / 4294967296.0::DOUBLE AS t,
CASE WHEN i < 10 THEN 0.5::DOUBLE ELSE [0.125::DOUBLE, 0.25::DOUBLE, 0.75::DOUBLE][least(i // 10, 3)] END AS d FROM p), w AS (SELECT *, t - d + 1 - floor(t - d + 1) AS u FROM t)
SELECT note, CAST(i AS BIGINT) AS frame, {r6('t')} AS phase, d AS duty, {r6(f"CASE WHEN t < d THEN 1.0 ELSE -1.0 END + {_EDGE.format('t')} - ({_EDGE.format('u')})")} AS pulse FROM w""",
)
def swept_notes(spark, d):
    """Every frame of every note as a pulse whose pitch slides, shakes and steps and whose duty changes."""
    each = synth.exploded(b.notes(spark, d), F.col("length"))
    age = F.col("frame")
    cents = synth.swept_cents((F.col("midi") - 69) * 100, age, (F.col("midi") % 5 - 2) * 2400 / 48_000, (30.0, 16, 8), ([0, 4, 7], 6))
    each = each.withColumn("step", synth.increment(units.cents_to_hz(cents), 48_000)).withColumn("duty", synth.swept_duty(age, 0.5, [0.125, 0.25, 0.75], 10))
    out = synth.summed_phase(each, "note", F.col("step"))
    pulse = synth.smooth_wave(F.col("phase"), F.col("step") / float(synth.CYCLE), "pulse", F.col("duty"))
    return out.select("note", "frame", rounded(F.col("phase")).alias("phase"), "duty", rounded(pulse).alias("pulse"))


def _effects(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return b.table(spark, d, "part").select(
        F.col("p_partkey").alias("effect"),
        (200 + price / 10).alias("frequency"),
        ((size - 25) / 10.0).alias("slide"),
        F.lit(-1.5).alias("slide_change"),
        (size % 13).cast("double").alias("arpeggio"),
        (size % 16).cast("bigint").alias("arpeggio_at"),
        (size % 3 / 4.0).alias("vibrato_depth"),
        F.lit(30.0).alias("vibrato_speed"),
        (8 + size).cast("bigint").alias("repeat"),
        F.lit(4).cast("bigint").alias("attack"),
        (size + 1).cast("bigint").alias("sustain"),
        F.lit(12).cast("bigint").alias("decay"),
        F.lit(0.5).alias("punch"),
        F.lit(0.5).alias("volume"),
    )


_FX = f"""e AS (SELECT p_partkey AS effect, 200 + p_retailprice / 10 AS hz, (p_size - 25) / 10.0::DOUBLE AS slide, p_size % 13 AS arp, p_size % 16 AS arp_at, p_size % 3 / 4.0::DOUBLE AS vib, 8 + p_size AS rep, p_size + 1 AS sus FROM part),
n AS (SELECT *, CAST(i AS BIGINT) AS frame, i % rep AS m FROM e, generate_series(0, 66) g(i) WHERE i < 16 + sus),
f AS (SELECT *, hz * pow(2.0::DOUBLE, slide * (m / 8000.0::DOUBLE) + -1.5::DOUBLE * (m / 8000.0::DOUBLE) * (m / 8000.0::DOUBLE) / 2 + CASE WHEN m >= arp_at THEN arp / 12.0::DOUBLE ELSE 0 END + CASE WHEN vib > 0 THEN vib / 12 * sin(30.0::DOUBLE * frame / 8000 * 6.283185307179586) ELSE 0 END) AS f,
CASE WHEN frame < 4 THEN frame / 4.0::DOUBLE WHEN frame < 4 + sus THEN 1 + 0.5::DOUBLE * (1 - (frame - 4) / CAST(sus AS DOUBLE)) ELSE 1 - (frame - 4 - sus) / 12.0::DOUBLE END AS level FROM n)"""


@query("effect_frequency_level", f"WITH {_FX} SELECT effect, frame, {r6('f')} AS hz, {r6('level')} AS level FROM f")
def effect_frequency_level(spark, d):
    each = synth.exploded(_effects(spark, d), F.col("attack") + F.col("sustain") + F.col("decay"))
    return each.select("effect", "frame", rounded(synth.effect_frequency(F.col("frame"), 8000)).alias("hz"), rounded(synth.effect_level(F.col("frame"))).alias("level"))


@query(
    "effect_render",
    f"""WITH {_FX}, s AS (SELECT effect, frame, level, CAST(floor(greatest(0.0, least(4000.0, f)) / 8000 * 4294967296.0 + 0.5) AS BIGINT) AS inc FROM f),
p AS (SELECT effect, frame, level, CAST(coalesce(sum(inc) OVER (PARTITION BY effect ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % 4294967296 / 4294967296.0 AS t FROM s)
SELECT effect, frame, round(CAST(CAST((CASE WHEN t < 0.5 THEN 4 * t - 1 ELSE 3 - 4 * t END) * level * 0.5 AS FLOAT) AS DOUBLE), 5) + 0.0 AS sample FROM p""",
)
def effect_render(spark, d):
    return synth.render_effects(_effects(spark, d), 8000).select("effect", "frame", rounded(F.col("sample"), 5).alias("sample"))


@query("drum_levels", f"WITH {NOTE_SQL} SELECT note, CAST(i AS BIGINT) AS frame, {r6('pow(1 - i / CAST(40 + velocity AS DOUBLE), 2) * least(1.0, i / 5.0::DOUBLE)')} AS level FROM notes, generate_series(0, 39) g(i)")
def drum_levels(spark, d):
    each = synth.exploded(b.notes(spark, d), F.lit(40))
    rest = 1 - F.col("frame") / (40 + F.col("velocity"))
    return each.select("note", "frame", rounded(rest * rest * F.least(F.lit(1.0), F.col("frame") / 5)).alias("level"))


@query(
    "render_notes",
    f"""WITH {NOTE_SQL}, p AS (SELECT track, start AS "on", start + length AS "off", {_INC.format('440 * pow(2.0::DOUBLE, (midi - 69) * 100 / 1200.0::DOUBLE)')} AS inc, volume / 15.0::DOUBLE * (velocity / 127.0::DOUBLE) AS amp FROM notes),
t AS (SELECT track, "on" + i AS frame, i AS age, "off" - "on" AS held, (inc * i) % 4294967296 / 4294967296.0 AS t, amp FROM p, generate_series(0, 123) g(i) WHERE i < "off" - "on" + 64),
l AS (SELECT *, CASE WHEN least(age, held) < 32 THEN least(age, held) / 32.0::DOUBLE WHEN least(age, held) < 96 THEN 1 - 0.5 * (least(age, held) - 32) / 64.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN age < held THEN 1.0 ELSE 1 - (age - held) / 64.0::DOUBLE END AS env FROM t)
SELECT track, frame, round(CAST(CAST(sum((CASE WHEN t < 0.5 THEN 4 * t - 1 ELSE 3 - 4 * t END) * env * amp) * 0.25 AS FLOAT) AS DOUBLE), 5) + 0.0 AS sample FROM l GROUP BY track, frame""",
)
def render_notes(spark, d):
    n = b.notes(spark, d).select("track", F.col("start").alias("on"), (F.col("start") + F.col("length")).alias("off"), ((F.col("midi") - 69) * 100).alias("cents"), (F.col("volume") / 15 * (F.col("velocity") / 127)).alias("amplitude"))
    return synth.render_notes(n, 48_000).select("track", "frame", rounded(F.col("sample"), 5).alias("sample"))


# Voice and texts -------------------------------------------------------------------------------------------------------

_V = {"w": f"[{voice.ALPHA}{voice.SYLLABIC}](?:[{voice.ALPHA}{voice.SYLLABIC}{voice.COMBINING}{voice.JOINER}]*[{voice.ALPHA}{voice.SYLLABIC}{voice.COMBINING}])?", "gap": f"[^{voice.ALPHA}{voice.SYLLABIC}]*", "loose": voice.LOOSE.replace("'", "''"), "syl": voice.SYLLABLE, "end": f"[{voice.END}]", "pause": f"[{voice.PAUSE}]"}
_V["w"] = _V["w"].replace("'", "''")


def _spoken(key: str, table: str) -> str:
    """A row for each word: its syllables, whether it ends a phrase, and the pauses behind it."""
    return f"""t AS (SELECT {key}, regexp_extract_all(coalesce(text, ''), '({_V['w']})({_V['gap']})', 1) AS w, regexp_extract_all(coalesce(text, ''), '({_V['w']})({_V['gap']})', 2) AS g FROM {table}),
e AS (SELECT {key}, len(w) AS n, unnest(range(len(w))) AS position, regexp_replace(unnest(w), '{_V['loose']}', '') AS word, unnest(g) AS gap FROM t),
x AS (SELECT *, len(regexp_extract_all(word, '{_V['syl']}')) AS syl, regexp_matches(gap, '{_V['end']}') AS ended, len(regexp_extract_all(gap, '{_V['pause']}')) AS p FROM e),
y AS (SELECT *, CASE WHEN ended THEN 380 WHEN p > 0 THEN 220 * p ELSE 45 END AS rest FROM x)"""


@query(
    "speech_segments",
    f"""WITH {_spoken('doc_id', 'documents')}, s AS (SELECT doc_id, count(*) AS words, sum(syl) AS syllables, sum(CASE WHEN position < n - 1 AND NOT ended THEN p ELSE 0 END) AS pauses,
sum(CASE WHEN position = n - 1 OR ended THEN 1 ELSE 0 END) AS phrases, sum(CASE WHEN position < n - 1 THEN rest ELSE 0 END) AS rest FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(syllables, 0) AS BIGINT) AS syllables, CAST(coalesce(pauses, 0) AS BIGINT) AS pauses, CAST(coalesce(phrases, 0) AS BIGINT) AS phrases,
CAST(coalesce(syllables * 120 + phrases * 36 + rest, 0) AS BIGINT) AS duration_ms FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
)
def speech_segments(spark, d):
    return voice.segments(b.table(spark, d, "documents"), "doc_id")


@query(
    "spoken_words",
    f"""WITH {_spoken('conv_id, turn', 'conversations')}, z AS (SELECT *, coalesce(sum((syl * 120 + CASE WHEN ended THEN 36 ELSE 0 END + rest) * 1000) OVER (PARTITION BY conv_id, turn ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS us FROM y)
SELECT conv_id, turn, CAST(position AS INT) AS position, word, CAST((us * 48000 + 500000) // 1000000 AS BIGINT) AS "on" FROM z""",
)
def spoken_words(spark, d):
    turns = b.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return voice.placed_words(turns, "id", 48_000).select("id.conv_id", "id.turn", "position", "word", "on")


@query(
    "spoken_at",
    f"""WITH {_spoken('conv_id, turn', 'conversations')}, z AS (SELECT *, coalesce(sum((syl * 120 + CASE WHEN ended THEN 36 ELSE 0 END + rest) * 1000) OVER (PARTITION BY conv_id, turn ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS us FROM y),
m AS (SELECT conv_id, turn, word, CAST((us * 48000 + 500000) // 1000000 AS BIGINT) AS a, CAST((us * 48000 + 500000) // 1000000 AS BIGINT) + syl * 5760 AS e FROM z), q AS (SELECT c.conv_id, c.turn, coalesce(max(e), 0) // 24000 AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn GROUP BY 1, 2),
r AS (SELECT conv_id, turn, CAST(i * 24000 AS BIGINT) AS frame FROM q, generate_series(0, n) t(i))
SELECT r.conv_id, r.turn, r.frame, CASE WHEN r.frame < m.e THEN m.word END AS word FROM r ASOF LEFT JOIN m ON m.conv_id = r.conv_id AND m.turn = r.turn AND r.frame >= m.a""",
)
def spoken_at(spark, d):
    """The word that is spoken at every half second of each turn."""
    turns = b.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    placed = voice.placed_words(turns, "id", 48_000).withColumn("end", F.col("on") + F.size(voice.syllables(F.col("word"))) * (48 * voice.SYLLABLE_MS))
    last = placed.groupBy("id").agg(F.floor(F.max("end") / 24_000).cast("bigint").alias("n"))
    rows = turns.select("id").distinct().join(last, "id", "left").select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("n", F.lit(0).cast("bigint")))).alias("i")).select("id", (F.col("i") * 24_000).alias("frame"))
    return timeline.marker_at(rows, placed.select("id", F.col("on").alias("start"), "end", "word"), ["id"], ["word"]).select("id.conv_id", "id.turn", "frame", "word")


@query("note_ticks", "SELECT p_partkey AS part, CAST(CASE WHEN 192 % (p_size % 8 + 1) = 0 AND (192 // (p_size % 8 + 1)) % (1 << (p_size % 3)) = 0 THEN 2 * (192 // (p_size % 8 + 1)) - (192 // (p_size % 8 + 1)) // (1 << (p_size % 3)) END AS BIGINT) AS ticks FROM part")
def note_ticks(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), units.length_ticks(F.col("p_size") % 8 + 1, F.col("p_size") % 3, 48).alias("ticks"))


@query("resampled_positions", f"WITH {NOTE_SQL} SELECT note, CAST(floor(start * (44100 / 48000.0::DOUBLE) + 0.5) AS BIGINT) AS start_frame, CAST(floor((start + length) * (44100 / 48000.0::DOUBLE) + 0.5) AS BIGINT) - CAST(floor(start * (44100 / 48000.0::DOUBLE) + 0.5) AS BIGINT) AS frames FROM notes")
def resampled_positions(spark, d):
    start, end = (units.resampled_index(x, 48_000, 44_100) for x in (F.col("start"), F.col("start") + F.col("length")))
    return b.notes(spark, d).select("note", start.alias("start_frame"), (end - start).alias("frames"))


@query(
    "name_hashes",
    f"""WITH RECURSIVE {TRIGGER_SQL}, names AS (SELECT DISTINCT name FROM triggers), h(name, i, h) AS (SELECT name, 0, 14695981039346656037::HUGEINT FROM names
UNION ALL SELECT name, i + 1, xor(h, ascii(substr(name, i + 1, 1))::HUGEINT) * 1099511628211 % 18446744073709551616 FROM h WHERE i < length(name))
SELECT name, lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS hash FROM h WHERE i = length(name)""",
)
def name_hashes(spark, d):
    return b.triggers(spark, d).select("name").distinct().select("name", units.fnv1a(F.col("name")).alias("hash"))


# Containers ------------------------------------------------------------------------------------------------------------

_RAW = f"WITH {EMB_SQL} SELECT clip, 1000 AS rate, '{{0}}' AS kind, channel, CAST(frame AS INT) AS frame, {{1}} AS sample FROM frames"
for _box, _kind in (("wav", "s16"), ("wav", "f32"), ("wav", "u8"), ("aiff", "s24"), ("au", "s32"), ("caf", "s16")):
    _full = float(1 << (levels.BITS.get(_kind, 16) - 1))

    def _round_trip(spark, d, box=_box, kind=_kind):
        made = containers.encode_clips(shape.as_clips(b.emb_frames(spark, d)), box, kind, b.EMB_RATE)
        read = containers.decode_files(made)
        each = read.select("clip", "rate", "kind", F.posexplode("channels").alias("channel", "samples"))
        return each.select("clip", "rate", "kind", "channel", F.posexplode("samples").alias("frame", "sample")).withColumn("sample", rounded(F.col("sample")))

    _value = S if _kind == "f32" else f"CAST(CAST(greatest(-{_full}, least({_full} - 1, sign({S}) * floor(abs({S}) * {_full} + 0.5))) / {_full} AS FLOAT) AS DOUBLE)"
    query(f"round_trip_{_box}_{_kind}", _RAW.format(_kind, r6(_value)))(_round_trip)


@query("round_trip_files", f"WITH {EMB_SQL} SELECT clip, 1000 AS rate, channel, frame, {r6(f'CAST(CAST(greatest(-32768.0, least(32767.0, sign({S}) * floor(abs({S}) * 32768.0 + 0.5))) / 32768.0 AS FLOAT) AS DOUBLE)')} AS sample FROM frames WHERE frame >= 8")
def round_trip_files(spark, d):
    """Files of all clips, written by the data source and read again from the ninth frame on."""
    folder = files.work_folder(spark, "clips")
    files.write_clips(b.emb_frames(spark, d), folder, b.EMB_RATE, "wav", "s16")
    read = files.read_frames(spark, folder).where("frame >= 8")
    clip = F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("bigint")
    return read.select(clip.alias("clip"), "rate", "channel", "frame", rounded(F.col("sample")).alias("sample"))


@query("sniff_containers", "SELECT CAST(vec_id AS BIGINT) AS clip, CASE vec_id % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'au' ELSE 'caf' END AS container FROM embeddings")
def sniff_containers(spark, d):
    clips = shape.as_clips(b.emb_frames(spark, d))
    made = [containers.encode_clips(clips.where(F.col("clip") % 4 == i), box, "s16", b.EMB_RATE) for i, box in enumerate(("wav", "aiff", "au", "caf"))]
    both = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return both.select("clip", containers.sniff(F.col("content")).alias("container"))


# Catalogues ------------------------------------------------------------------------------------------------------------


@query(
    "voice_checks",
    f"""WITH {TRIGGER_SQL} SELECT seq, regexp_full_match(v, '[A-Za-z0-9_.-]{{1,64}}') AS named, gain / 20 BETWEEN 0.0625 AND 8 AS rate_ok, gain - 60 BETWEEN -48 AND 48 AS pitch_ok, CASE seq % 10 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 4 THEN 51 WHEN 6 THEN 63 WHEN 8 THEN 1599 ELSE 0 END AS mask
FROM (SELECT *, CASE seq % 4 WHEN 0 THEN name WHEN 1 THEN name || ' ' || key WHEN 2 THEN repeat(name, seq % 20) ELSE name || '.' || key || '-' || seq END AS v FROM triggers)""",
)
def voice_checks(spark, d):
    """Names, playback rates, pitches and speaker bits of voices made from triggers."""
    t, seq = b.triggers(spark, d), F.col("seq")
    name = F.when(seq % 4 == 0, F.col("name")).when(seq % 4 == 1, F.concat_ws(" ", "name", "key")).when(seq % 4 == 2, F.expr("repeat(name, cast(seq % 20 as int))")).otherwise(F.concat("name", F.lit("."), F.col("key").cast("string"), F.lit("-"), seq.cast("string")))
    return t.select("seq", checks.name_ok(name).alias("named"), checks.rate_ok(F.col("gain") / 20).alias("rate_ok"), checks.pitch_ok(F.col("gain") - 60).alias("pitch_ok"), F.coalesce(checks.channel_mask(seq % 10), F.lit(0)).alias("mask"))


_TAGGED = "SELECT l_orderkey AS clip, ['INAM', 'artist', 'TRACKNUMBER', 'albumartist', 'Disc', 'isrc', 'mood'][1 + l_linenumber % 7] AS name, CASE WHEN l_partkey % 17 = 0 THEN 'a' || chr(0) || 'b' ELSE CAST(l_suppkey AS VARCHAR) END AS value, ['wav', 'mp3', 'au'][1 + l_orderkey % 3] AS box FROM lineitem"


@query(
    "tag_faults",
    f"""WITH t AS ({_TAGGED}), c AS (SELECT *, CASE lower(name) WHEN 'inam' THEN 'title' WHEN 'artist' THEN 'artist' WHEN 'tracknumber' THEN 'track' WHEN 'albumartist' THEN 'album_artist' WHEN 'disc' THEN 'disc' WHEN 'isrc' THEN 'isrc' END AS tag FROM t),
g AS (SELECT clip, tag, any_value(box) AS box, bool_or(contains(value, chr(0))) AS zero, count(DISTINCT value) AS n FROM c WHERE tag IS NOT NULL GROUP BY 1, 2)
SELECT clip, tag, 'no tags in this container' AS fault FROM g WHERE box = 'au' UNION ALL SELECT clip, tag, 'no place for this tag' FROM g WHERE box = 'wav' AND tag IN ('album_artist', 'disc', 'isrc')
UNION ALL SELECT clip, tag, 'a zero character' FROM g WHERE zero UNION ALL SELECT clip, tag, 'several values' FROM g WHERE n > 1""",
)
def tag_faults(spark, d):
    """What the containers of orders read as clips can't keep of the tags that their lines give."""
    line = b.table(spark, d, "lineitem")
    names, boxes = F.lit(["INAM", "artist", "TRACKNUMBER", "albumartist", "Disc", "isrc", "mood"]), F.lit(["wav", "mp3", "au"])
    value = F.when(F.col("l_partkey") % 17 == 0, F.lit("a\0b")).otherwise(F.col("l_suppkey").cast("string"))
    tags = line.select(F.col("l_orderkey").alias("clip"), F.get(names, (F.col("l_linenumber") % 7).cast("int")).alias("name"), value.alias("value"))
    return checks.tag_faults(tags, F.get(boxes, (F.col("clip") % 3).cast("int")))


@query(
    "effect_faults",
    """WITH e AS (SELECT p_partkey AS effect, p_retailprice AS frequency, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE p_size / 50.0 END::DOUBLE AS duty, (p_size - 25) / 2.0::DOUBLE AS slide, p_size % 5 / 2.0::DOUBLE AS attack, p_size % 3::DOUBLE AS sustain, p_size % 4::DOUBLE AS decay FROM part)
SELECT effect, 'frequency' AS fault FROM e WHERE NOT frequency BETWEEN 950 AND 1900 UNION ALL SELECT effect, 'duty' FROM e WHERE NOT (duty BETWEEN 0.1 AND 0.9 OR duty = 0) UNION ALL SELECT effect, 'slide' FROM e WHERE NOT slide BETWEEN -10 AND 10
UNION ALL SELECT effect, 'duration' FROM e WHERE NOT (attack + sustain + decay > 0 AND attack + sustain + decay <= 5)""",
)
def effect_faults(spark, d):
    size = F.col("p_size")
    part = b.table(spark, d, "part").select(F.col("p_partkey").alias("effect"), F.col("p_retailprice").alias("frequency"), F.when(size % 7 == 0, 0.0).otherwise(size / 50).alias("duty"), ((size - 25) / 2).alias("slide"), (size % 5 / 2).alias("attack"), (size % 3).alias("sustain"), (size % 4).alias("decay"))
    return checks.field_faults(part, "effect", {"frequency": (950.0, 1900.0, False), "duty": (0.1, 0.9, True), "slide": (-10.0, 10.0, False)}, 5.0)


@query("repeated_names", "SELECT c_nationkey AS bus, count(*) AS times FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, d):
    return checks.repeated(b.table(spark, d, "customer").select(F.col("c_nationkey").alias("bus")), "bus")


@query("drum_lengths", f"WITH {NOTE_SQL}, n AS (SELECT note, CASE WHEN note % 3 = 0 THEN 'clap' ELSE 'kick' END AS kind, note % 5 * 25 AS percent, midi AS tone, note % 90 AS noise, note % 2 AS click FROM notes) SELECT note, CAST(greatest(CASE WHEN percent < 100 AND kind <> 'clap' THEN tone ELSE 0 END, CASE WHEN percent > 0 AND noise > 0 THEN noise + CASE WHEN kind = 'clap' THEN 30 ELSE 0 END ELSE 0 END, CASE WHEN click > 0 THEN 3 ELSE 0 END) AS BIGINT) AS ms FROM n")
def drum_lengths(spark, d):
    note = F.col("note")
    length = checks.drum_ms(F.when(note % 3 == 0, "clap").otherwise("kick"), note % 5 * 25, F.col("midi"), note % 90, note % 2)
    return b.notes(spark, d).select("note", length.cast("bigint").alias("ms"))


@query("piece_length", f"WITH {NOTE_SQL} SELECT CAST(max(start + length) AS BIGINT) AS ticks, round(max(start + length) * 60.0::DOUBLE / (120 * 48), 6) + 0.0 AS seconds FROM notes")
def piece_length(spark, d):
    return checks.piece_length(b.notes(spark, d), 120, TPQ).select("ticks", rounded(F.col("seconds")).alias("seconds"))


# Reports over events ---------------------------------------------------------------------------------------------------


@query("event_levels", f"WITH {TRIGGER_SQL} SELECT name, frame // 86400000 AS day, count(*) AS starts, round(max(gain), 6) + 0.0 AS loudest, count(DISTINCT key) AS keys FROM triggers GROUP BY 1, 2")
def event_levels(spark, d):
    t = b.triggers(spark, d)
    return t.groupBy("name", F.floor(F.col("frame") / 86_400_000).cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("starts"), rounded(F.max("gain")).alias("loudest"), F.count_distinct("key").alias("keys"))


@query(
    "event_sessions",
    f"""WITH {TRIGGER_SQL}, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 3600000 THEN 1 ELSE 0 END AS new FROM triggers WINDOW w AS (PARTITION BY key ORDER BY frame, seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY frame, seq ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT key, min(frame) AS start, max(frame) AS "end", count(*) AS starts FROM s GROUP BY key, s""",
)
def event_sessions(spark, d):
    order = Window.partitionBy("key").orderBy("frame", "seq")
    t = b.triggers(spark, d).withColumn("_new", F.when(F.col("frame") - F.lag("frame").over(order) > 3_600_000, 1).otherwise(0))
    t = t.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("key", "_s").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("starts")).drop("_s")
