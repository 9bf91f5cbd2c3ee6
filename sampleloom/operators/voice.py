"""Texts as invented speech: words, syllables and pauses of whole texts, their lengths, and where they fall in time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Classes of characters (code-point ranges, fixed values): letters that make syllables of up to three, characters that are a
#: syllable each, marks that belong to what they follow, joiners that sound as nothing inside a word, pauses, and ends.
ALPHA = "a-zA-Z0-9\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}\\x{370}-\\x{3FF}\\x{400}-\\x{4FF}"
SYLLABIC = "\\x{3040}-\\x{30FA}\\x{30FD}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}"
COMBINING = "\\x{300}-\\x{36F}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{FE00}-\\x{FE0F}\\x{FE20}-\\x{FE2F}\\x{30FC}\\x{200D}"
JOINER = "'\\x{2019}\\x{2010}\\-"
PAUSE = ",;:\\x{3001}\\x{FF0C}\\x{FF1A}\\x{FF1B}"
END = ".?!\\x{2026}\\x{3002}\\x{FF0E}\\x{FF1F}\\x{FF01}"
#: A word with marks and joiners inside, and what stands between it and the next.
WORD_ONLY = f"[{ALPHA}{SYLLABIC}](?:[{ALPHA}{SYLLABIC}{COMBINING}{JOINER}]*[{ALPHA}{SYLLABIC}{COMBINING}])?"
WORD = f"({WORD_ONLY})([^{ALPHA}{SYLLABIC}]*)"
#: A mark behind a joiner has nothing to belong to; at a word's end it goes.
LOOSE = f"[{JOINER}][{JOINER}{COMBINING}]*$"
SYLLABLE = f"(?:[{ALPHA}][{COMBINING}]*){{1,3}}|[{SYLLABIC}][{COMBINING}]*"
SYLLABLE_MS, LAST_MS, WORD_GAP_MS, PAUSE_MS, PHRASE_MS = 120, 36, 45, 220, 380


def syllables(text: Column) -> Column:
    """The syllables of a text in order."""
    return F.regexp_extract_all(text, F.lit(SYLLABLE), 0)


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 1), lambda w: F.regexp_replace(w, LOOSE, ""))


def between(text: Column) -> Column:
    """What stands behind each word."""
    return F.regexp_extract_all(text, F.lit(WORD), 2)


def _ends(gap: Column) -> Column:
    return gap.rlike(f"[{END}]")


def _pauses(gap: Column) -> Column:
    return F.regexp_count(gap, F.lit(f"[{PAUSE}]"))


def gap_ms(gap: Column) -> Column:
    """The rest between two words: that of a phrase's end, of each of its pauses, or of a word."""
    return F.when(_ends(gap), F.lit(PHRASE_MS)).when(_pauses(gap) > 0, _pauses(gap) * PAUSE_MS).otherwise(F.lit(WORD_GAP_MS))


#: What a character is: letters and syllabic signs make words with marks and joiners, pauses and ends stand between them.
_OTHER, _ALPHA, _SYLLABIC, _COMBINING, _JOINER, _PAUSE, _END = range(7)
#: Characters of texts that are looked at together, unless one text is longer.
TOGETHER = 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from the ranges above."""
    out = np.zeros(0x110000, np.uint8)
    for kind, ranges in ((_ALPHA, ALPHA), (_SYLLABIC, SYLLABIC), (_COMBINING, COMBINING), (_JOINER, JOINER), (_PAUSE, PAUSE), (_END, END)):
        signs = [(int(m[1], 16) if m[1] else ord(m[2] or m[3]), m[3] == "-") for m in re.finditer(r"\\x\{([0-9A-F]+)\}|\\(.)|(.)", ranges)]
        for i, (c, dash) in enumerate(signs):
            if dash and 0 < i < len(signs) - 1:
                out[signs[i - 1][0] : signs[i + 1][0] + 1] = kind
            else:
                out[c] = kind
    return out


def spoken(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(words, syllables, pauses, phrases, paused): the counts of each text, ``paused`` those of stretches of pauses. Runs of
    characters of all texts are found at once."""
    kind = classes()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), size + 1)
    count = lambda at, weights=None: np.bincount(text[at], weights, len(texts)).astype(np.int64)
    # Letters in a row, whatever marks they bear, are syllables of three.
    bare = np.flatnonzero(kind != _COMBINING)
    letters = kind[bare] == _ALPHA
    starts = np.flatnonzero(letters & ~np.concatenate([[False], letters[:-1]]))
    ends = np.flatnonzero(letters & ~np.concatenate([letters[1:], [False]]))
    syllables = count(bare[starts], (ends - starts) // 3 + 1) + count(np.flatnonzero(kind == _SYLLABIC))
    # A word goes from the first letter of a run of letters, signs, marks and joiners to its last one that is no joiner.
    voiced = (kind == _ALPHA) | (kind == _SYLLABIC)
    run = voiced | (kind == _COMBINING) | (kind == _JOINER)
    number = np.cumsum(run & ~np.concatenate([[False], run[:-1]]))
    at = np.flatnonzero(voiced)
    words = at[np.diff(number[at], prepend=-1) != 0]
    # Words, pauses and ends in order; texts end like phrases.
    sign = np.where((kind == _PAUSE) | (kind == _END), kind, 0)
    sign[words] = _ALPHA
    sign[np.cumsum(size + 1) - 1] = _END
    place = np.flatnonzero(sign)
    sign = sign[place]
    word, pause, end = sign == _ALPHA, sign == _PAUSE, np.flatnonzero(sign == _END)
    so_far = np.cumsum(word)
    phrase = np.searchsorted(end, np.arange(len(sign)))
    upto = so_far[end]
    before = np.concatenate([[0], upto[:-1]])
    inside = pause & (so_far > before[phrase]) & (so_far < upto[phrase])
    first = inside & ~np.concatenate([[False], pause[:-1]])
    return count(place[word]), syllables, count(place[inside]), count(place[end[upto > before]]), count(place[first])


def segments(docs: DataFrame, key: str) -> DataFrame:
    """(key, words, syllables, pauses, phrases, duration_ms) of each whole text in even delivery.

    Pauses count inside phrases, between their words; the last syllable of a phrase is longer. Null and empty texts have
    nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lo = [x or "" for x in b.column(1).to_pylist()], 0
            while lo < len(texts):
                hi, held = lo + 1, len(texts[lo])
                while hi < len(texts) and held + len(texts[hi]) <= TOGETHER:
                    held += len(texts[hi])
                    hi += 1
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *map(pa.array, spoken(texts[lo:hi]))], fields.names)
                lo = hi

    fields = StructType([docs.schema[key], *StructType.fromDDL("words bigint, syllables bigint, pauses bigint, phrases bigint, _paused bigint")])
    counted = docs.select(key, F.col("text").cast("string")).mapInArrow(run, fields)
    rest = (F.col("words") - F.col("phrases") - F.col("_paused")) * WORD_GAP_MS + F.col("pauses") * PAUSE_MS + F.greatest(F.col("phrases") - 1, F.lit(0).cast("bigint")) * PHRASE_MS
    return counted.select(key, "words", "syllables", "pauses", "phrases", (F.col("syllables") * SYLLABLE_MS + F.col("phrases") * LAST_MS + rest).alias("duration_ms"))


def placed_words(docs: DataFrame, key: str, rate: int) -> DataFrame:
    """(key, position, word, on): each word's first frame, from the running sum of lengths rounded once."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(key, F.posexplode(F.arrays_zip(words(text).alias("word"), between(text).alias("gap"))).alias("position", "_w")).select(key, "position", "_w.word", "_w.gap")
    length = F.size(syllables(F.col("word"))) * SYLLABLE_MS + F.when(_ends(F.col("gap")), LAST_MS).otherwise(0) + gap_ms(F.col("gap"))
    before = F.coalesce(F.sum(length.cast("bigint") * 1000).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select(key, "position", "word", F.floor((before * rate + 500_000) / 1_000_000).cast("bigint").alias("on"))
