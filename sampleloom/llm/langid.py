"""Language identification of mixed texts: script ranges narrow the candidates, Viterbi labels spans of words.

Learning counts hashed trigrams of folded letters for each language in Spark over a bounded, hash-chosen sample of the
labelled rows (``DOCS_PER_LANG``) and keeps one table of log probabilities with ``BUCKETS`` rows: its size depends on
the number of languages, not on the corpus. A word may only be in languages whose training text uses its script.
Labels of successive words follow from a Viterbi path whose every change of language costs ``SWITCH_PENALTY`` nats.

Nulls, empty texts and texts without letters give ``und`` and score 0. Ties go to the language that sorts first.
Repeated rows get equal answers; without labelled rows every text is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_fold, small_batches, table, texts_of

DOCS_PER_LANG = 2000
BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
#: Least share of a language's training letters for a script to belong to it.
SCRIPT_SHARE = 0.002
#: Code points that are worked on at once.
BLOCK_CHARS = 1 << 21

#: First and last code point of the ranges that hold a script's letters (Unicode blocks; fixed values).
SCRIPT_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = ["other", *SCRIPT_RANGES]


@lru_cache(1)
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded code point, whether it belongs to a word (2: a letter, 1: a mark), and its script."""
    top = 0x110000
    fold, word, script = np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8), np.zeros(top, np.uint8)
    for cp in [*range(0x20000), *range(0x2F800, 0x2FA20)]:
        kind = unicodedata.category(c := chr(cp))[0]
        if kind == "L":
            word[cp] = 2
            if len(low := c.lower()) == 1:
                fold[cp] = ord(low)
        elif kind == "M":
            word[cp] = 1
    word[0x20000:0x323B0] = 2
    for k, name in enumerate(SCRIPTS):
        for lo, hi in SCRIPT_RANGES.get(name, ()):
            script[lo : hi + 1] = k
    return fold, word, script


class Words:
    """The words of some texts as arrays: trigram codes at each place, and each word's text, place, script and letters."""

    def __init__(self, texts: list[str]):
        fold, word, script = code_tables()
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        kind = word[raw]
        inside = kind > 0
        c = np.where(inside, fold[raw], np.uint32(0)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        self.start, self.end = edges[::2], edges[1::2]
        before = np.concatenate([np.zeros(2, np.uint32), c])
        c1, c2 = before[1:-1], before[:-2].copy()
        c2[c1 == 0] = 0
        mixed = c * np.uint32(0x9E3779B1) + c1 * np.uint32(0x85EBCA77) + c2 * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        self.code = (mixed >> np.uint32(17)).astype(np.int32)
        self.letters = np.concatenate([[0], np.cumsum(kind == 2)])
        self.n_letters = self.letters[self.end] - self.letters[self.start]
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.script = script[raw[self.start]] if len(self.start) else np.zeros(0, np.uint8)

    def places(self) -> np.ndarray:
        """The places of all trigrams of words; each word has one more than it has characters, for its end."""
        n = self.end - self.start + 1
        return np.repeat(self.start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)

    def scores(self, table_: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        if not len(self.start):
            return np.zeros((0, table_.shape[1]), np.float32)
        n = self.end - self.start + 1
        firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.add.reduceat(table_[self.code[self.places()]], firsts, axis=0)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, all texts in lockstep: texts that are over leave the front."""
    n, k = scores.shape
    kind = np.min_scalar_type(max(k - 1, 0))
    labels = np.zeros(n, kind)
    if not n or k < 2:
        return labels
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([firsts, [n]]))
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t words
    back = np.empty((n, k), kind)
    stay = np.arange(k, dtype=kind)
    best = scores[firsts].astype(np.float64)
    for t in range(1, sizes[0]):
        m = live[t]
        v = best[:m]
        top = v.argmax(1)
        jump = v.max(1, keepdims=True) - penalty
        at = firsts[:m] + t
        back[at] = np.where(v >= jump, stay, top[:, None])
        np.maximum(v, jump, out=v)
        v += scores[at]
    state = best.argmax(1).astype(kind)
    labels[firsts + sizes - 1] = state
    for t in range(sizes[0] - 1, 0, -1):
        m = live[t]
        at = firsts[:m] + t
        state[:m] = back[at, state[:m]]
        labels[at - 1] = state[:m]
    return labels


class Model:
    """Languages, log probabilities of trigrams, and the scripts that each language uses."""

    def __init__(self, langs: list[str], logp: np.ndarray, allowed: np.ndarray):
        self.langs, self.logp, self.allowed = langs, logp, allowed

    def word_scores(self, words: Words) -> np.ndarray:
        s = words.scores(self.logp)
        s -= s.max(1, keepdims=True, initial=-np.inf) if len(s) else 0
        may = self.allowed[words.script]
        some = may.any(1, keepdims=True)
        s = np.where(may, s, -1e4)
        return np.where(some, s, 0.0)

    def spans(self, texts: list[str], penalty: float = SWITCH_PENALTY) -> tuple[Words, np.ndarray, np.ndarray]:
        words = Words(texts)
        scores = self.word_scores(words)
        return words, scores, viterbi(scores, words.doc, penalty)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learns from ``text`` and ``lang`` of the given rows; rows without either are left out."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = bounded_sample(known, "doc_id", "lang", docs_per_lang, "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = texts_of(b)
            for lang in sorted(set(langs)):
                words = Words([t for t, x in zip(texts, langs) if x == lang])
                n = np.bincount(words.code[words.places()], minlength=BUCKETS)
                s = np.bincount(words.script, words.n_letters, len(SCRIPTS)).astype(np.int64)
                keys = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(s)])
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(np.concatenate([n[n > 0], s[s > 0]]), pa.int64())], ["lang", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted.lang.unique())
    n, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    at = np.searchsorted(langs, counted.lang) if langs else np.zeros(0, np.int64)
    tri = counted.bucket.to_numpy() >= 0
    n[counted.bucket[tri], at[tri]] = counted.n[tri]
    scripts[-1 - counted.bucket[~tri], at[~tri]] = counted.n[~tri]
    logp = np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    return Model(langs, logp, allowed & (scripts > 0))


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, spans): the language with most letters, the share of letters that the path gives it times
    how surely those words prefer it, and the spans of the path as start:end:language in code points."""
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = labelled(shared.value, texts_of(b))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())], ["key", "lang_pred", "score", "spans"])

    return docs.select(key, "text").mapInArrow(run, f"key {kind}, lang_pred string, score double, spans string").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, all columns as they are, with a word that clearly belongs to the language of its span (see ``identified``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(place).to_pylist()]
            yield b.filter(pa.array(in_blocks(texts, lambda part: identified(shared.value, part, least), False), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identified(model: Model, texts: list[str], least: float) -> list[bool]:
    """Whether a word of each text clearly belongs to that of the k languages which the Viterbi path gives its span, whichever and
    however many others there are.

    Its posterior there must lie ``least`` of the way from 1/k to 1, by ratio. Words in scripts of no language belong to none.
    """
    out = np.zeros(len(texts), bool)
    if model.langs:
        words, s, labels = model.spans(texts)
        if len(s):
            sure = np.exp(s[np.arange(len(s)), labels] - np.logaddexp.reduce(s, axis=1))
            sure[~model.allowed[words.script].any(1)] = 0
            out[words.doc[(sure >= len(model.langs) ** (least - 1)) & (words.n_letters > 0)]] = True
    return out.tolist()


def in_blocks(texts: list[str], work: Callable[[list[str]], list], none: object) -> list:
    """What ``work`` gives for each text; texts of like lengths are worked on together, in bounded blocks."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out, part, size = [none] * len(texts), [], 0
    for i in [*order, None]:
        if part and (i is None or size + len(texts[i]) > BLOCK_CHARS):
            for j, row in zip(part, work([texts[j] for j in part])):
                out[j] = row
            part, size = [], 0
        if i is not None:
            part.append(i)
            size += len(texts[i])
    return out


def labelled(model: Model, texts: list[str]) -> list[tuple[str, float, str]]:
    """Language, score and spans of each text."""
    return in_blocks(texts, lambda part: label(model, part), ("und", 0.0, ""))


def label(model: Model, texts: list[str]) -> list[tuple[str, float, str]]:
    """Language, score and spans of each text."""
    out = [("und", 0.0, "")] * len(texts)
    if not model.langs:
        return out
    words, scores, labels = model.spans(texts)
    k = len(model.langs)
    total = np.bincount(words.doc, words.n_letters, len(texts))
    by = np.bincount(words.doc * k + labels, words.n_letters, len(texts) * k).reshape(-1, k)
    top = by.argmax(1)
    # How surely: the share of its words' probability mass that lies on the language, softened by word.
    mine = np.exp(scores[np.arange(len(labels)), labels]) / np.exp(scores).sum(1) if len(labels) else np.zeros(0)
    own = labels == top[words.doc]
    sure = np.bincount(words.doc[own], (mine * words.n_letters)[own], len(texts)) / np.maximum(by[np.arange(len(texts)), top], 1)
    score = by[np.arange(len(texts)), top] / np.maximum(total, 1) * sure
    change = np.flatnonzero(np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | (labels[1:] != labels[:-1])])) if len(labels) else np.zeros(0, np.int64)
    last = np.concatenate([change[1:], [len(labels)]]) - 1 if len(change) else change
    spans: dict[int, list[str]] = {}
    for a, e in zip(change.tolist(), last.tolist()):
        d = int(words.doc[a])
        base = int(words.offsets[d])
        spans.setdefault(d, []).append(f"{int(words.start[a]) - base}:{int(words.end[e]) - base}:{model.langs[labels[a]]}")
    return [(model.langs[top[d]], float(min(1.0, score[d])), ",".join(spans.get(d, ()))) if total[d] else ("und", 0.0, "") for d in range(len(texts))]


def identify(docs: DataFrame, train: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """Learns from ``train`` and labels ``docs``."""
    return predict(docs, fit(train, docs_per_lang))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows of three folds in four."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    fitted = fit(docs.where(~held_out))
    marked = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("row"), "text")
    return predict(marked, fitted, "row").select("row.doc_id", "row.held_out", "lang_pred", "score", "spans")
