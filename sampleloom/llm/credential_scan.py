"""Secret scans: fixed patterns, and formats that are inferred from labelled credentials as probabilistic automata.

The values that the patterns find in all documents are the labelled credentials, of which each kind learns from a bounded,
hash-chosen number. For each kind, a prefix tree of their character classes is generalised by merging states whose
outgoing frequencies are statistically compatible (Hoeffding bounds, with their successors), which leaves a small probabilistic automaton; a
further automaton is learned from other tokens of hash-chosen texts. Every long enough token of every whole text that the
patterns' spans do not cover already is then scored by how much likelier the best format makes it than the background, and
those beyond the threshold add spans of kind ``format``, which may reach over spans of the patterns; these always stay.

Null texts count as empty and have no spans. Repeated rows give equal rows. With fewer than ``LEAST_LABELLED`` labelled
values of a kind, that kind has no automaton. Positions are code points, ends exclusive. Extra columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches, table, texts_of

KINDS = ("assign", "access", "hex", "format")
#: Documents whose other tokens are the background (credentials are labelled in all), and distinct values and tokens that
#: are learned from.
SAMPLE_DOCS = 20_000
LABELLED = 1500
BACKGROUND = 3000
LEAST_LABELLED = 20
ALPHA = 0.05
#: Nats by which a format must beat the background, in all and for each character.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates have the characters of labelled values and at least as many as the shortest of them, without dots at their edges.
SHORTEST = 6
TOKEN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
#: Class strings whose gains a worker remembers, and tokens that are no credentials.
GAINS = 1 << 18

_CLASS = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")}
CLASSES = "dhlHU+/_.=-"
_TO_CLASS = str.maketrans(_CLASS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted.

    Runs of hex digits and keys are maximal, so asking for their least length inside the pattern drops the same ones.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A deterministic probabilistic automaton over character classes: per state, its visits, ends and moves."""

    def __init__(self, words: list[str]):
        self.n, self.ends, self.moves = [0], [0], [{}]
        for word in words:
            state = 0
            self.n[0] += 1
            for c in word.translate(_TO_CLASS):
                nxt = self.moves[state].get(c)
                if nxt is None:
                    nxt = self.moves[state][c] = len(self.n)
                    self.n.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                state = nxt
                self.n[state] += 1
            self.ends[state] += 1
        #: How often each move was taken is the visits of what it led to in the tree; merging keeps the sums here.
        self.taken = [{c: self.n[s] for c, s in m.items()} for m in self.moves]

    def _alike(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            most = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > most:
                return False
            ta, tb = self.taken[a], self.taken[b]
            for c in ta.keys() | tb.keys():
                if abs(ta.get(c, 0) / na - tb.get(c, 0) / nb) > most:
                    return False
                if c in ta and c in tb and (self.moves[a][c], self.moves[b][c]) != (a, b):
                    todo.append((self.moves[a][c], self.moves[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds the tree below ``blue`` to ``red``; blue states are trees, so this ends."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, nxt in self.moves[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + self.taken[b][c]
                if c in self.moves[a]:
                    todo.append((self.moves[a][c], nxt))
                else:
                    self.moves[a][c] = nxt

    def generalise(self, alpha: float = ALPHA) -> Automaton:
        """Merges compatible states, in the order in which the tree is wide: each frontier state into the first kept state
        that it is like, else it is kept."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        kept = [0]
        while True:
            inside = set(kept)
            frontier = [(s, c, self.moves[s][c]) for s in kept for c in sorted(self.moves[s]) if self.moves[s][c] not in inside]
            if not frontier:
                break
            parent, c, blue = max(frontier, key=lambda x: self.n[x[2]])
            for red in kept:
                if self._alike(red, blue, bound):
                    self.moves[parent][c] = red
                    self._fold(red, blue)
                    break
            else:
                kept.append(blue)
        place = {s: i for i, s in enumerate(kept)}
        self.n, self.ends = [self.n[s] for s in kept], [self.ends[s] for s in kept]
        self.taken = [self.taken[s] for s in kept]
        self.moves = [{c: place[t] for c, t in self.moves[s].items()} for s in kept]
        return self

    def score(self, word: str) -> float:
        """Log probability of the word's classes, with half an occurrence of everything unseen; unseen moves restart."""
        state, total = 0, 0.0
        for c in word.translate(_TO_CLASS):
            whole = self.n[state] + 0.5 * (len(CLASSES) + 1)
            total += math.log((self.taken[state].get(c, 0) + 0.5) / whole)
            state = self.moves[state].get(c, 0)
        return total + math.log((self.ends[state] + 0.5) / (self.n[state] + 0.5 * (len(CLASSES) + 1)))


class Formats:
    """The automata of the kinds of credentials and of other tokens."""

    def __init__(self, labelled: dict[str, list[str]], background: list[str], alpha: float = ALPHA):
        self.automata = [Automaton(v).generalise(alpha) for _, v in sorted(labelled.items()) if len(v) >= LEAST_LABELLED]
        self.background = Automaton(background).generalise(alpha)

        self._gains: dict[str, float] = {}
        self._plain: set[str] = set()

    def gain(self, token: str) -> float:
        """By how many nats the best format beats the background; this depends on the token's classes alone."""
        classes = token.translate(_TO_CLASS)
        found = self._gains.get(classes)
        if found is None:
            if len(self._gains) >= GAINS:
                self._gains.clear()
            found = self._gains[classes] = max(a.score(token) for a in self.automata) - self.background.score(token) if self.automata else -math.inf
        return found

    def beats(self, token: str) -> bool:
        """Whether a token without dots at its edges is long enough and likely enough."""
        return len(token) >= SHORTEST and (gain := self.gain(token)) >= LEAST_TOTAL and gain >= LEAST_EACH * len(token)

    def scored(self, text: str) -> tuple[list[tuple[int, int, int]], dict[int, float]]:
        """The patterns' spans and those that the formats add, sorted, and the gains of the latter by their starts."""
        base = base_spans(text)
        # Most texts hold no token that beats the background, and most tokens have been seen before.
        new = set(TOKEN.findall(text)) - self._plain if self.automata else set()
        plain = {t for t in new if not self.beats(t.strip("."))}
        if len(self._plain) + len(plain) > GAINS:
            self._plain.clear()
        self._plain |= plain
        if len(plain) == len(new):
            return base, {}
        gains, more, k, covered = {}, [], 0, []
        for m in TOKEN.finditer(text):
            token = m[0].strip(".")
            if not self.beats(token):
                continue
            a = m.start() + len(m[0]) - len(m[0].lstrip("."))
            e = a + len(token)
            while k < len(base) and base[k][0] < e:  # base spans as stretches that do not touch
                if covered and base[k][0] <= covered[-1][1]:
                    covered[-1][1] = max(covered[-1][1], base[k][2])
                else:
                    covered.append([base[k][0], base[k][2]])
                k += 1
            if not any(lo <= a and e <= hi for lo, hi in covered[-1:]):
                more.append((a, 3, e))
                gains[a] = self.gain(token)
        return sorted(base + more), gains

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return self.scored(text)[0]


def labelled_values(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(kind, value): distinct labelled credentials of all documents, background tokens of about ``sample_docs`` hash-chosen ones."""
    rate = min(1.0, sample_docs / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(F.lit("credentials"), "doc_id"), F.lit(1 << 30)) < F.lit(rate * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for text, other in zip(texts_of(b), b.column(1).to_pylist()):
                rows |= {("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST}
                rows |= {("access", m[0]) for m in ACCESS.finditer(text)} | {("hex", m[0]) for m in HEX.finditer(text)}
                if not other:
                    continue
                at, rest = 0, []
                for a, _, e in base_spans(text):
                    rest.append(text[at : max(at, a)])
                    at = max(at, e)
                for part in [*rest, text[at:]]:
                    tokens = {t.strip(".") for t in TOKEN.findall(part)}
                    rows |= {("", t) for t in tokens if len(t) >= SHORTEST and hashlib.md5(t.encode()).digest()[0] < 16}
            found = sorted(rows)
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "value"])

    return docs.select("text", chosen.alias("other")).mapInArrow(run, "kind string, value string").distinct()


def fit(docs: DataFrame, labelled: int = LABELLED, background: int = BACKGROUND, sample_docs: int = SAMPLE_DOCS) -> Formats:
    """Learns formats from at most ``labelled`` distinct values of each kind and ``background`` other tokens, by hash order."""
    with scratch(docs.sparkSession, "credentials") as keep:  # nothing of them stays
        found = keep(labelled_values(docs, sample_docs), "labelled")
        take = lambda kind, n: sorted(r.value for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(n).select("value").collect())
        return Formats({k: take(k, labelled) for k in KINDS[:3]}, take("", background))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(docs: DataFrame, formats: Formats, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_format, base_sha256, spans, gains) of every row; ``gains`` says by how many nats each
    format span's best format beats the background, as start:gain."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # a few automata
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in texts_of(b):
                spans, gains = shared.value.scored(text)
                base = [s for s in spans if s[1] < 3]
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((*n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), ",".join(f"{a}:{gains[a]:.3f}" for a in sorted(gains))))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["key", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "gains"])

    return docs.select(key, "text").mapInArrow(run, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string, gains string").withColumnRenamed("key", key)


def redact(docs: DataFrame, formats: Formats, mark: str = "<secret>", length: str | None = None) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by ``mark``; texts without spans stay as they are.

    ``length`` names a column that follows the changed texts' lengths.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    place = docs.columns.index("text")
    counted = docs.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(place).to_pylist():
                parts, at = [], 0
                for a, _, e in shared.value.spans(text) if text else ():
                    if e <= at:
                        continue
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = e
                out.append("".join([*parts, text[at:]]) if parts else text)
            if counted is not None:
                sizes = [n if x == y else len(y) for x, y, n in zip(b.column(place).to_pylist(), out, b.column(counted).to_pylist())]
                b = b.set_column(counted, b.schema.field(counted), pa.array(sizes, b.schema.field(counted).type))
            yield b.set_column(place, b.schema.field(place), pa.array(out, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and format spans of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
