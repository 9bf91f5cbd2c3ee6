"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding the tokens of a prefix end with the one token that ends there and may stand behind the last token of
the shorter prefix before it: of all tokens that end at a place, only one is *compatible*, that is, no merge reaches over
the border before both are whole. So the count at a prefix is the count at the prefix before its last token, plus one. An
automaton lists the tokens that end at each place, and every word costs one pass, however many prefixes it has. The last
symbol of a word carries an end mark, so each place has two answers: one for going on and one for ending there.

A text's table holds the differences of its counts, one for each code point, compressed. It answers how many tokens any
prefix has, and which is the longest prefix within a budget, without the text or the tokenizer. Cutting words may need more
tokens than the whole word, so counts may fall; the longest prefix within a budget is the last one that fits.

Prefixes are those of the text in normal form C, which is what the tokenizer reads (texts are nearly always in it): places
between the code points of that form. The tokenizer's own special strings in a text count as one token each where they are
whole, as the library has it. Null texts count as empty: no prefixes, no tokens. Keys of any type, null and repeated ones
pass through, a row for each. Extra columns do not take part. An empty table gives an empty result. Only tokenizers of the
form ``repair.BY_WORD`` with an end-of-word mark are accepted; others are an error.

Short words run together, all places of one distance from a word's beginning at once; long ones one by one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import scratch, store, table
from .repair import BLANKS, BY_WORD, LETTERS, SPELLED, caseless, pieces, ragged

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words, and pairs of neighbouring tokens, that a worker remembers before it starts anew.
WORDS, PAIRS, SLOT_BITS = 600_000, 1_000_000, 20
#: Code points of a batch that are laid out at once, and words that go through the automaton together.
CHUNK, TOGETHER = 1 << 20, 1 << 15
#: Bytes from which a word is long.
LONG = 64
NEVER = 1 << 60
#: Contractions are pieces of their own, cut ones are a sign and letters (fixed form).
CONTRACTION = re.compile("'[a-z]{1,2}")


class Merges:
    """Which tokens a byte-pair encoding can leave side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values(), default=0) + 1
        self.rank, self.parts, self.formed, used = {}, {}, {}, set()
        for n, pair in enumerate(merges):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            used |= {a, b}
            if whole in self.parts or whole in used:
                raise ValueError("merges must form each token once, from tokens formed before")
            self.rank[a * self.size + b], self.parts[whole], self.formed[whole] = n, (a, b), n
        self._known: dict[int, bool] = {}
        # Pairs by the slot of their hash; the last one that came has it.
        self._keys, self._good = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, bool)
        self._edges: tuple[dict[int, list[int]], ...] = ({}, {})

    def _edge(self, token: int, side: int) -> list[int]:
        """What stands at one end of a token while it is built: a single symbol first, the token last."""
        found = self._edges[side].get(token)
        if found is None:
            found = [*self._edge(self.parts[token][side], side), token] if token in self.parts else [token]
            self._edges[side][token] = found
        return found

    def whole_first(self, a: int, b: int) -> bool:
        """Whether a and b are whole before a merge reaches over the border between them. Merges go by rank, equal ones
        from the left."""
        left, right, i, k = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            next_left = self.formed[left[i + 1]] if i + 1 < len(left) else NEVER
            next_right = self.formed[right[k + 1]] if k + 1 < len(right) else NEVER
            if next_left == next_right == NEVER:
                return True
            over = self.rank.get(left[i] * self.size + right[k], NEVER)
            if over < next_left and over <= next_right:
                return False
            if next_left <= next_right:
                i += 1
            else:
                k += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether a stands before b in the encoding of their bytes."""
        key = a * self.size + b
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= PAIRS:
                self._known.clear()
            found = self._known[key] = key not in self.rank and self.whole_first(a, b)
        return found

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; without a first token (-1) no."""
        keys = np.where(a >= 0, a * self.size + b, -1)
        slot = (keys * 0x9E3779B97F4A7C1 >> 24) & (len(self._keys) - 1)
        good, new = self._good[slot], np.flatnonzero((self._keys[slot] != keys) & (keys >= 0))
        if len(new):
            distinct, number = np.unique(keys[new], return_inverse=True)
            made = np.array([self.compatible(*divmod(k, self.size)) for k in distinct.tolist()])
            good[new] = made[number]
            self._keys[slot[new]], self._good[slot[new]] = keys[new], good[new]
        return good & (keys >= 0)

    def sound(self) -> set[int]:
        """The tokens that encode to themselves: single symbols, and those whose parts do and stay apart until they merge."""
        good: set[int] = set()
        for token in sorted(self.parts, key=self.formed.get):
            a, b = self.parts[token]
            if all(x not in self.parts or x in good for x in (a, b)) and self.whole_first(a, b):
                good.add(token)
        return good


class Tree:
    """Finds strings of bytes at all places at once."""

    def __init__(self, strings: dict[bytes, tuple[int, int]]):
        nodes: dict[bytes, int] = {b"": 0}
        for s in strings:
            for k in range(1, len(s) + 1):
                nodes.setdefault(s[:k], len(nodes))
        used = sorted({x for s in nodes for x in s})
        self.kind = np.full(256, len(used), np.int32)
        self.kind[used] = np.arange(len(used))
        self.child = np.full((len(nodes), len(used) + 1), -1, np.int32)
        self.values = np.full((len(nodes), 2), -1)
        for s, n in nodes.items():
            if s:
                self.child[nodes[s[:-1]], self.kind[s[-1]]] = n
            self.values[n] = strings.get(s, (-1, -1))

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, first value, second value) of every string in ``data``."""
        kind = np.append(self.kind[data], len(self.child[0]) - 1)  # no string goes over the end
        start, node, m, found = np.arange(len(data)), np.zeros(len(data), np.int32), 0, []
        while len(start):
            node = self.child[node, kind[start + m]]
            m += 1
            start, node = start[node >= 0], node[node >= 0]
            has = (self.values[node] >= 0).any(1)
            found.append((start[has], start[has] + m, *self.values[node[has]].T))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


class Prefixes:
    """Counts at the prefixes of texts."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        tokenizer = Tokenizer.from_file(path)
        marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        plain = all(t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word) for t in tokenizer.get_added_tokens_decoder().values())
        if (spec.get("normalizer"), spec.get("pre_tokenizer")) != BY_WORD or not suffix or not plain or not all(m.isascii() and not m[0].isalnum() for m in marks):
            raise ValueError("prefix counts need a byte-level tokenizer of words with an end mark")
        self.marks = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.starts_mark = {m[:2] for m in marks}
        self.normal, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.split = pre_tokenizers.Split(Regex(BY_WORD[1]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.merges = Merges(model["vocab"], model["merges"])
        vocab, good = model["vocab"], self.merges.sound()
        ends: dict[str, list[int]] = {}
        for text, i in vocab.items():
            if i in good or i not in self.merges.parts:
                last = text.endswith(suffix) and len(text) > len(suffix)
                bare = text[: -len(suffix)] if last else text
                if not last and len(text) > 1 and i not in good:
                    continue  # no symbol of one byte
                ends.setdefault(bare, [-1, -1])[last] = i
        self.automaton = ahocorasick.Automaton()
        for bare, (a, z) in ends.items():
            self.automaton.add_word(bare, (a, z, len(bare)))
        self.automaton.make_automaton()
        # Words hold no blanks, so neither do their tokens.
        self.tree = Tree({bytes(UNSPELLED[c] for c in bare): (a, z) for bare, (a, z) in ends.items() if SPELLED[0x20] not in bare})
        self._lowered: dict[str, str] = {}
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.starts = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ends(self, spelled: str) -> np.ndarray:
        """The count of each word that would end at each place of ``spelled``, words apart by blanks."""
        n = len(spelled) + 1
        last, before, ended = [-1] * n, [0] * n, [0] * n
        known, compatible, size = self.merges._known, self.merges.compatible, self.merges.size
        for e, (a, z, m) in self.automaton.iter(spelled):
            e += 1
            q = e - m
            p = last[q]
            if p < 0:
                if a >= 0:
                    last[e], before[e] = a, 1
                if z >= 0:
                    ended[e] = 1
                continue
            if a >= 0 and last[e] < 0:
                ok = known.get(p * size + a)
                if compatible(p, a) if ok is None else ok:
                    last[e], before[e] = a, before[q] + 1
            if z >= 0 and not ended[e]:
                ok = known.get(p * size + z)
                if compatible(p, z) if ok is None else ok:
                    ended[e] = before[q] + 1
        return np.array(ended, np.int32)

    def _together(self, data: np.ndarray) -> np.ndarray:
        """The same for many short words at once."""
        start, end, going, ending = self.tree.matches(data)
        place = np.arange(len(data) + 1)
        begin = np.concatenate([[True], data == 0x20])  # places where a word begins
        depth = place - np.maximum.accumulate(np.where(begin, place, 0))
        last, before = np.full(len(place), -1), np.zeros(len(place), np.int32)
        inner = np.flatnonzero(going >= 0)
        inner = inner[np.argsort(depth[end[inner]], kind="stable")]
        level = np.searchsorted(depth[end[inner]], np.arange(1, int(depth.max()) + 2))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist()):
            at = inner[lo:hi]
            s, token = start[at], going[at]
            ok = self.merges.all_compatible(last[s], token) | begin[s]
            e = end[at][ok]
            last[e], before[e] = token[ok], before[s[ok]] + 1
        at = np.flatnonzero(ending >= 0)
        s = start[at]
        ok = self.merges.all_compatible(last[s], ending[at]) | begin[s]
        ended = np.zeros(len(place), np.int32)
        ended[end[at][ok]] = before[s[ok]] + 1
        return ended

    def _counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the code points of pieces that are lower-cased already and stay whole, one after the other, and how
        many code points each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = size > LONG // 4  # a code point has up to four bytes
        if long.any():
            long[long] = [len(words[i].encode()) > LONG for i in np.flatnonzero(long).tolist()]
        if long.any() and not long.all():
            out = np.zeros(int(size.sum()), np.int32)
            first = np.cumsum(size) - size
            for some in (long, ~long):
                out[ragged(first[some], size[some])] = self._counts([words[i] for i in np.flatnonzero(some).tolist()])[0]
            return out, size
        raw = " ".join(words).encode()
        data = np.frombuffer(raw, np.uint8)
        ended = self._ends(raw.decode("latin-1").translate(SPELLED_BUT_BLANK)) if long.any() else self._together(data)
        char_ends = (data != 0x20) & ((np.append(data[1:], 0x20) & 0xC0) != 0x80)
        return ended[1:][char_ends], size

    def _low(self, c: str) -> str:
        found = self._lowered.get(c)
        if found is None:
            found = self._lowered[c] = self.lower.normalize_str(c)
        return found

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        """Counts of words of any signs, through the tokenizer's own normal form, lower case and pieces."""
        whole: dict[str, int] = {}
        cut: list[str] = []

        def number(piece: str) -> int:
            if piece not in whole:
                whole[piece] = len(cut)
                cut.append(piece)
            return whole[piece]

        def plan(text: str) -> tuple[list, int]:
            """What the counts of a text without marks are made of: for each code point of its normal form, the pieces that
            end before it and the place in the piece that it cuts."""
            parts = [self._low(c) for c in self.normal.normalize_str(text)]
            s = "".join(parts)
            at: list[tuple] = [(0, -1, 0)] * (len(s) + 1)  # (whole pieces before, the piece that is cut, its letters)
            done: list[int] = []
            reach = 0
            for piece, (lo, hi) in self.split.pre_tokenize_str(s):
                at[reach : lo + 1] = [(len(done), -1, 0)] * (lo + 1 - reach)
                for k in range(1, hi - lo + 1):
                    if k < hi - lo and CONTRACTION.fullmatch(piece):
                        at[lo + k] = (len(done), [number(p) for p, _ in self.split.pre_tokenize_str(piece[:k])], 0)
                    else:
                        at[lo + k] = (len(done), number(piece), k)
                done.append(number(piece))
                reach = hi
            at[reach:] = [(len(done), -1, 0)] * (len(s) + 1 - reach)
            return [at[x] for x in np.cumsum([len(p) for p in parts]).tolist()], done

        plans = []
        for word in words:
            segments, lo = [], 0
            for m in self.marks.finditer(word) if self.marks else ():
                segments.append((plan(word[lo : m.end()]), len(self.normal.normalize_str(word[lo : m.start()]))))
                lo = m.end()
            segments.append((plan(word[lo:]), None))
            plans.append(segments)
        counts, sizes = self._counts(cut) if cut else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        first = np.cumsum(sizes) - sizes
        total = [int(counts[f + n - 1]) for f, n in zip(first.tolist(), sizes.tolist())]
        out = []
        for segments in plans:
            made, base = [], 0
            for (places, done), before in segments:
                sums = np.concatenate([[0], np.cumsum([total[d] for d in done])]).astype(np.int64)
                own = []
                for n, piece, k in places:
                    here = int(sums[n])
                    if isinstance(piece, list):
                        here += sum(total[p] for p in piece)
                    elif piece >= 0:
                        here += int(counts[first[piece] + k - 1])
                    own.append(here)
                if before is not None:  # a special string ends here: what stands before it, and one
                    own[-1] = (own[before - 1] if before else 0) + 1
                made += [base + x for x in own]
                base += own[-1] if own else 0
            out.append(np.array(made, np.int32))
        return out

    def _learn(self, words: list[str]) -> np.ndarray:
        """The places of new words among the remembered ones."""
        plain = [i for i, w in enumerate(words) if LETTERS.fullmatch(w)]
        odd = sorted(set(range(len(words))).difference(plain))
        parts, sizes = [], []
        for lo in range(0, len(plain), TOGETHER):
            # Lower case and normal form of these letters are one letter each.
            counts, n = self._counts([words[i].lower() for i in plain[lo : lo + TOGETHER]])
            parts.append(counts)
            sizes.append(n)
        made = self._odd([words[i] for i in odd])
        parts += made
        sizes = np.concatenate([*sizes, np.array([len(m) for m in made], np.int64)]).astype(np.int64)
        counts = np.concatenate([np.zeros(0, np.int32), *parts])
        begins = np.cumsum(sizes) - sizes
        steps = np.diff(counts, prepend=0)
        steps[begins[sizes > 0]] = counts[begins[sizes > 0]]
        places = np.empty(len(words), np.int64)
        places[[*plain, *odd]] = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(words))
        self.known.update(zip(words, places.tolist()))
        self.flat = np.concatenate([self.flat, steps])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return places

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text, by how much the count grows with each code point."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        words, n_words = pieces(texts, caseless(texts, self.starts_mark))
        each = words.dictionary_encode()
        distinct, codes = each.dictionary.to_pylist(), each.indices.to_numpy()
        if len(self.known) + len(distinct) > WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([distinct[i] for i in new.tolist()])
        first, size = self.starts[at][codes], (self.starts[at + 1] - self.starts[at])[codes]
        # Words stand behind the blanks and the words before them.
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = IS_BLANK[data]
        starts = np.flatnonzero(~blank)[np.frombuffer(words.buffers()[1], np.int64)[: len(words)]] if len(words) else np.zeros(0, np.int64)
        blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(size)])
        to = blanks[starts] + ends[:-1]
        word_of = np.concatenate([[0], np.cumsum(n_words)])
        begin = blanks[offsets] + ends[word_of]
        for i in range(len(texts)):
            grow = np.zeros(int(begin[i + 1] - begin[i]), np.int32)
            lo, hi = int(word_of[i]), int(word_of[i + 1])
            while lo < hi:
                # As many words as fill a chunk, at least one.
                end = min(hi, max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1))
                grow[ragged(to[lo:end] - begin[i], size[lo:end])] = self.flat[ragged(first[lo:end], size[lo:end])]
                lo = end
            yield grow


IS_BLANK = np.isin(np.arange(256), list(BLANKS))
UNSPELLED = {s: x for x, s in SPELLED.items()}
SPELLED_BUT_BLANK = {x: s for x, s in SPELLED.items() if x != 0x20}


@lru_cache(1)
def prefixes(path: str) -> Prefixes:
    """One for each worker process, so that its words outlast a task."""
    return Prefixes(path)


def packed(grow: np.ndarray) -> bytes:
    """A text's table: the width of a difference, and all of them, compressed."""
    kind = next(k for k in ("i1", "<i2", "<i4") if not len(grow) or np.iinfo(k).min <= grow.min() and grow.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(grow.astype(kind).tobytes(), 1)


def counts(data: bytes) -> np.ndarray:
    """The token counts of the prefixes of 0, 1, ... code points."""
    grow = np.frombuffer(zlib.decompress(data[1:]), f"<i{data[0]}")
    return np.concatenate([[0], np.cumsum(grow, dtype=np.int64)])


def within(found: np.ndarray, budget: int) -> int:
    """The code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(found <= budget)[-1]) if budget >= 0 else 0


def prefix_table(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_chars, prefixes): each text's size, the code points of its normal form, and its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = prefixes(tokenizer)
        for b in batches:
            tables, sizes = [], []
            for grow in count(b.column(1)):
                tables.append(packed(grow))
                sizes.append(len(grow))
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([b.column(0), n_bytes, pa.array(sizes, pa.int64()), pa.array(tables, pa.binary())], [key, "n_bytes", "n_chars", "prefixes"])

    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL("n_bytes bigint, n_chars bigint, prefixes binary")])
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def answers(tables: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fits_chars) from the stored tables: the whole text's count, whether it is over
    the budget, and the code points of its longest prefix within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, fits = [], []
            for data in b.column(2):
                found = counts(data.as_py())
                whole.append(int(found[-1]))
                fits.append(within(found, budget))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(whole, pa.int64()), pa.array([w > budget for w in whole], pa.bool_()), pa.array(fits, pa.int64())], [key, "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    schema = StructType([StructField(key, tables.schema[key].dataType), *StructType.fromDDL("n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint")])
    return tables.select(key, "n_bytes", "prefixes").mapInArrow(run, schema)


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it fits into the limit, from the stored counts of its prefixes."""
    import public_tokenizers

    with scratch(spark, "prefixes") as keep:
        tables = keep(prefix_table(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)), "tables")
        return store(answers(tables, LIMIT), "token-counts")
