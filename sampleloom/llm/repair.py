"""Token ids in Re-Pair grammar-compressed shards, with random access.

Documents are ordered by id over range partitions (the shards). Each task encodes its texts, gathers ids into blocks of
about ``BLOCK_TOKENS`` and compresses every block by Re-Pair: pairs of neighbouring symbols that occur most often become
nonterminals, round after round, until no pair is frequent (``LEAST`` and ``SHARE``; a rule costs as much as some six
occurrences save). A round replaces the pairs that are at least half as frequent as the most frequent one, up to ``PAIRS``;
pairs never reach over the end of a document. A block is a binary value with its rules,
the length of each rule's expansion, the symbols, and each document's first symbol and number of ids, so any document or
range of ids is decoded without the rest. Blocks are rows of a Parquet table, which makes writing safe against lost
executors.

Encoding works on words between ASCII blanks, each distinct one encoded once for a batch and remembered up to ``CACHE``
words, where the tokenizer's normaliser and pre-tokenizer are those of ``BY_WORD``, so that no piece reaches over a blank and
the ids are those of the whole text; other tokenizers encode whole texts. Null texts count as empty and give
the end id only. Null ids come first; equal ids are ordered by a hash of their text. Repeated rows are rows of their own.
An empty table gives an empty file. Ids are whole numbers of 64 bits; others are an error. Extra columns do not take part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, store, table

TOKENIZER = "word_bpe_49k.json"
END = 2
BLOCK_TOKENS = 1 << 19
#: Most pairs that a round replaces at once, and bits of the table that tells which pairs may be frequent.
PAIRS, SLOT_BITS = 4096, 18
#: A pair is frequent if it occurs so often, and at least once in so many ids of its block.
LEAST, SHARE = 8, 8192
CACHE = 1_000_000
MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIB")  # magic, first nonterminal, rules, symbols, documents, bytes of a symbol

#: Normalisers and pre-tokenizers that let no piece reach over ASCII white space, and lower-case ASCII (fixed values).
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Punctuation that may be cut off a word's end, behind a letter that has no special cases: a-z, A-Z, U+00C0-U+00FF but for
#: the two signs among them (fixed values).
TAIL = b".,!?;:|#$%&*()\"-_=+/\\[]{}@^~`<>"
#: Bytes of a tail; behind a longer one a word is cut within it or not at all, which changes no id.
MOST_TAIL = 64
#: Words of letters whose lower case and normal form are one letter each, and how byte-level models spell bytes: printable
#: ones as they are, the others from U+0100 on (fixed values).
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SPELLED = {x: chr(x) if x in _PRINTED else chr(0x100 + sum(y not in _PRINTED for y in range(x))) for x in range(256)}
#: Accents that join some small letter a-z in normal form C, but not its capital (fixed values: diaeresis, ring, caron,
#: macron below, diaeresis with acute).
SMALL_ONLY = "\u0308\u030a\u030c\u0331\u0344"
BLANKS = b"\t\n\v\f\r "
_BLANK, _TAIL, _LETTER = 1, 2, 3
_KINDS = bytes(_BLANK if x in BLANKS else _TAIL if x in TAIL else _LETTER if chr(x).isalpha() and x < 0x80 else 0 for x in range(256))
_LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


class Encoder:
    """Ids of texts by a public tokenizer: by words where ``BY_WORD`` describes it, else by whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        # Words are encoded many at a time, with a special token between them, which ends whatever stands before it.
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.by_word = (spec.get("normalizer"), spec.get("pre_tokenizer")) == BY_WORD and len(marks) == len(spec["added_tokens"]) > 0 and all(m[:2] == marks[0][:2] and m.isascii() and m == m.lower() and " " not in m for m in marks)
        self.mark = marks[0] if self.by_word else ""
        self.marked = self.tokenizer.token_to_id(self.mark) if self.by_word else None
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word &= bool(suffix)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_word:
            self.ends_word[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = Sequence([]), CharDelimiterSplit(SPELLED[0x20])
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.starts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def _encode(self, words: list[str]) -> np.ndarray:
        """The places of new words: those of ``LETTERS`` go to the model as they are, without normaliser and pre-tokenizer,
        which would leave them whole; others many at a time with marks between them; those that hold a mark's beginning alone."""
        plain = [i for i, w in enumerate(words) if LETTERS.fullmatch(w)]
        odd = [i for i, w in enumerate(words) if self.mark[:2] in w]
        rest = set(range(len(words))).difference(plain, odd)
        order, parts, sizes = [*plain, *sorted(rest), *odd], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [plain[i : i + 1024] for i in range(0, len(plain), 1024)]
        spelled = [" ".join([words[i] for i in g]).lower().encode().decode("latin-1").translate(SPELLED) for g in groups]
        for e in self.words.encode_batch_fast(spelled, add_special_tokens=False):
            parts.append(np.array(e.ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends_word[parts[-1]]), prepend=-1))
        if rest:
            many = [words[i] for i in sorted(rest)]
            groups = [many[i : i + 256] for i in range(0, len(many), 256)]
            ids = np.concatenate([np.array([*e.ids, self.marked], np.uint32) for e in self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.marked)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            parts.append(ids[ids != self.marked])
        for e in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False):
            parts.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        sizes = np.concatenate(sizes)
        assert len(sizes) == len(words)
        places = np.empty(len(words), np.int64)
        places[order] = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(words))
        self.known.update(zip(words, places.tolist()))
        self.flat = np.concatenate([self.flat, *parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return places

    def __call__(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by ``end``, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word or not len(texts):
            return self._whole(texts, end)
        words, n_words = pieces(texts, caseless(texts, {self.mark[:2]}))
        each = words.dictionary_encode()
        distinct, codes = each.dictionary.to_pylist(), each.indices.to_numpy()
        if len(self.known) + len(distinct) > CACHE:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        at[new] = self._encode([distinct[i] for i in new.tolist()])
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        # The end of a text is a word of its own, taken from one more place.
        word_ends = np.cumsum(n_words + 1) - 1
        inside = np.ones(len(codes) + len(n_words), bool)
        inside[word_ends] = False
        starts, sizes = np.full(len(inside), len(self.flat), np.int64), np.ones(len(inside), np.int64)
        starts[inside], sizes[inside] = first[codes], size[codes]
        ids = np.append(self.flat, np.uint32(end))[ragged(starts, sizes)]
        return ids, np.diff(np.cumsum(sizes)[word_ends], prepend=0)


def caseless(texts: pa.Array, marks: set[str]) -> bool:
    """Whether A-Z may be lower-cased before anything else in all texts: none holds a special token's beginning or an accent
    of ``SMALL_ONLY``."""
    return not any(pc.any(pc.match_substring(texts, m)).as_py() for m in {*marks, *SMALL_ONLY})


def pieces(texts: pa.Array, unmarked: bool) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII blanks, and how many each text has. In texts without marks, A-Z are lower-cased, and
    ``TAIL`` at a word's end behind a letter of ``STEM_ENDS`` is a word of its own: the tokenizer does both, too."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
    data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    blank = kind == _BLANK
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    begins[first], ends[last] = ~blank[first], ~blank[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n_pieces = np.ones(len(start), np.int64)
    if unmarked:
        tail, long = np.zeros(len(start), np.int64), np.flatnonzero(kind[end - 1] == _TAIL) if len(end) else start
        while len(long) and tail[long[0]] < MOST_TAIL:
            tail[long] += 1
            long = long[end[long] - tail[long] > start[long]]
            long = long[kind[end[long] - tail[long] - 1] == _TAIL]
        stem = end - tail  # behind the last place before the tail
        cut = (tail > 0) & (stem > start)
        x = stem[cut] - 1
        y = data[x]
        cut[cut] = (kind[x] == _LETTER) | (y >= 0x80) & (y < 0xC0) & (y != 0x97) & (y != 0xB7) & (data[x - 1] == 0xC3)
        n_pieces[cut] = 2
    at = np.cumsum(n_pieces) - n_pieces
    size = np.zeros(int(n_pieces.sum()), np.int64)
    size[at] = end - start
    if unmarked:
        size[at[cut]] = stem[cut] - start[cut]
        size[at[cut] + 1] = tail[cut]
    kept = raw.translate(_LOWER if unmarked else None, BLANKS)
    bounds = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words, np.diff(np.concatenate([[0], np.cumsum(n_pieces)])[np.searchsorted(start, offsets)])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its words outlast a task."""
    return Encoder(path)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + size[i] - 1 of all i, one after the other."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def grammar(ids: np.ndarray, sizes: np.ndarray, base: int, pairs: int = PAIRS, least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs), the length of each one's expansion, the symbols, and the number of symbols of each document.

    With ``pairs`` 1 a round replaces the most frequent pair (of equal ones the least), as Re-Pair does; with more, all
    pairs that are at least half as frequent, up to so many. Where occurrences overlap, the more frequent pair has it; of
    one pair's, every other one from the left. ``least`` is the number of occurrences from which a pair is frequent.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.ones(base, np.int64)
    least = max(LEAST, len(symbols) // SHARE) if least is None else least

    def slots_of(at: np.ndarray) -> np.ndarray:
        """The slots of the pairs that begin at these places; pairs over a document's end share the last one."""
        mixed = (symbols[at] * np.uint32(0x9E3779B1) ^ symbols[at + 1] * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)
        return np.where(last[at], np.uint32(1 << SLOT_BITS), mixed)

    in_slots = lambda slots: np.bincount(slots, minlength=(1 << SLOT_BITS) + 1)
    slot = slots_of(np.arange(max(0, len(symbols) - 1)))
    count = in_slots(slot)
    while len(symbols) > 1:
        count[-1] = 0
        # Pairs share slots: the likely ones are counted one by one, until none outside them can be more frequent.
        floor = max(least, int(count.max()) // 2)
        while True:
            where = np.flatnonzero((count >= floor)[slot])
            code, number, times = np.unique(symbols[where].astype(np.uint64) << np.uint64(32) | symbols[where + 1], return_inverse=True, return_counts=True)
            most = int(times.max(initial=0))
            if most >= floor or floor == least:
                break
            floor = max(least, most)
        if most < least:
            break
        best = np.argsort(-times, kind="stable")[:pairs]
        best = best[times[best] >= max(least, most // 2)]
        while True:
            rank = np.full(len(code), len(code))
            rank[best] = np.arange(len(best))
            place, rule = where[rank[number] < len(best)], rank[number][rank[number] < len(best)]
            near = np.diff(place) == 1
            beaten = np.zeros(len(place), bool)
            beaten[1:] = near & (rule[:-1] < rule[1:])
            beaten[:-1] |= near & (rule[1:] < rule[:-1])
            place, rule = place[~beaten], rule[~beaten]
            run = np.concatenate([[True], np.diff(place) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            take = (np.arange(len(place)) - start) % 2 == 0
            place, rule = place[take], rule[take]
            # Rules whose pairs went to others mostly are left for a later round.
            used = np.bincount(rule, minlength=len(best)) >= max(1, least // 2)
            if used.all() or len(best) == 1:
                break
            best = best[used] if used.any() else best[:1]
        # Only pairs that touch a replaced one change; two may touch the same pair between them.
        apart = np.concatenate([[True], np.diff(place) > 2])
        gone = np.concatenate([place, place + 1, (place - 1)[apart]])
        count -= in_slots(slot[gone[(gone >= 0) & (gone < len(slot))]])
        symbols[place] = (base + sum(map(len, rules)) + rule).astype(np.uint32)
        last[place] = last[place + 1]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        keep = np.flatnonzero(keep)
        symbols, last, slot = symbols[keep], last[keep], slot[keep[:-1]]
        place = place - np.arange(len(place))
        new = np.concatenate([place, (place - 1)[apart]])
        new = new[(new >= 0) & (new < len(slot))]
        slot[new] = slots_of(new)
        count += in_slots(slot[new])
        made = np.stack([code[best] >> np.uint64(32), code[best] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(made)
        lengths = np.concatenate([lengths, lengths[made].sum(1)])
    ends = np.flatnonzero(last) + 1
    counts = np.zeros(len(sizes), np.int64)
    counts[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    return np.concatenate(rules), lengths[base:].astype(np.uint32), symbols, counts


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block of documents' ids; ``sizes`` says how many belong to each document, in order."""
    base = int(ids.max(initial=0)) + 1
    rules, lengths, symbols, counts = grammar(ids, sizes, base)
    kind = np.dtype("<u2" if base + len(rules) <= 1 << 16 else "<u4")
    head = _HEAD.pack(MAGIC, base, len(rules), len(symbols), len(sizes), kind.itemsize)
    parts = [rules.astype("<u4"), lengths.astype("<u4"), symbols.astype(kind), counts.astype("<u4"), sizes.astype("<u4")]
    return head + zlib.crc32(b"".join(p.tobytes() for p in parts)).to_bytes(4, "little") + b"".join(p.tobytes() for p in parts)


class Block:
    """Reads a packed block: all ids, one document's, or any range."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n_symbols, n_docs, width = _HEAD.unpack_from(data)
        at = _HEAD.size + 4
        if magic != MAGIC or zlib.crc32(data[at:]) != int.from_bytes(data[_HEAD.size : at], "little"):
            raise ValueError("not a sound block of token ids")

        def take(n, kind):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2)
        self.lengths = take(n_rules, "<u4")
        self.symbols = take(n_symbols, f"<u{width}").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(take(n_docs, "<u4"), dtype=np.int64)])
        self.sizes = take(n_docs, "<u4").astype(np.int64)
        self._whole = None

    def _sizes_of(self, symbols: np.ndarray) -> np.ndarray:
        table_ = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        return table_[symbols]

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all symbols one after the other, and where each begins; a rule's parts come before it."""
        if self._whole is None:
            size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
            first = np.cumsum(size) - size
            flat = np.arange(int(size.sum()), dtype=np.uint32)
            level = [0] * len(size)
            for i, (a, b) in enumerate(self.rules.tolist(), self.base):
                level[i] = 1 + max(level[a], level[b])
            level = np.array(level[self.base :], np.int64)
            for k in range(1, int(level.max(initial=0)) + 1):
                made = np.flatnonzero(level == k)
                a, b = self.rules[made].T
                at = first[self.base + made]
                flat[ragged(at, size[a])] = flat[ragged(first[a], size[a])]
                flat[ragged(at + size[a], size[b])] = flat[ragged(first[b], size[b])]
            self._whole = flat, first
        return self._whole

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self._expansions()
        return flat[ragged(first[symbols], self._sizes_of(symbols))]

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.first[i] : self.first[i + 1]])

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi - 1 of the block; expansion lengths find the symbols that hold them."""
        ends = np.cumsum(self._sizes_of(self.symbols))
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        skipped = ends[a - 1] if a else 0
        return self._expand(self.symbols[a:b])[lo - skipped : hi - skipped]


def write(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the blocks of all documents and returns their table: (shard, block, start, n_tokens, ids, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush():
            nonlocal block, start, n_held
            keys, ids, sizes = [k for h in held for k in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            row = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([pack(ids, sizes)], pa.binary())], ["shard", "block", "start", "n_tokens", "ids", "data"])
            block, start, n_held = block + 1, start + len(ids), 0
            return row

        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes = encode(b.column(1), end)
            ends = np.cumsum(sizes)
            keys, lo = b.column(0).to_pylist(), 0
            while lo < len(keys):  # as many documents as fill the block, at least one
                before = ends[lo - 1] if lo else 0
                hi = min(len(keys), int(np.searchsorted(ends, before + block_tokens - n_held)) + 1)
                held.append((keys[lo:hi], ids[before : ends[hi - 1]], sizes[lo:hi]))
                n_held += int(ends[hi - 1] - before)
                lo = hi
                if n_held >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    # Rows of one id, even equal ones, are ranges of their own by a number that only deals them.
    slim = docs.select(F.col(key).cast("bigint").alias("key"), "text", F.monotonically_increasing_id().alias("deal"))
    ordered = slim.repartitionByRange("key", F.xxhash64("text"), "deal").sortWithinPartitions("key", F.xxhash64("text")).select("key", "text")
    return store(ordered.mapInArrow(run, "shard int, block int, start bigint, n_tokens bigint, ids array<bigint>, data binary"), "token-ids", path)


def read(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, block_bytes) of every document in the blocks' table, from the stored bytes."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each task that wrote
    before = np.cumsum([0, *(r.n for r in totals)]).tolist()
    offsets = {r.shard: n for r, n in zip(totals, before)}
    shared = blocks.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, start, keys, data = (b.column(c)[i].as_py() for c in range(4))
                block = Block(data)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.sizes)
                first = ends - block.sizes
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(first.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(first + start + shared.value[shard]), pa.array(block.sizes), pa.array(crc, pa.int64()), pa.array(np.full(len(keys), len(data)))], ["key", "start", "n_tokens", "ids_crc32", "block_bytes"])

    return blocks.select("shard", "start", "ids", "data").mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, block_bytes bigint").withColumnRenamed("key", key)


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as compressed shards and read back."""
    import public_tokenizers

    small_batches(spark)
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))
