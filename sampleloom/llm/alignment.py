"""Alignment of two tokenizers' tokens, and how often each pair of ids ends together in the whole corpus.

Tokenizer A (byte-level, a ``tokenizers`` file) reads a space and the text, tokenizer B (a ``sentencepiece`` model) the text,
before which it puts a space itself. Byte offsets where tokens of both end cut the tokens into groups, and the last tokens
of a group are linked. A group of one token each has the same bytes on both sides, so its B id is that of an *identity
map*, made once from the vocabularies: such links are counted in a vector as long as A's vocabulary. Only links of other
groups enter the shuffle that counts pairs, added up within each task first.

Tokenizing works on units, each distinct one once: a unit begins at a single space between signs that are no white space.
No token of A begins before such a space and ends behind it, and no piece of B does if no piece of the model holds a space
behind another sign; where the tokenizers are not of this form a unit is a whole text.

Counts return to the documents in two ways. The ``FREQUENT`` most frequent pairs go to all tasks; they are the only ones
that many documents can share. Links of rarer pairs are joined with their counts by a shuffle, in which no pair has more
than one in ``FREQUENT`` of all links. Nothing is left out on either way.

Texts that are null, empty or not reproduced by both tokenizers (one that holds U+2581, say) have no tokens: zeros and an
empty digest. Keys of any type, null and repeated ones pass through, a row for each document. Ties are all best. Extra
columns do not take part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
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

from .common import free_name, scratch, store, table
from .repair import SPELLED, ragged

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts go to all tasks.
FREQUENT = 1 << 17
#: Units that a worker remembers, bytes that are tokenized at once, and distinct pairs that a task holds.
UNITS, TOGETHER, HELD = 400_000, 1 << 14, 1 << 20
#: How A must split texts for units to be apart (fixed values).
BY_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPACE = "▁"


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    return np.array([any(lo <= x <= hi for lo, hi in ranges) for x in range(256)])


#: First bytes of signs that are surely no white space, and second bytes and first bytes of such signs of two bytes; white
#: space begins with C2, E1, E2 or E3 beyond ASCII (fixed values).
_BEHIND = _class((0x21, 0x7F), (0xC3, 0xE0), (0xE4, 0xF4))
_ASCII, _SECOND, _FIRST = _class((0x21, 0x7F)), _class((0x80, 0xBF)), _class((0xC3, 0xDF))


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie one after the other and begin at ``begins``."""
    n = len(data)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at + 1 < n)]
    # Signs of other texts are seen here, too; texts begin anyway.
    before = _ASCII[data[at - 1]] | _SECOND[data[at - 1]] & (at > 1) & _FIRST[data[np.maximum(at - 2, 0)]]
    return np.union1d(begins, at[before & _BEHIND[data[at + 1]]])


class Aligner:
    """Tokens, groups and links of texts under two tokenizers. A link is a code: below ``self.a`` an id of A and the id of B
    of the same bytes, else ``self.a`` + id of A times ``self.b`` + id of B."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        spec = json.loads(Path(path_a).read_text(encoding="utf-8"))
        self.first = Tokenizer.from_file(path_a)
        self.first.no_padding()
        self.first.no_truncation()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a, self.b = self.first.get_vocab_size(), self.second.get_piece_size()
        unspelled = {s: x for x, s in SPELLED.items()}
        of_a = [b""] * self.a
        for text, i in spec["model"]["vocab"].items():
            of_a[i] = bytes(unspelled[c] for c in text)
        of_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else b"" if self.second.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.second.id_to_piece, range(self.b)))]
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(Path(path_b).read_bytes())
        normal = model.normalizer_spec
        pieces = [p for p in map(self.second.id_to_piece, range(self.b)) if SPACE in p.lstrip(SPACE)]
        self.by_unit = spec.get("normalizer") is None and spec.get("pre_tokenizer") == BY_SPACE and normal.name == "identity" and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and not pieces
        self.bytes_a, self.bytes_b = _Bytes(of_a), _Bytes(of_b)
        # Among B ids of the same bytes, whole pieces come before single bytes.
        plain = {x: i for i, x in reversed(list(enumerate(of_b))) if x}
        plain |= {x: i for i, x in reversed(list(enumerate(of_b))) if x and not self.second.is_byte(i)}
        self.same = np.array([plain.get(x, -1) if x else -1 for x in of_a])
        self.written = [[f"{i}{s}" for i in range(max(self.a, self.b))] for s in ",|;"]
        self._forget()

    def _forget(self) -> None:
        self.known, self.strings = {}, []
        self.numbers, self.links, self.starts = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _tokens(self, units: list[str]) -> tuple[list, list]:
        """The ids of texts that are one or many units each."""
        one = [e.ids for e in self.first.encode_batch_fast(units, add_special_tokens=False)]
        return one, self.second.encode([u[1:] for u in units], num_threads=1)

    def _learn(self, units: list[str]) -> np.ndarray:
        """The places of new units among the remembered ones. Units of signs that are no white space, after their space,
        are tokenized many at a time: between them the cuts are the same."""
        raw = [u.encode() for u in units]
        joins = [self.by_unit and len(r) > 1 and bool(_BEHIND[r[1]]) and bool(_ASCII[r[-1]] or len(r) > 2 and _SECOND[r[-1]] and _FIRST[r[-2]]) for r in raw]
        order = sorted(range(len(units)), key=joins.__getitem__)
        n_alone = len(units) - sum(joins)
        size = np.array([len(raw[i]) for i in order], np.int64)
        part = np.concatenate([np.arange(n_alone), n_alone + np.cumsum(size[n_alone:]) // TOGETHER]) if len(order) else size
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(order)]
        texts = ["".join([units[i] for i in order[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        one, two = self._tokens(texts)
        # A text that a tokenizer does not reproduce is cut into its units, of which each stands for itself.
        ids: list[list] = [[], []]
        sound = np.ones(len(order), bool)
        for text, a, b, lo, hi in zip(texts, one, two, cuts[:-1], cuts[1:]):
            want = text.encode()
            if self.bytes_a.joined(a) != want or self.bytes_b.joined(b) != want:
                a, b = [], []
                for k in range(lo, hi):
                    (x,), (y,) = self._tokens([units[order[k]]])
                    sound[k] = self.bytes_a.joined(x) == self.bytes_b.joined(y) == raw[order[k]]
                    if sound[k]:
                        a += x
                        b += y
            ids[0] += a
            ids[1] += b
        size = np.where(sound, size, 0)
        places = np.empty(len(units), np.int64)
        places[order] = np.arange(len(self.strings), len(self.strings) + len(units))
        self._keep(np.array(ids[0], np.int64), np.array(ids[1], np.int64), size, sound)
        self.known.update(zip(units, places.tolist()))
        return places

    def _keep(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, sound: np.ndarray) -> None:
        """Groups and links of units of ``size`` bytes, from their tokens one after the other."""
        end_a, end_b, end = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b]), np.cumsum(size)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        x, y = a[last_a], b[last_b]
        links = np.where(alone & (self.same[x] == y), x, self.a + x * self.b + y)
        upto = lambda ends: np.diff(np.searchsorted(ends, end, "right"), prepend=0)
        n_links = upto(common)
        # A's tokens of a group, then B's, each with the sign behind it.
        group = np.concatenate([np.searchsorted(common, end_a), np.searchsorted(common, end_b)])
        sign = np.zeros(len(group), np.int64)
        sign[last_a], sign[len(a) + last_b] = 1, 2
        order = np.argsort(group * 2 + (np.arange(len(group)) >= len(a)), kind="stable")
        words = [self.written[s][i] for s, i in zip(sign[order].tolist(), np.concatenate([a, b])[order].tolist())]
        cuts = np.concatenate([[0], np.cumsum(upto(end_a) + upto(end_b))]).tolist()
        self.strings += ["".join(words[lo:hi])[:-1] for lo, hi in zip(cuts[:-1], cuts[1:])]
        self.numbers = np.concatenate([self.numbers, np.stack([upto(end_a), upto(end_b), n_links, ~sound], 1)])
        self.links = np.concatenate([self.links, links])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """(tokens of A, tokens of B, groups) of each text, its groups in writing, and the codes of its links."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros((0, 3), np.int64), [], []
        some = pc.binary_length(texts).to_numpy() > 0
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        texts = pc.binary_join_element_wise(blank, texts, none)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = unit_starts(np.frombuffer(data, np.uint8), offsets[:-1]) if self.by_unit else offsets[:-1]
        bounds = np.append(starts, offsets[-1]).astype(np.int64)
        each = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct, codes = each.dictionary.to_pylist(), each.indices.to_numpy()
        if len(self.known) + len(distinct) > UNITS:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([distinct[i] for i in new.tolist()])
        units = at[codes]
        first = np.searchsorted(starts, offsets)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[units], 0)])
        sums = sums[first[1:]] - sums[first[:-1]]
        some &= sums[:, 3] == 0
        numbers = np.where(some[:, None], sums[:, :3], 0)
        begin, size = self.starts[units], self.starts[units + 1] - self.starts[units]
        written, links, strings, listed = [], [], self.strings, units.tolist()
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            written.append(";".join([strings[u] for u in listed[lo:hi]]) if some[k] else "")
            links.append(self.links[ragged(begin[lo:hi], size[lo:hi])] if some[k] else self.links[:0])
        return numbers, written, links


class _Bytes:
    """The bytes of ids, one after the other."""

    def __init__(self, of: list[bytes]):
        self.size = np.array([len(x) for x in of], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(of), np.uint8)

    def joined(self, ids: list[int]) -> bytes:
        i = np.array(ids, np.int64)
        return self.flat[ragged(self.first[i], self.size[i])].tobytes() if len(i) else b""


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, so that its units outlast a task."""
    return Aligner(path_a, path_b)


def group_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups): every document's groups, written as ``a1,a2|b1;a3|b2,b3`` in ids of A and B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(align(b.column(1))[1], pa.string())], [key, "groups"])

    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL("groups string")])
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def group_rows(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, a, b): a row for each group of each document, with its place and its ids on both sides."""
    split = group_texts(docs, path_a, path_b, key, text).where("groups <> ''").select(key, F.posexplode(F.split("groups", ";")).alias("at", "_g"))
    ids = lambda k: F.split(F.split("_g", "[|]")[k], ",").cast("array<int>")
    return split.select(key, "at", ids(0).alias("a"), ids(1).alias("b"))


def _linked(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """A row for each document with its numbers and links, and rows of each task's sums: ``part`` 0, 1 for identity links,
    2 for others. Sums are written with the rows, so a task that runs again counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        same = np.zeros(align.a, np.int64)
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums(part: int, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(code), 1 << 16):
                row = {"part": part, "codes": code[lo : lo + (1 << 16)], "times": n[lo : lo + (1 << 16)]}
                yield pa.record_batch([pa.array([row[c]] if c in row else [None], t) for c, t in zip(names, types)], names)

        for b in batches:
            if not b.num_rows:
                continue
            numbers, written, links = align(b.column(2))
            flat = np.concatenate(links)
            same += np.bincount(flat[flat < align.a], minlength=align.a)
            code, n = np.unique(flat[flat >= align.a], return_counts=True)
            codes, number = np.unique(np.concatenate([codes, code]), return_inverse=True)
            times = np.bincount(number, np.concatenate([times, n]), len(codes)).astype(np.int64)
            if len(codes) > HELD:
                yield from sums(2, codes, times)
                codes, times = codes[:0], times[:0]
            kind = np.uint32 if align.a * (align.b + 1) < 1 << 32 else np.int64
            columns = [
                pa.array(np.zeros(b.num_rows, np.int8)), b.column(0), b.column(1), *map(pa.array, numbers.T),
                pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written], pa.string()),
                pa.array([x.astype(kind).tobytes() for x in links], pa.binary()),
            ]
            yield pa.record_batch([*columns, *(pa.nulls(b.num_rows, t) for t in types[-2:])], names)
        used = np.flatnonzero(same)
        yield from sums(1, used, same[used])
        yield from sums(2, codes, times)

    fields = StructType([*StructType.fromDDL("part tinyint, rid bigint").fields, StructField("key", docs.schema[key].dataType), *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, codes array<bigint>, times array<bigint>").fields])
    from pyspark.sql.pandas.types import to_arrow_type

    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, fields)


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document, stored: tokens, groups, links,
    links whose pair is the most frequent one of its B id in the corpus, and the corpus counts of all links added up."""
    model = aligner(path_a, path_b)
    a, b, kind = model.a, model.b, np.uint32 if model.a * (model.b + 1) < 1 << 32 else np.int64
    key_name = free_name(["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rid"], key)
    with scratch(docs.sparkSession, "alignment") as keep:
        linked = keep(_linked(docs, path_a, path_b, key, text), "links")
        sums = lambda part: linked.where(F.col("part") == part).select(F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("n"))
        same = np.zeros(a, np.int64)
        for r in sums(1).collect():  # a row for each id of A at most
            same[r.code] = r.n
        pairs = keep(sums(2), "pairs")
        best = np.zeros(b, np.int64)
        for r in pairs.groupBy(((F.col("code") - a) % b).alias("b")).agg(F.max("n").alias("n")).collect():  # a row for each id of B at most
            best[r.b] = r.n
        np.maximum.at(best, model.same[same > 0], same[same > 0])
        top = pairs.orderBy(F.desc("n"), "code").limit(frequent).toArrow().sort_by("code")
        codes, times = (top.column(c).to_numpy() for c in ("code", "n"))
        is_top = lambda code, n: n == best[(code - a) % b]
        shared = docs.sparkSession.sparkContext.broadcast((same, same == best[model.same], codes, times, is_top(codes, times)))

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            same, same_top, codes, times, top = shared.value
            for x in batches:
                held = [np.frombuffer(v.as_py(), kind).astype(np.int64) for v in x.column(5)]
                sizes = np.array([len(v) for v in held], np.int64)
                flat = np.concatenate([np.zeros(0, np.int64), *held])
                at = np.minimum(np.searchsorted(codes, flat), max(0, len(codes) - 1))
                known = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
                n, good = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
                n[known], good[known] = times[at[known]], top[at[known]]
                one = flat < a
                n[one], good[one] = same[flat[one]], same_top[flat[one]]
                run = np.concatenate([[0], np.cumsum(sizes)])
                total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[run])
                rest = [r.tolist() for r in np.split(flat[~(known | one)], np.cumsum(total(~(known | one)))[:-1])] if len(held) else []
                yield pa.record_batch([*(x.column(i) for i in range(5)), pa.array(sizes), pa.array(total(good)), pa.array(total(n)), x.column(6), pa.array([r or None for r in rest], pa.list_(pa.int64()))], names)

        fields = StructType([*StructType.fromDDL("rid bigint").fields, StructField(key_name, docs.schema[key].dataType), *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rest array<bigint>").fields])
        names = fields.names
        rows = linked.where("part = 0").select("rid", "key", "n_a", "n_b", "n_groups", "links", "groups_sha256").mapInArrow(back, fields)
        wanted = [F.col(key_name).alias(key), *names[2:-1]]
        if pairs.count() <= frequent:
            return store(rows.select(*wanted), "aligned")
        rows = keep(rows, "rows")
        # The rarer pairs. ``best`` is as long as B's vocabulary.
        tops = F.broadcast(docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best.tolist()) if n], "b int, most bigint"))
        counted = pairs.join(tops, ((F.col("code") - a) % b).cast("int") == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).cast("int").alias("good"))
        links = rows.select("rid", F.explode("rest").alias("code")).groupBy("rid", "code").agg(F.count(F.lit(1)).alias("m"))
        added = links.join(counted, "code").groupBy("rid").agg(F.sum(F.col("n") * F.col("m")).alias("_n"), F.sum(F.col("good") * F.col("m")).alias("_good"))
        more = {"n_best": "_good", "count_sum": "_n"}
        return store(rows.join(added, "rid", "left").select(wanted[0], *((F.col(c) + F.coalesce(more[c], F.lit(0))).alias(c) if c in more else c for c in names[2:-1])), "aligned")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under both tokenizers, its groups, and the corpus counts of its links."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, (TOKENIZER_A, TOKENIZER_B)))
