"""Alignment of two tokenizers against whole texts encoded by the libraries and groups cut one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sampleloom.llm import alignment as al
from sampleloom.llm.repair import SPELLED

A, B = (public_tokenizers.path(n) for n in (al.TOKENIZER_A, al.TOKENIZER_B))
PARTS = ["don't", "IT'S", "<|endoftext|>", "<s>", "<0x41>", "é", "é", "ß", "ﬁ", "你好", "👍🏽", "가", "\x00", "\x1f", "\u0085", " ", "　", "’s", "“a”", "12", "3456", "!!", "...", '"', "Interesting", "antidisestablishmentarianism", "ça", "\n", "\t", "  ", "   ", "_a_b", "http://x.y/z?q=1"]
TEXTS = [None, "", " ", "  ", "a", "a b", " a b ", "a  b   c", "a\n b", "a \nb", "one\t two", "x▁y", "x ▁ y", "a \xa0b", "a é b à c", "Hello, world.", "end \n\n start", "a" * 3000, "ab " * 2000, "’ ’ “x” y"]


@pytest.fixture(scope="module")
def brute():
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    unspelled = {s: x for x, s in SPELLED.items()}
    of_a = {i: bytes(unspelled[c] for c in t) for t, i in first.get_vocab().items() if i != 50256}

    def of_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        whole = (" " + text).encode()
        if b"".join(of_a[i] for i in a) != whole or b"".join(map(of_b, b)) != whole:
            return []
        ends = lambda ids, of: [sum(len(of(i)) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 300 else _sums([len(of(i)) for i in ids])
        at_a, at_b = dict(zip(ends(a, of_a.get), range(len(a)))), dict(zip(ends(b, of_b), range(len(b))))
        out, lo_a, lo_b = [], 0, 0
        for e in sorted(at_a.keys() & at_b.keys()):
            out.append((a[lo_a : at_a[e] + 1], b[lo_b : at_b[e] + 1]))
            lo_a, lo_b = at_a[e] + 1, at_b[e] + 1
        return out

    return groups


def _sums(sizes):
    out = []
    for s in sizes:
        out.append(s + (out[-1] if out else 0))
    return out


def written(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def odd_texts(n, seed):
    rng = random.Random(seed)
    odd = lambda: chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x300, 0x3FF), rng.randint(0x1600, 0x30FF)]))
    return ["".join((rng.choice(PARTS) if rng.random() < 0.8 else odd()) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def whole_result(brute, rows):
    """The contract's columns, by counting all links first."""
    made = [brute(t) for _, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for groups in made for g in groups)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), groups in zip(rows, made):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        w = written(groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(w.encode()).hexdigest() if w else ""))
    return sorted(out, key=str)


def test_groups_are_those_of_whole_texts(brute, monkeypatch):
    align = al.Aligner(A, B)
    assert align.by_unit
    texts = TEXTS + odd_texts(500, 1)
    for part in (texts, texts[:7], texts[::-1]):
        numbers, strings, links = align(pa.array(part, pa.string()))
        for t, n, s, link in zip(part, numbers.tolist(), strings, links):
            want = brute(t)
            assert s == written(want), repr(t)
            assert n == [sum(len(g[0]) for g in want), sum(len(g[1]) for g in want), len(want)] and len(link) == len(want)
            for code, (a, b) in zip(link.tolist(), want):
                assert (code, align.same[code]) == (a[0], b[0]) if code < align.a else divmod(code - align.a, align.b) == (a[-1], b[-1])
                assert code >= align.a or len(a) == len(b) == 1
    monkeypatch.setattr(al, "UNITS", 3)
    for t in texts[:60]:
        assert align(pa.array([t], pa.string()))[1] == [written(brute(t))]


def test_texts_as_units_give_the_same(brute):
    align = al.Aligner(A, B)
    align.by_unit = False
    texts = TEXTS + odd_texts(80, 2)
    assert align(pa.array(texts, pa.string()))[1] == [written(brute(t)) for t in texts]


def test_the_identity_map_holds_equal_bytes():
    align = al.Aligner(A, B)
    for a in range(0, align.a, 7):
        if align.same[a] >= 0:
            assert align.bytes_a.joined([a]) == align.bytes_b.joined([int(align.same[a])])
    assert (align.same >= 0).sum() > 10_000


@pytest.mark.parametrize("frequent", [0, 5, al.FREQUENT])
def test_counts_of_the_whole_corpus(spark, brute, frequent):
    rows = [(i % 90, t) for i, t in enumerate(TEXTS + odd_texts(120, 3) * 2)] + [(None, "a b"), (7, "Interesting times"), (7, "Interesting times")]
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id bigint, text string, n_a int, links string").repartition(5)
    found = al.align(frame, A, B, frequent=frequent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == whole_result(brute, rows)


def test_sums_that_do_not_fit_a_task(spark, brute, monkeypatch):
    monkeypatch.setattr(al, "HELD", 10)
    rows = [(i, t) for i, t in enumerate(TEXTS + odd_texts(60, 4))]
    found = al.align(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), A, B)
    assert sorted((tuple(r) for r in found.collect()), key=str) == whole_result(brute, rows)


def test_query_groups_as_rows_and_empty_tables(spark, brute, tmp_path):
    rows = [("a", "Hello there, élan"), ("b", None), ("c", "x▁y")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in al.op12_alignment(spark, str(tmp_path)).collect()), key=str) == whole_result(brute, rows)
    got = al.group_rows(frame, A, B).orderBy("at").collect()
    assert [(r.doc_id, r.a, r.b) for r in got] == [("a", a, b) for a, b in brute(rows[0][1])]
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert al.op12_alignment(spark, f"{tmp_path}/none").collect() == []
