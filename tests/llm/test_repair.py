import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sampleloom.llm import repair as rp

PATH = public_tokenizers.path(rp.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def want(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = ["", " ", "Hello, world. it's 'so' DON'T!? a|b | c||", "x y z\x0bq\x1cw", "İ, İ. ß. É, é, e,́ x", "<|endoftext|>, <|startoftext|> a<|endoftext|>b.", "1.5, 22; (a), 'a', a', 'll. we'll, ,,, a.,", "漢字、テスト。 Ж. ж, ", "a" * 5000, "tab\tnew\nline\r\nend.", None, "ends with,", "'s, 't. x's. ''s", "ſ. K, Å.", "J\u030c H\u0331x T\u0344", "W\u030a Y\u030a. T\u0308"]


def test_ids_are_those_of_the_whole_text(tokenizer):
    encode, rng = rp.Encoder(PATH), random.Random(3)
    texts = TEXTS + ["".join(rng.choices("aB.,'! \n\t|é́İs1<>|", k=40)) for _ in range(800)]
    for part in (texts, texts[:5], texts[::-1]):
        ids, sizes = encode(pa.array(part, pa.string()))
        ends = np.cumsum(sizes)
        for t, a, e in zip(part, ends - sizes, ends):
            assert ids[a:e].tolist() == want(tokenizer, t), t


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(rp, "CACHE", 3)
    encode = rp.Encoder(PATH)
    for t in ("a b c d", "c d e", "a"):
        assert encode(pa.array([t]))[0].tolist() == want(tokenizer, t)


def test_another_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tokenizer = rp.Encoder(path), Tokenizer.from_file(path)
    assert not encode.by_word and rp.Encoder(PATH).by_word
    ids, sizes = encode(pa.array(TEXTS, pa.string()))
    ends = np.cumsum(sizes)
    for t, a, e in zip(TEXTS, ends - sizes, ends):
        assert ids[a:e].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert encode(pa.array([], pa.string()))[0].tolist() == []


def plain_repair(docs, base, least):
    """Re-Pair by the book: the most frequent pair, of equal ones the least, becomes a symbol, from left to right."""
    docs, rules = [list(d) for d in docs], []
    while True:
        count = {}
        for d in docs:
            for p in zip(d, d[1:]):
                count[p] = count.get(p, 0) + 1
        pair = min(count, key=lambda p: (-count[p], p), default=None)
        if pair is None or count[pair] < least:
            return rules, [x for d in docs for x in d]
        for d in docs:
            i = 0
            while i < len(d) - 1:
                if (d[i], d[i + 1]) == pair:
                    d[i : i + 2] = [base + len(rules)]
                i += 1
        rules.append(pair)


@pytest.mark.parametrize("alphabet", [2, 7, 40])
def test_one_pair_a_round_is_re_pair(alphabet):
    rng = np.random.default_rng(alphabet)
    docs = [rng.integers(0, alphabet, rng.integers(0, 90)).astype(np.uint32) for _ in range(20)]
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    for least in (2, 5):
        rules, lengths, symbols, counts = rp.grammar(ids, sizes, alphabet, pairs=1, least=least)
        want_rules, want_symbols = plain_repair([d.tolist() for d in docs], alphabet, least)
        assert [tuple(r) for r in rules.tolist()] == want_rules and symbols.tolist() == want_symbols and counts.sum() == len(symbols)
        # many pairs a round stop at the same place, and come near in size
        rules, _, symbols, _ = rp.grammar(ids, sizes, alphabet, least=least)
        left = {}
        for p in (p for d in np.split(symbols, np.cumsum(rp.grammar(ids, sizes, alphabet, least=least)[3])[:-1]) for p in zip(d.tolist(), d.tolist()[1:])):
            left[p] = left.get(p, 0) + 1
        assert max(left.values(), default=0) < least and len(symbols) + len(rules) <= 1.2 * (len(want_symbols) + len(want_rules)) + 10


@pytest.mark.parametrize("alphabet,n", [(1, 1000), (2, 5000), (50, 20000), (60000, 3000), (3, 0), (3, 1)])
def test_blocks_round_trip_and_random_access(alphabet, n):
    rng = np.random.default_rng(alphabet)
    ids = rng.integers(0, alphabet, n, dtype=np.uint32)
    sizes = np.diff(np.concatenate([[0], np.sort(rng.integers(0, n + 1, 20)), [n]]))
    data = rp.pack(ids, sizes)
    block = rp.Block(data)
    assert (block.ids() == ids).all() and len(block.ids()) == n
    ends = np.cumsum(sizes)
    for i in range(len(sizes)):
        assert block.document(i).tolist() == ids[ends[i] - sizes[i] : ends[i]].tolist()
    for lo, hi in ((0, n), (n // 3, n // 2), (n // 2, n // 2)):
        assert block.range(lo, hi).tolist() == ids[lo:hi].tolist()
    if alphabet < 60000 and n >= 1000:
        assert len(block.rules) and len(block.symbols) < n
        for (a, b), size in zip(block.rules.tolist(), block.lengths.tolist()):
            assert size == sum(1 if x < block.base else block.lengths[x - block.base] for x in (a, b))
    with pytest.raises(ValueError):
        rp.Block(data[:-1] + bytes([data[-1] ^ 1]))


def test_repeats_shrink():
    ids = np.tile(np.arange(64, dtype=np.uint32), 500)
    assert len(rp.pack(ids, np.array([len(ids)]))) < ids.nbytes / 20


def test_files(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, rng.choice(TEXTS)) for i in rng.sample(range(10**6), 300)] + [(7, "a b"), (7, "a b"), (None, "null id"), (2**40, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as key", "2 as data")
    blocks = rp.write(docs, PATH, block_tokens=2000)
    out = sorted(rp.read(blocks).collect(), key=lambda r: r.start)
    assert blocks.count() > 5 and [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    by, at = {}, 0
    for k, t in rows:
        by.setdefault(k, []).append(want(tokenizer, t))
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by[r.doc_id]]
        at += r.n_tokens
    assert rp.read(rp.write(docs.limit(0), PATH)).count() == 0


def test_rows_of_one_id_are_dealt(spark, tokenizer):
    docs = spark.createDataFrame([(None, "the same text again")] * 3000 + [(5, "other")], "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = rp.write(docs, PATH, block_tokens=400)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_shard = [r["count"] for r in blocks.groupBy("shard").agg(rp.F.sum("n_tokens").alias("count")).collect()]
    out = rp.read(blocks).orderBy("start").collect()
    assert len(per_shard) > 1 and max(per_shard) < 0.7 * sum(per_shard)
    assert len(out) == 3001 and [r.doc_id for r in out] == [None] * 3000 + [5] and [r.start for r in out[:3]] == [0, 5, 10]
