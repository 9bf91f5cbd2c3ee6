"""Prefix counts against encoding every prefix with the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, normalizers

from sampleloom.llm import prefix_counts as px

PATH = public_tokenizers.path(px.TOKENIZER)
MARKS = ("<|startoftext|>", "<|endoftext|>")
PARTS = ["don't", "IT'RE", "we'll", "'s", "''ve", "it'LL", *MARKS, "<|end", "<|endoftext|≯", "é", "é", "J̌", "H̱", "İ", "ß", "ǅ", "Σ", "ﬁ", " ", "\n", "\t\t", "12", "x1y", "!!", "...", '"', "Interesting", "antidisestablishmentarianism", "çà", "你好", "👍🏽", "가", "a̸", "\x00", "\x1f", "\u0085", " ", "́", "ſ", "=" * 90, "ab" * 60]


@pytest.fixture(scope="module")
def count():
    return px.prefixes(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def domain(text):
    """The text in normal form C, special strings apart."""
    nfc, out = normalizers.NFC(), ""
    for i, part in enumerate(px.prefixes(PATH).marks.split(text)):
        out += nfc.normalize_str(part)
        found = px.prefixes(PATH).marks.findall(text)
        out += found[i] if i < len(found) else ""
    return out


def brute(library, text):
    d = domain(text)
    return [len(e.ids) for e in library.encode_batch_fast([d[:i] for i in range(len(d) + 1)], add_special_tokens=False)]


def of(count, texts):
    return [np.concatenate([[0], np.cumsum(g)]).tolist() for g in count(pa.array(texts))]


def test_every_prefix_of_odd_texts(count, library):
    rng = random.Random(5)
    odd = lambda: chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x300, 0x36F), rng.randint(0x370, 0x2FFF)]))
    texts = ["".join((rng.choice(PARTS) if rng.random() < 0.8 else odd()) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    for text, got in zip(texts, of(count, texts)):
        assert got == brute(library, text), repr(text)


def test_short_words_together_as_one_by_one(count):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinorst" if rng.random() < 0.8 else "bcdfghjklmpquvwxyzé'") for _ in range(rng.randint(1, 20))) for _ in range(500)]
    raw = " ".join(words).encode()
    single = count._ends(raw.decode("latin-1").translate(px.SPELLED_BUT_BLANK))
    assert (count._together(np.frombuffer(raw, np.uint8)) == single).all()


def test_words_are_forgotten_and_come_back(count, library, monkeypatch):
    monkeypatch.setattr(px, "WORDS", 3)
    for text in ("one two three four", "four five", "one two"):
        assert of(count, [text])[0] == brute(library, text)


def test_long_words_and_texts(count, library):
    word, text = "interest" * 5000, "Some words, and more! " * 4000
    whole = [len(e.ids) for e in library.encode_batch_fast([word, word[:33333], text, text[:50001]], add_special_tokens=False)]
    a, b = of(count, [word, text])
    assert [a[-1], a[33333], b[-1], b[50001]] == whole


def test_tables_answer_counts_and_budgets(count, library):
    text = "The unbelievable interesting interestin stories, they're 12 times told."
    data = px.packed(next(count(pa.array([text]))))
    found, want = px.counts(data), brute(library, text)
    assert found.tolist() == want
    for budget in range(-1, want[-1] + 2):
        assert px.within(found, budget) == max((i for i, n in enumerate(want) if n <= budget), default=0)
    assert px.counts(px.packed(np.zeros(0, np.int32))).tolist() == [0]
    wide = np.array([1, -300, 70000, -128, 5])
    assert px.counts(px.packed(wide)).tolist() == [0, *np.cumsum(wide)]


def test_merges_that_do_not_form_tokens_in_order_are_refused():
    with pytest.raises(ValueError):
        px.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        px.Prefixes(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_with_nulls_repeated_rows_and_clashing_names(spark, library, tmp_path):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, "x"), (2, None), (3, ""), (4, "word " * 2048), (5, "word " * 2049), (6, "a<|endoftext|>b " * 900)]
    frame = spark.createDataFrame([(i, t, "q", 0) for i, t in rows], "doc_id bigint, text string, n_bytes string, prefixes int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = px.op13_prefix_counts(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        fits = [k for k, c in enumerate(brute(library, t or "")) if c <= 2048][-1] if len(t or "") < 20 else None
        want.append((i, len((t or "").encode()), n, n > 2048, fits))
    got = [tuple(r) for r in found.collect()]
    key = lambda r: (str(r[0]), r[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and (w[4] is None or g[4] == w[4])
    long = {r[0]: r for r in got}
    assert long[4][4] == len("word " * 2048) and long[5][4] == len("word " * 2048) and len(got) == len(rows)
    spark.createDataFrame([], frame.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert px.op13_prefix_counts(spark, f"{tmp_path}/none").collect() == []
