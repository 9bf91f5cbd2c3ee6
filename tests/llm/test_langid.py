import itertools
import random

import numpy as np

from sampleloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it was thinking of the other thing with them"
FR = "le vieux château était près de la rivière où les enfants jouaient pendant les vacances avec leurs amis"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом она думает о другой вещи вместе с ними"


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    return list(best)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(6), [5, 1, 3, 7, 2, 4])
    scores = rng.normal(size=(len(doc), 3)) * 2
    got = langid.viterbi(scores, doc, 1.0)
    for d in range(6):
        assert got[doc == d].tolist() == brute_viterbi(scores[doc == d], 1.0)


def test_many_languages():
    scores = np.full((400, 300), -5.0)
    want = np.repeat([299, 3, 257, 255], 100)
    scores[np.arange(400), want] = 0
    assert (langid.viterbi(scores, np.zeros(400, int), 1.0) == want).all()


def test_samples_leave_no_group_out(spark):
    """Groups have no cap, whether their rates are broadcast or not."""
    from sampleloom.llm import common

    docs = spark.range(30_000).selectExpr("id", "id % 11000 as g")
    assert common.bounded_sample(docs, "id", "g", 5, "x").count() == 30_000


def test_trigrams_do_not_cross_texts():
    a = langid.Words(["abc def", "ghi"])
    b = langid.Words(["ghi"])
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)).astype(np.float32)
    assert np.allclose(a.scores(table)[2], b.scores(table)[0], atol=1e-5)


def corpus(spark):
    rng, rows = random.Random(3), []
    for i in range(240):
        lang, text = [("en", EN), ("fr", FR), ("ru", RU)][i % 3]
        rows.append((i, " ".join(rng.choices(text.split(), k=20)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int")


def test_learned_mixed_and_edge_cases(spark):
    train = corpus(spark)
    model = langid.fit(train)
    assert model.langs == ["en", "fr", "ru"]
    cyrillic = langid.SCRIPTS.index("cyrillic")
    assert model.allowed[cyrillic].tolist() == [False, False, True]
    mixed = f"{EN}. {FR}. {RU}"
    rows = [(1, EN), (2, FR), (3, RU), (4, None), (5, ""), (6, "123 !!!"), (7, mixed), (7, mixed), (None, EN * 2000), (9, "漢字")]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "ru", "und", "und", "und", "en"]
    assert by[4].score == 0 and all(0 <= r.score <= 1 for r in out)
    spans = [s.split(":") for s in by[7].spans.split(",")]
    assert [s[2] for s in spans] == ["en", "fr", "ru"]
    assert abs(int(spans[1][0]) - mixed.index("le vieux")) <= 8 and mixed[int(spans[2][0]) :].startswith("быстрая")
    assert by[9].lang_pred in model.langs  # letters of a script that no language has


def test_order_of_blocks_does_not_matter(spark):
    model = langid.fit(corpus(spark))
    texts = [EN, FR * 30, "", RU, EN + " " + FR]
    together = langid.label(model, texts)
    assert together == [langid.label(model, [t])[0] for t in texts]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, docs).collect()[0].lang_pred == "und"
    assert langid.identify(docs.limit(0), corpus(spark)).count() == 0


def test_held_out_accuracy(spark):
    out = langid.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def plain_label(model, text, penalty):
    """One text by the definitions: words of letters and marks, sums of their trigrams' log probabilities, all paths' best."""
    import unicodedata

    words, at = [], 0
    for i, c in enumerate([*text, " "]):
        if unicodedata.category(c)[0] in "LM":
            continue
        if i > at:
            words.append((at, i))
        at = i + 1
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0, ""

    def code(c2, c1, c):
        x = (c * 0x9E3779B1 + c1 * 0x85EBCA77 + c2 * 0xC2B2AE3D) % (1 << 32)
        x = (x ^ x >> 15) * 0x2C1B3C6D % (1 << 32)
        return x >> 17

    def script(c):
        return next((k for k, name in enumerate(langid.SCRIPTS) for lo, hi in langid.SCRIPT_RANGES.get(name, ()) if lo <= ord(c) <= hi), 0)

    scores, letters = [], []
    for a, e in words:
        low = [ord(c.lower()) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else ord(c) for c in text[a:e]]
        s = sum(model.logp[code(x, y, z)].astype(np.float64) for x, y, z in zip([0, 0, *low], [0, *low], [*low, 0]))
        may = model.allowed[script(text[a])]
        scores.append(np.where(may, s - s.max(), -1e4) if may.any() else np.zeros(len(s)))
        letters.append(sum(unicodedata.category(c)[0] == "L" for c in text[a:e]))
    k = len(model.langs)
    best, back = [scores[0][x] for x in range(k)], []
    for s in scores[1:]:
        top = max(range(k), key=lambda x: best[x])
        back.append([x if best[x] >= best[top] - penalty else top for x in range(k)])
        best = [max(best[x], best[top] - penalty) + s[x] for x in range(k)]
    path = [max(range(k), key=lambda x: best[x])]
    for b in reversed(back):
        path.append(b[path[-1]])
    path = path[::-1]
    share = [sum(n for n, x in zip(letters, path) if x == lang) for lang in range(k)]
    top = max(range(k), key=lambda x: share[x])
    mine = [np.exp(s[x]) / np.exp(s).sum() * n for s, n, x in zip(scores, letters, path) if x == top]
    return model.langs[top], share[top] / sum(letters) * sum(mine) / share[top], path


def test_query_against_the_plain_form(spark):
    """Every row of the query: fold, language and score."""
    import zlib

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    from sampleloom.llm.common import crc_fold
    from pyspark.sql import functions as F

    model = langid.fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = langid.op2_language_id(spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for r in out[::3]:
        lang, score, _ = plain_label(model, texts[r.doc_id] or "", langid.SWITCH_PENALTY)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, r.doc_id


class Given(langid.Model):
    """Words whose chances in four languages are given."""

    def __init__(self, chances):
        super().__init__(list("wxyz"), np.zeros((langid.BUCKETS, 4), np.float32), np.ones((len(langid.SCRIPTS), 4), bool))
        self.chances = chances

    def word_scores(self, words):
        s = np.log(np.array(self.chances))
        return s - s.max(1, keepdims=True)


def test_identified_by_spans():
    """A word that is clear by itself counts only in a span of its language."""
    stray, plain = [0.5, 0.1, 0.1, 0.3], [0.1, 0.33, 0.23, 0.34]
    assert langid.identified(Given([stray, plain, plain, plain]), ["a b c d"], 0.25) == [False]
    assert langid.identified(Given([stray] * 4), ["a b c d"], 0.25) == [True]
    other = [0.97, 0.01, 0.01, 0.01]
    assert langid.identified(Given([plain] * 5 + [other] * 5), ["a b c d e f g h i j"], 0.25) == [True]
