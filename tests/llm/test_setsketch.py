import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sampleloom.llm import setsketch as ss


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Components over all pairs that share a shingle, of rows with different ids."""
    sets = {k: brute_set(t) for k, t in rows if k is not None}
    where, shared = defaultdict(list), defaultdict(int)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                shared[a, b] += 1
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def check(rows, out):
    want = brute(rows)
    assert len(out) == len(rows)
    wrong = [(r, want[r.doc_id]) for r in out if r.doc_id is not None and (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert not wrong, (len(wrong), wrong[:5])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_shingles_are_those_of_the_words():
    rng = random.Random(1)
    texts = ["", " ", "a", "A b", "a B c d", "a b c d e", "a b c d e f g", "é\x0bx y É", "a b c d e " * 50] + ["".join(rng.choices("ab \t\nAé ", k=60)) for _ in range(200)]
    for part in (texts, texts[::-1], *[[t] for t in texts[:12]]):
        for t, s in zip(part, ss.shingles(part)):
            assert len(s) == len(brute_set(t)), t
    a, b, c = ss.shingles(["One two three four five six", "zero one TWO three four five", "four five"])
    assert len(np.intersect1d(a, b)) == 1 and len(np.intersect1d(a, c)) == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    errors = []
    for n, shared in ((1, 1), (3, 2), (40, 30), (500, 400), (3000, 2400), (3000, 300)):
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])
        x, y, z = ss.sketch([a, b, np.union1d(a, b)])
        assert (ss.merge(x, y) == z).all() and (ss.sketch([a])[0] == x).all()
        more, less = (x > y).sum(), (x < y).sum()
        one = lambda v: np.array([float(v)])
        got = ss.estimate(one(more), one(less), one(len(x) - more - less), one(n), one(n))[0]
        errors.append(abs(got - shared / (2 * n - shared)))
    assert max(errors) < 0.12, errors


def varied(rng, words, rate):
    return [rng.choice("pqrstuvw") + str(rng.randint(0, 10**6)) if rng.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Chains and crowds of near copies round the threshold, exact copies, shared passages, short and odd texts."""
    rng, rows = random.Random(11), []
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 3000))
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 160))]
        rows += [" ".join(varied(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.04]))) for _ in range(rng.choice([2, 3, 40]))]
    chain = [word() for _ in range(120)]
    for _ in range(40):
        chain = varied(rng, chain, 0.02)
        rows.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(80)]
    rows += ["one", "ONE", "one two", "", " \n", "one two three four five", "x y z w v u", "X y z w v u"] + [" ".join(["dup"] * 30)] * 30
    rng.shuffle(rows)
    return [*enumerate(rows, 5), (9000, None), (7, rows[2]), (None, rows[3]), (None, None), (9001, " ".join(word() for _ in range(30000)))]


@pytest.mark.parametrize("block, pairs", [(ss.BLOCK, ss.PAIRS), (16, 64)])
def test_against_brute_force(spark, corpus, block, pairs, monkeypatch):
    monkeypatch.setattr(ss, "BLOCK", block)
    monkeypatch.setattr(ss, "PAIRS", pairs)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 as id", "'a' as n")
    check(corpus, ss.near_duplicates(docs).collect())


def test_slope_tells_whether_the_estimate_reaches():
    rng = np.random.default_rng(5)
    na, nb = rng.integers(100, 140, 3000).astype(float), rng.integers(100, 140, 3000).astype(float)
    equal = rng.integers(100, 250, 3000)
    more = rng.binomial(256 - equal, 0.5)
    e = ss.estimate(more, 256 - equal - more, equal, na, nb)
    far = abs(e - 0.63) > 1e-6
    assert (ss.reaches(0.63, more, 256 - equal - more, equal, na, nb) == (e >= 0.63))[far].all() and 500 < (e >= 0.63).sum() < 2500


def test_null_ids_repeated_ids_and_other_types(spark):
    """Rows with null ids are linked, and rows of one id with different texts keep their own links; ids may be strings."""
    rng = random.Random(4)
    a, b = ([rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(100)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (None, near(a)), (5, " ".join(b)), (3, near(b)), (None, "alone in this table"), (None, "alone in this table"), (None, "1 2 3 4 5 6"), (8, None), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in ss.near_duplicates(docs).collect()), key=str)
    # the two texts of id 5 belong to different components, named 5 and 3
    assert got == sorted([(5, 5, True), (None, 5, False), (5, 3, False), (3, 3, True), (None, None, True), (None, None, True), (None, None, True), (8, 8, True), (8, 8, True), (8, 8, True)], key=str)
    one = sorted([tuple(r) for r in ss.one_of_each(docs).collect()], key=str)
    assert one == sorted([rows[0], rows[3], rows[4], rows[6], rows[7], rows[9]], key=str)
    named = spark.createDataFrame([(f"x{k}", t) for k, t in rows[:1] + rows[3:4]], "doc_id string, text string")
    assert {r.component_id for r in ss.near_duplicates(named).collect()} == {"x5", "x3"}


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7), (2, "c d", "y", 8)], "doc_id long, text string, row string, _hash long")
    assert sorted(tuple(r) for r in ss.one_of_each(docs).collect()) == [(1, "a b", "x", 7), (2, "c d", "y", 8)]


def test_a_crowd_gives_rows_in_proportion(spark):
    """Copies of one text that differ by 12 % of its words are mostly between 0.65 and 0.8 similar: a block takes each member
    at most twice and gives fewer links than it has members, though nearly all pairs are candidates."""
    made = {}
    for n in (150, 600):
        rng = random.Random(9)
        base = [str(rng.randint(0, 10**6)) for _ in range(400)]
        # each copy changes a run of words, so that one run costs about as many shingles as it has words
        rows = []
        for i in range(n):
            at, k = rng.randint(0, 330), rng.randint(40, 60)
            rows.append((i, " ".join([*base[:at], *(f"{i}x{j}" for j in range(k)), *base[at + k :]])))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        with ss.scratch(spark, "crowd") as keep:
            classes = keep(ss.sketches(docs).select(ss.F.col("id").alias("c"), "n", "registers"), "classes")
            none = spark.createDataFrame([], "id bigint, component bigint")
            asked = keep(ss.in_question(ss.blocks(ss.bands(classes), none, classes)), "asked")
            best = ss.best_pairs(asked).count()
            links = [tuple(r) for r in ss.links_in_blocks(asked, docs.select(ss.F.col("doc_id").alias("c"), "text")).collect()]
            made[n] = (asked.count() / n, best / n, len(links) / n)
        check(rows, ss.near_duplicates(docs).collect())
    assert all(asked <= 2 * ss.BANDS and best <= 1 and links <= asked / 2 for asked, best, links in made.values()), made


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(3, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in ss.near_duplicates(docs).collect()] == [(3, 1, 3, True)]
    assert ss.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    comp = {}
    root = lambda k: k if comp.setdefault(k, k) == k else root(comp[k])
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        comp[y] = x
    got = {r.id: r.component for r in ss.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(k, k) == root(k) for k in comp)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(rows, ss.op5_near_duplicates(spark, "/root/testdata/sf0.01").collect())
