import random

import pytest
from pyspark.sql import functions as F

from sampleloom.llm import pareto_mix as pm


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshares the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, due = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = due - sum(most * sizes[s] for s in fixed)
        target = {s: most * sizes[s] if s in fixed else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        fixed |= set(over)


def brute_copies(rows, target):
    """One document at a time in Pareto order, PASSES times."""
    out = {}
    for s in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == s]
        total = sum(r[2] for r in own)
        e = target[s] / total if total else 0.0
        pi, due = e - int(e), target[s] - int(e) * total
        drawn = set()
        if pi > 0:
            order = sorted(own, key=lambda r: (r[3] / (1 - r[3]) * (1 - pi) / pi, r[0]))
            for _ in range(pm.PASSES):
                room = due
                for r in [r for r in order if r[0] not in drawn and r[2] <= due]:
                    room -= r[2]
                    if room < 0:
                        break
                    drawn.add(r[0])
                    due -= r[2]
        out |= {r[0]: int(e) + (r[0] in drawn) for r in own}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * (1 + int(rng.paretovariate(0.7))) for _ in range(min(900, int(rng.paretovariate(0.6))))), rng.choice(["a", "a", "a", "é", "Z", None, "b"]), 7) for i in range(400)]
    rows += [(1000, None, "a", 1), (1001, "", "nil", 1), (1002, " \x0b x y z ", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tie int")


def test_against_brute_force(spark, docs):
    out = pm.mix(docs).collect()
    with_u = docs.select("doc_id", "source", pm.uniform(F.col("doc_id")).alias("u"), "text").collect()
    rows = [(r.doc_id, r.source, len((r.text or "").replace(" ", "_").split()), r.u) for r in with_u]
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    target = brute_targets(sizes)
    copies = brute_copies(rows, target)
    assert len(out) == len(rows)
    for r in out:
        assert r.size == dict((x[0], x[2]) for x in rows)[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        assert r.size == 0 or r.copies == copies[r.doc_id]
    for s, t in target.items():
        assert abs(sum(r.copies * r.size for r in out if r.source == s) - t) <= max(0.02 * t, min([x[2] for x in rows if x[1] == s and x[2]] or [0]))


def test_weights_change_the_odds(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'w w w w w' as text", "'s' as source", "if(id % 2 = 0, 3.0, 1.0) as w")
    out = pm.mix(docs, weight=F.col("w"), share=0.25).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r.odd: r.n for r in out}
    assert sum(n.values()) == 1000 and 640 <= n[0] <= 860  # expected 750 and 250


def test_ties_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 6 + [(None, "a b c", None)] * 2, "doc_id long, text string, source string")
    out = pm.mix(docs).collect()
    assert len(out) == 8 and sum(r.copies * r.size for r in out) == 36
    assert pm.mix(docs.limit(0)).count() == 0
    assert sorted(map(tuple, pm.mix(docs).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_long_texts_and_columns_of_any_name(spark):
    rows = [(i, "w " * n, "s", f"x{i}", i, -i) for i, n in enumerate((10, 400_000, 3, 7, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _tie string, _copy int, _k int")
    got = sorted(map(tuple, pm.repeated(docs).collect()))
    assert set(got) <= set(rows) and sum(len(r[1]) // 2 for r in got) >= 400_000
    sizes = {r.doc_id: r.size for r in pm.mix(docs).collect()}
    assert sizes == {0: 10, 1: 400_000, 2: 3, 3: 7, 4: 20_000}
