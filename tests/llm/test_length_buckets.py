import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sampleloom.llm import length_buckets as lb


def padded_sum(bounds, tops, rows):
    return sum(n * min(b for b in bounds if b >= t) for t, n in zip(tops, rows))


def test_boundaries_against_all_choices():
    rng = random.Random(2)
    for trial in range(60):
        n = rng.randint(1, 9)
        tops = sorted(rng.sample(range(0, 60), n))
        rows = [rng.randint(1, 30) for _ in tops]
        for k in (1, 2, 3, 4):
            best = min(padded_sum([*c, tops[-1]], tops, rows) for r in range(min(k, n)) for c in itertools.combinations(tops[:-1], r))
            got = lb.boundaries(np.array(tops), np.array(rows), k)
            assert len(got) <= k and got[-1] == tops[-1] and padded_sum(got, tops, rows) == best


def plain_boundaries(tops, rows, buckets):
    """The dynamic program by its definition."""
    below, best = [0, *np.cumsum(rows).tolist()], {0: (0, [])}
    for _ in range(buckets):
        best = {0: (0, [])} | {j: min((c + tops[j - 1] * (below[j] - below[i]), [*b, tops[j - 1]]) for i, (c, b) in best.items() if i < j) for j in range(1, len(tops) + 1) if any(i < j for i in best)}
    return best[len(tops)]


def test_boundaries_against_the_plain_program():
    rng = random.Random(3)
    for trial in range(15):
        tops = sorted(rng.sample(range(1, 5000), rng.choice([20, 60, 90])))
        rows = [int(rng.paretovariate(0.7)) for _ in tops]
        for k in (2, 7, 12):
            assert padded_sum(lb.boundaries(np.array(tops), np.array(rows), k), tops, rows) == plain_boundaries(tops, rows, k)[0]
    tops = np.arange(1, 200_001) * 10**9  # sums beyond what floats hold exactly
    assert len(lb.boundaries(tops, np.ones(len(tops), np.int64))) == lb.BUCKETS


def test_every_length_counts(spark):
    lengths = spark.range(200_000).select((F.col("id") % 70_000).alias("length"))
    tops, rows = lb.histogram(lengths)
    assert tops.tolist() == list(range(70_000)) and rows.sum() == 200_000


def check(rows, out, budget):
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id is not None) == sorted(x for x in rows if x[0] is not None)
    batches = defaultdict(list)
    for r in out:
        assert r.length <= r.padded
        batches[r.bucket, r.batch].append(r)
    short = Counter()
    for (bucket, batch), rs in batches.items():
        padded = {r.padded for r in rs}
        assert len(padded) == 1
        room = max(1, budget // max(1, padded.pop()))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= room
        short[bucket] += len(rs) < room
    assert all(n <= 1 for n in short.values())  # only a bucket's last batch may have room


def test_batches(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.paretovariate(0.8)) * 3) for i in range(3000)] + [(5000, 100_000), (5001, 0), (5001, 0), (None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, n int").withColumn("bucket", F.lit("x")).withColumn("text", F.lit("a"))
    out = lb.pack(docs, length=F.col("n"), budget=2048, shard_rows=100).collect()
    assert len(out) == len(rows)
    check(rows, out, 2048)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "long " * 700_000)], "doc_id long, text string")
    assert sorted(r.length for r in lb.pack(docs).collect()) == [0, 0, 2, 2, 700_000]
    assert lb.pack(docs.limit(0)).count() == 0


def test_query(spark):
    out = lb.op9_length_buckets(spark, "/root/testdata/sf0.001").collect()
    check([(r.doc_id, r.length) for r in out], out, lb.BUDGET)
    assert len({r.bucket for r in out}) <= lb.BUCKETS
