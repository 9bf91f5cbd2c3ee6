import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.llm import multiprobe as mp


def brute(rows, queries, nearest=5):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for k in np.flatnonzero([queries(i) for i in ids]):
        s = (x[k] * x).sum(1) / (np.sqrt((x[k] ** 2).sum()) * np.sqrt((x * x).sum(1)))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order[:nearest]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_visits_come_in_order_of_estimated_success():
    h = mp.Hasher(16, probes=50)
    x = mp.unit(np.random.default_rng(1).normal(size=(20, 16)))
    for t in range(mp.TABLES):
        visits = h.visits(x, t)
        assert (visits[:, 0] == h.codes(x, t)).all() and all(len(set(v)) == 50 for v in visits.tolist())
        whole, rest = h._place(x, t)
        cost = {}
        for step in h.steps:
            cost[tuple(step)] = sum(r * r if d < 0 else (1 - r) ** 2 if d > 0 else 0 for d, r in zip(step, rest[0]))
        best = sorted(cost.values())[:50]
        code = {int((whole[0] + step) @ h.weights): c for step, c in ((np.array(s), c) for s, c in cost.items())}
        assert np.allclose([code[int(v)] for v in visits[0]], best)
        # A row is seen exactly if its bucket is on the list.
        rows = mp.unit(np.random.default_rng(2).normal(size=(300, 16)))
        _, last = h.visited_cells(x, t, 2)
        for q in range(len(x)):
            seen = h.visited(np.repeat(x[q : q + 1], 300, 0), rows, t, np.repeat(last[q], 300))
            assert (seen == np.isin(h.codes(rows, t), visits[q])).all() and set(h.cells(rows[seen], t, 2)) <= set(h.visited_cells(x, t, 2)[0][q])


def test_recall_and_scores(spark):
    out = found(mp.op4_multiprobe(spark, "/root/testdata/sf0.1"))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    assert out.keys() == want.keys() and all(len(v) == 5 for v in out.values())
    hits = [len({i for i, _ in out[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9, np.mean(hits)
    x = {i: np.array(v, float) for i, v in rows}
    for q, near in out.items():
        for i, s in near:
            assert s == pytest.approx(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i])), abs=1e-14)


def test_ties_repeats_hot_vectors_and_invalid_rows(spark, monkeypatch):
    monkeypatch.setattr(mp, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).round(3).tolist()
    rows = [(i, hot) for i in range(300)] + [(i, rng.normal(size=8).round(3).tolist()) for i in range(300, 420)]
    rows += [rows[350]] * 2
    bad = [(500, None), (550, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (650, [None] + [1.0] * 7), (700, [1.0, 2.0]), (None, hot), (750, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rid", F.lit("x")).withColumn("score", F.lit(1))
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    out = found(mp.search(df, lambda i: i % 50 == 0, probes=7000))
    want = brute(rows, lambda i: i % 50 == 0)
    assert out.keys() == want.keys()
    for q in want:
        assert [i for i, _ in out[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in out[q]], [s for _, s in want[q]], atol=1e-14)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(mp.search(df, lambda i: i % 50 == 0, probes=1)) == {0: [(1, 0.0), (2, -1.0)]}
    assert mp.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_scaled_copies_are_cut_by_id(spark):
    """Equal cosines, by powers of two and by other factors: the smaller ids come first, however many tie."""
    v = np.random.default_rng(6).normal(size=8)
    rows = [(i, (v * 2.0**i).tolist()) for i in range(1, 41)] + [(50, v.tolist())] + [(i, (-v * 2.0 ** (i - 70)).tolist()) for i in range(60, 80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(mp.search(df, lambda i: i % 50 == 0))
    assert [i for i, _ in out[50]] == [1, 2, 3, 4, 5] and all(s == pytest.approx(1) for _, s in out[50])


def test_as_many_as_asked(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda i: i % 50 == 0, 20)
    for probes in (7000, 1):  # with one bucket a table, most queries find too few and look further
        out = found(mp.search(df, lambda i: i % 50 == 0, nearest=20, probes=probes))
        assert all(len(v) == 20 for v in out.values()) and out.keys() == want.keys()
    assert {q: [i for i, _ in v] for q, v in out.items()}.keys() == want.keys()
    out = found(mp.search(df, lambda i: i % 50 == 0, nearest=20, probes=7000))
    assert np.mean([len({i for i, _ in out[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [3e-170, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(mp.search(df, lambda i: i == 0))
    assert [i for i, _ in out[0]] == [1, 3, 2] and np.allclose([s for _, s in out[0]], [1, 0.5**0.5, 0])


def test_recall_among_clusters(spark):
    """Clusters of very different sizes, and more vectors than a cell holds."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    which = np.minimum((60 * rng.random(12_000) ** 2).astype(int), 59)
    x = (centres[which] + rng.normal(0, 0.25, (12_000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = found(mp.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0))
    unit = mp.unit(x.astype(np.float64))
    score = unit[::50] @ unit.T
    score[np.arange(240), np.arange(240) * 50] = -2
    want = np.argsort(-score, axis=1)[:, :5]
    assert np.mean([len({i for i, _ in out[50 * k]} & set(w.tolist())) / 5 for k, w in enumerate(want)]) >= 0.9
