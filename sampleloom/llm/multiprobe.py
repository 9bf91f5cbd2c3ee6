"""Approximate nearest neighbours: multiprobe p-stable hashing, then exact reranking by cosine.

Every vector is scaled to length 1 and hashed in ``TABLES`` tables by ``FUNCTIONS`` Gaussian projections cut into steps
of ``WIDTH``. A query visits, in each table, the buckets whose codes differ from its own by at most one step a function,
in the order of the squared distances to the crossed boundaries (the estimated order of success), as many as a bounded
sample needs for ``TARGET`` recall against brute force.

Vectors are dealt by table and cell. A cell holds the buckets that agree in the first functions, as many of these as give
about ``BUCKET_ROWS`` vectors a cell, so a query goes once to each cell that holds buckets on its list, not once to each
bucket. Cells of more vectors are split into salted parts, and a query goes to all parts. A task scores the vectors of the
visited buckets, keeps every one that could be among the nearest, and orders these by the exact measure on the original
vectors and by id, so equal scores are cut by id and nothing is left to rerank; the best of all tables are merged.

Equal vectors are indexed once, with their smallest ids, so a vector that is very common costs no more than a rare one.
Queries that find too few candidates visit all buckets within a step, and those that still do search all vectors in salted
blocks. Vectors that are null, zero, hold null or non-finite components, or have another dimension than the most frequent
one take no part, nor do rows with a null id. Ids are whole numbers of 64 bits; others are an error. Repeated rows count
once. Ties go to the smaller id. Extra columns do not take part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, store, table

NEAREST = 5
TABLES, FUNCTIONS, WIDTH = 6, 8, 2.0
TARGET = 0.96
SAMPLE, SAMPLE_QUERIES = 4000, 200
BUCKET_ROWS = 4096
SALTS = 32
#: Scores by matrix products are this far at most from the exact ones, by more than rounding explains.
MARGIN = 1e-9
#: Rows that are compared with a bucket's queries at once, and found rows that are kept before they are pruned.
BLOCK, KEEP = 2048, 200_000


class Hasher:
    """Codes of vectors in each table, and the codes that a query visits."""

    def __init__(self, dim: int, probes: int = 1, seed: int = 29, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(tables, dim, functions))
        self.shifts = rng.uniform(0, width, (tables, functions))
        self.width, self.probes, self.dim = width, probes, dim
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=functions)), np.int64)
        self.weights = 1009 ** np.arange(functions, dtype=np.int64) % (1 << 40)

    def _place(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        p = (unit @ self.directions[t] + self.shifts[t]) / self.width
        whole = np.floor(p)
        return whole.astype(np.int64), p - whole

    def codes(self, unit: np.ndarray, t: int) -> np.ndarray:
        return self._place(unit, t)[0] @ self.weights

    def cells(self, unit: np.ndarray, t: int, first: int) -> np.ndarray:
        """The cells of vectors, by the first functions."""
        return self._place(unit, t)[0][:, :first] @ self.weights[:first]

    def visited_cells(self, unit: np.ndarray, t: int, first: int, probes: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query, the distinct cells of the buckets that it visits, and the cost of the last of these buckets."""
        best, cost = self._best(unit, t, probes)
        cells = [np.unique(w[:first] @ self.weights[:first] + self.steps[b, :first] @ self.weights[:first]) for w, b in zip(self._place(unit, t)[0], best)]
        return cells, np.take_along_axis(cost, best[:, -1:], 1)[:, 0]

    def visited(self, query: np.ndarray, row: np.ndarray, t: int, last: np.ndarray) -> np.ndarray:
        """Whether the bucket of each row is one that the query beside it visits: within a step a function, and no dearer than
        the last one on its list."""
        whole, rest = self._place(query, t)
        step = self._place(row, t)[0] - whole
        cost = np.where(step < 0, rest**2, np.where(step > 0, (1 - rest) ** 2, 0.0)).sum(1)
        return (np.abs(step) <= 1).all(1) & (cost <= last + 1e-9)

    def visits(self, unit: np.ndarray, t: int, probes: int | None = None) -> np.ndarray:
        """The codes that each query visits in table ``t``, likeliest first: (queries, probes)."""
        return (self._place(unit, t)[0] @ self.weights)[:, None] + (self.steps @ self.weights)[self._best(unit, t, probes)[0]]

    def _best(self, unit: np.ndarray, t: int, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
        _, rest = self._place(unit, t)
        cost = (rest**2) @ (self.steps == -1).T + ((1 - rest) ** 2) @ (self.steps == 1).T
        n = min(probes or self.probes, len(self.steps))
        best = np.argpartition(cost, n - 1, axis=1)[:, :n] if n < len(self.steps) else np.argsort(cost, axis=1)
        return np.take_along_axis(best, np.take_along_axis(cost, best, 1).argsort(1, kind="stable"), 1), cost


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The measure: cosines of the rows of x and y in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def probes_for(sample: np.ndarray, queries: int, nearest: int = NEAREST, target: float = TARGET) -> int:
    """Buckets to visit in each table for the target recall among the sample; a full corpus is denser and does better."""
    dim, x = sample.shape[1], unit(sample)
    hasher = Hasher(dim)
    q = np.arange(min(queries, len(x)))
    if len(x) < 2:
        return 1
    score = x[q] @ x.T
    score[q, q] = -np.inf
    k = min(nearest, len(x) - 1)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    # The rank at which each true neighbour's bucket is visited, in the table that visits it first.
    first = np.full(top.shape, len(hasher.steps))
    for t in range(TABLES):
        codes, visits = hasher.codes(x, t), hasher.visits(x[q], t, len(hasher.steps))
        for i in q:
            order = {c: r for r, c in reversed(list(enumerate(visits[i].tolist())))}
            first[i] = np.minimum(first[i], [order.get(c, len(hasher.steps)) for c in codes[top[i]].tolist()])
    return int(min(len(hasher.steps), np.quantile(first, target, method="higher") + 1))


def valid_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, embedding) of the rows that take part; floats stay floats, other numbers become doubles."""
    x = F.col(column) if dict(vectors.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.where(F.col(key).isNotNull() & sound).select(F.col(key).alias("id"), x.alias("embedding"))
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("embedding") == (dim["dim"] if dim else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rid, embedding, ids): each distinct vector with its ``keep`` smallest ids; common vectors are thinned in salted parts first."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    thin = rows.withColumn("_salt", salt).withColumn("_r", F.dense_rank().over(Window.partitionBy("embedding", "_salt").orderBy("id"))).where(F.col("_r") <= keep)
    thin = thin.groupBy("embedding", "id").agg(F.lit(1).alias("_one"))
    thin = thin.withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("_r") <= keep)
    return thin.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rid"), "embedding", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def hashed(rows: DataFrame, hasher: Hasher, first: int, visits: bool) -> DataFrame:
    """(tab, cell, rid, embedding, last): a row for each table, or for each cell with buckets that a query visits, with the
    cost of the last bucket that it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 64 if visits else b.num_rows or 1
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                x = unit(_matrix(part.column(1)))
                for t in range(TABLES):
                    cells, last = hasher.visited_cells(x, t, first) if visits else (hasher.cells(x, t, first)[:, None], np.zeros(len(x)))
                    pick = np.repeat(np.arange(len(x)), [len(c) for c in cells])
                    yield pa.record_batch([pa.array(np.full(len(pick), t, np.int32)), pa.array(np.concatenate(list(cells))), part.column(0).take(pa.array(pick)), part.column(1).take(pa.array(pick)), pa.array(last[pick])], ["tab", "cell", "rid", "embedding", "last"])

    return rows.select("rid", "embedding").mapInArrow(run, f"tab int, cell bigint, rid bigint, embedding {dict(rows.dtypes)['embedding']}, last double")


def _best(q: np.ndarray, r: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best distinct candidates of each query."""
    order = np.lexsort((r, -s, q))
    q, r, s = q[order], r[order], s[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])])[: len(q)]  # the same pair has the same score, so repeats touch
    q, r, s = q[new], r[new], s[new]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return q[rank < keep], r[rank < keep], s[rank < keep]


class Block:
    """Queries of one cell, and what a task has found for them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, last: np.ndarray):
        self.ids, self.x, self.unit, self.last = ids, x, unit(x), last

    def meet(self, rid: np.ndarray, x: np.ndarray, ux: np.ndarray, visited, edges: dict[int, float], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of rows that may be among the ``keep`` nearest of those that a query visits.

        ``edges`` has scores that each query's ``keep``-th nearest reaches for certain; a query without one takes it from
        the rows that it visits here.
        """
        score = self.unit @ ux.T
        edge = np.array([edges.get(q, -np.inf) for q in self.ids.tolist()])
        found = []
        for some, lo in ((np.flatnonzero(np.isfinite(edge)), -MARGIN), (np.flatnonzero(np.isinf(edge)), None)):
            for a in range(0, len(some), 256 if lo is not None else 32):
                q = some[a : a + (256 if lo is not None else 32)]
                part = score[q]
                i, j = np.nonzero(part >= edge[q][:, None] + lo) if lo is not None else (m.ravel() for m in np.indices(part.shape))
                ok = visited(self.unit[q[i]], ux[j], self.last[q[i]])
                i, j = i[ok], j[ok]
                if lo is None and len(i):
                    part[:] = -np.inf
                    part[i, j] = score[q[i], j]
                    n = min(keep, len(x))
                    least = np.partition(part, len(x) - n, axis=1)[:, len(x) - n]
                    ok = part[i, j] >= least[i] - MARGIN
                    i, j = i[ok], j[ok]
                for p in range(0, len(i), 65536):
                    k, r = q[i[p : p + 65536]], j[p : p + 65536]
                    found.append(_best(self.ids[k], rid[r], cosine(self.x[k], x[r]), keep))
        if not found:
            return self.ids[:0], rid[:0], np.zeros(0)
        q, r, s = _best(*(np.concatenate(c) for c in zip(*found)), keep)
        full = np.flatnonzero(np.concatenate([q[keep - 1 :] == q[: len(q) - keep + 1], np.zeros(min(len(q), keep - 1), bool)])) + keep - 1 if len(q) >= keep else []
        for at in full:
            edges[int(q[at])] = max(float(s[at]), edges.get(int(q[at]), -np.inf))
        return q, r, s


def candidates(index: DataFrame, probes: DataFrame, hasher: Hasher | None, keep: int) -> DataFrame:
    """(q, r, score): the ``keep`` best candidates of each query within each task. Rows meet by (tab, cell, part), and a query
    sees the rows of the buckets on its list, all rows without a hasher."""
    many = index.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_ROWS).select("tab", "cell", F.ceil(F.col("_n") / BUCKET_ROWS).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = index.join(many, ["tab", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("rid"), parts.cast("bigint")).cast("int")).withColumn("side", F.lit(1))
    right = probes.join(many, ["tab", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("side", F.lit(0))
    columns = ["tab", "cell", "part", "side", "rid", "embedding", "last"]
    met = right.select(columns).unionByName(left.select(columns)).repartition("tab", "cell", "part").sortWithinPartitions("tab", "cell", "part", "side", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, edges = None, [], {}
        found, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            side, rid, x, last = b.column(3).to_numpy(), b.column(4).to_numpy(), _matrix(b.column(5)), b.column(6).to_numpy()
            ux = unit(x)
            cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1) | (side[1:] != side[:-1])]))
            for a, e in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
                here = tuple(k[a].tolist())
                if here != key:
                    key, blocks = here, []
                if side[a] == 0:
                    blocks.append(Block(rid[a:e], x[a:e], last[a:e]))
                    continue
                visited = (lambda q, r, until, t=here[0]: hasher.visited(q, r, t, until)) if hasher is not None else (lambda q, r, until: np.ones(len(q), bool))
                for block in blocks:  # both sides come in batches, so blocks are bounded
                    found.append(block.meet(rid[a:e], x[a:e], ux[a:e], visited, edges, keep))
                    rows += len(found[-1][2])
                    if rows > KEEP:
                        found = [_best(*(np.concatenate(c) for c in zip(*found)), keep)]
                        if len(found[0][0]) > KEEP // 2:
                            yield pa.record_batch([*map(pa.array, found.pop())], ["q", "r", "score"])
                            edges.clear()
                        rows = len(found[0][0]) if found else 0
        if found:
            yield pa.record_batch([*map(pa.array, _best(*(np.concatenate(c) for c in zip(*found)), keep))], ["q", "r", "score"])

    return met.mapInArrow(run, "q bigint, r bigint, score double")


def merged(found: DataFrame, keep: int) -> DataFrame:
    """The best of what all tasks have found."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))
    return found.groupBy("q", "r").agg(F.max("score").alias("score")).withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def functions_of_cells(sample: np.ndarray, rows: int, hasher: Hasher) -> int:
    """The least number of functions by which cells hold ``BUCKET_ROWS`` of so many vectors on average over the vectors."""
    x = unit(sample)
    for first in range(1, FUNCTIONS):
        _, n = np.unique(hasher.cells(x, 0, first), return_counts=True)
        if (n / len(x)) @ (n / len(x)) * rows <= BUCKET_ROWS:
            return first
    return FUNCTIONS


def search(vectors: DataFrame, queries, key: str = "vec_id", column: str = "embedding", nearest: int = NEAREST, probes: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): the nearest rows of every row for which ``queries``, a function of the id's column, holds."""
    spark, keep = vectors.sparkSession, nearest + 1  # a query is among its own candidates
    with scratch(spark, "neighbours", BLOCK) as kept:
        rows = kept(valid_vectors(vectors, key, column).select(F.col("id").cast("bigint").alias("id"), "embedding"), "vectors")
        reps = kept(distinct_vectors(rows, keep), "distinct-vectors")
        sample = np.array([r.embedding for r in reps.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("embedding").collect()], np.float64)  # bounded: SAMPLE vectors
        dim = sample.shape[1] if len(sample) else 1
        hasher = Hasher(dim, probes or (probes_for(sample, SAMPLE_QUERIES, nearest) if len(sample) else 1))
        first = functions_of_cells(sample, reps.count(), hasher) if len(sample) else FUNCTIONS
        asked = rows.where(queries(F.col("id"))).select(F.col("id").alias("query_id"), "embedding").distinct()
        members = kept(asked.join(reps.select("rid", "embedding"), "embedding").select("query_id", F.col("rid").alias("q")), "queries")
        wanted = members.select(F.col("q").alias("rid")).distinct()
        index = hashed(reps, hasher, first, False)
        pairs = kept(merged(candidates(index, hashed(reps.join(wanted, "rid", "left_semi"), hasher, first, True), hasher, keep), keep), "candidates")
        # Queries whose candidates, with all ids of equal vectors, are too few look further, at last at all vectors.
        all_near = Hasher(dim, len(hasher.steps))
        everywhere = lambda df: df.select(F.lit(0).alias("tab"), F.lit(0).cast("bigint").alias("cell"), "rid", "embedding", F.lit(0.0).alias("last"))
        for wider in (all_near, None):
            ids = pairs.join(reps.select(F.col("rid").alias("r"), F.size("ids").alias("n")), "r").groupBy("q").agg(F.sum("n").alias("n"))
            short = kept(wanted.join(ids.withColumnRenamed("q", "rid"), "rid", "left").where(F.coalesce("n", F.lit(0)) <= nearest).select("rid"), "short-queries")
            if short.isEmpty():
                break
            again = reps.join(short, "rid", "left_semi")
            rest = candidates(index, hashed(again, wider, first, True), wider, keep) if wider else candidates(everywhere(reps), everywhere(again), None, keep)
            pairs = kept(pairs.join(short, pairs.q == short.rid, "left_anti").unionByName(merged(rest, keep)), "candidates")
        scored = pairs.join(reps.select(F.col("rid").alias("r"), "ids"), "r").select("q", "score", F.explode("ids").alias("id"))
        mine = members.join(scored, "q").where("id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return store(mine.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", F.col("id").alias(key), "score"), "nearest")


def op4_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
