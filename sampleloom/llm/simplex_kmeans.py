"""Centroid clustering of integer vectors, with centroids filtered by n-simplex projection.

Distances of a vector to some pivots fix it up to a reflection: the pivots span a simplex, and the vector is the apex over
it, with one coordinate for each dimension of the simplex and an altitude. For two apexes the Euclidean distance of the
coordinates is a lower bound of the true distance, and with one altitude turned over an upper bound. Apexes of vectors
depend on the pivots alone, so they are computed once and stored beside the vectors; those of centroids are computed on
the driver in each round. Only centroids whose lower bound does not exceed the least upper bound are compared, in whole
numbers, so the result is that of comparing all.

Each round is one pass: tasks hold sums of their own vectors for each centroid, which meet as (centroid, component) rows.
The driver sees k centroids, and at most ``CANDIDATES`` vectors among which pivots are chosen.

Vectors that are null, have another number of components, or hold null or non-finite ones are left out. Extra columns do
not take part. Repeated vectors are vectors of their own, equal distances go to the centroid with the smaller number, and
starting vectors with equal hashes (repeated ids) are ordered by their components. A null id never starts a centroid. With
fewer vectors than k there are as many centroids as vectors with an id; without any the result is empty. Components beyond
2^27 after scaling, whose distances a long may not hold, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import scratch, store, table

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Pivots of the projection, and hash-chosen vectors among which they are looked for; neither changes a result.
PIVOTS, CANDIDATES = 16, 256
#: A pivot that stands lower than this over the simplex before it, in parts of its diameter, adds rounding, not shape.
FLAT = 1e-3
#: Rounding that the bounds allow for, in parts of the squared lengths.
SLACK = 1e-7
LARGEST = 1 << 27
ROWS = 4096


class Projection:
    """Coordinates of apexes over the simplex of pivots chosen among ``candidates``, each next one the highest over those before."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        points = np.asarray(candidates, np.float64)
        away = points - points[0]
        left = (away**2).sum(1)
        chosen, axes = [0], []
        floor = FLAT**2 * left.max(initial=0.0)
        while len(chosen) < most:
            i = int(left.argmax())
            if left[i] <= floor:
                break
            axis = away[i] - sum((a * (a @ away[i]) for a in axes), np.zeros(points.shape[1]))
            axes.append(axis / np.sqrt(axis @ axis))
            chosen.append(i)
            left = left - (away @ axes[-1]) ** 2
        self.pivots = points[chosen]
        base = self.pivots[1:] - self.pivots[0]
        self.lengths = (base**2).sum(1)
        #: The corners of the simplex behind the first one, which is the origin, in coordinates of its own.
        corners = np.linalg.cholesky(base @ base.T) if len(base) else np.zeros((0, 0))
        self.solve = np.linalg.inv(corners).T if len(base) else corners

    def squared(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        v = np.asarray(vectors, np.float64)
        return np.stack([((v - p) ** 2).sum(1) for p in self.pivots], 1)

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """The coordinates of each vector's apex, its altitude last, from its distances to the pivots."""
        d = self.squared(vectors)
        inside = ((d[:, :1] + self.lengths - d[:, 1:]) / 2) @ self.solve
        return np.concatenate([inside, np.sqrt(np.maximum(d[:, :1] - (inside**2).sum(1, keepdims=True), 0))], 1)


def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances between vectors and ``others``, rounding allowed for."""
    a, b = (apexes**2).sum(1)[:, None], (others**2).sum(1)
    slack = SLACK * (a + b + 1)
    low = np.stack([((apexes - o) ** 2).sum(1) for o in others], 1)
    return low - slack, low + 4 * apexes[:, -1:] * others[:, -1] + slack


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number of equal ones, and how many
    distances that took."""
    low, high = bounds(apexes, others)
    row, number = np.nonzero(low <= high.min(1, keepdims=True))
    distance = np.full(low.shape, np.iinfo(np.int64).max)
    for lo in range(0, len(row), 1 << 16):
        r, n = row[lo : lo + (1 << 16)], number[lo : lo + (1 << 16)]
        distance[r, n] = ((vectors[r] - centroids[n]) ** 2).sum(1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(best)), best], len(row)


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, x): the vectors that take part, their components scaled and rounded down."""
    e = F.col(column)
    fit = e.isNotNull() & (F.size(e) == components) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    scaled = F.transform(e, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(F.col("x"), lambda v: F.abs(v) <= LARGEST)
    kept = vectors.where(fit).select(F.col(key).alias("key"), scaled.alias("x"))
    return kept.select("key", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large for exact distances in longs")).cast("array<bigint>")).alias("x"))


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    key: str = "vec_id",
    column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    salt: str = "1",
    pivots: int = PIVOTS,
) -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every vector that takes part, stored, and the final centroids."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, column, components, scale)
    kind = whole.schema["key"].dataType

    def first(rows: DataFrame, mark: str, n: int) -> list[list[int]]:
        hashed = F.sha2(F.concat(F.lit(f"{mark}:"), F.col("key").cast("string")), 256)
        return [r.x for r in rows.select(hashed.alias("h"), "x").where("h is not null").orderBy("h", "x").limit(n).collect()]

    result = StructType([StructField(key, kind), *StructType.fromDDL("cluster int, distance bigint")])
    with scratch(spark, "centroids", ROWS) as keep:
        centroids = first(whole, salt, k)
        if not centroids:
            return store(spark.createDataFrame([], result), "clusters"), []
        projection = Projection(np.array(first(whole, "pivot", CANDIDATES), np.int64), pivots)
        width = len(projection.pivots)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                apexes = projection.apexes(_matrix(b.column("x"), components))
                yield pa.record_batch([b.column("key"), b.column("x"), pa.FixedSizeListArray.from_arrays(apexes.ravel(), width).cast(pa.list_(pa.float64()))], ["key", "x", "apex"])

        projected = StructType([*whole.schema.fields, *StructType.fromDDL("apex array<double>")])
        cached = keep(whole.mapInArrow(project, projected), "projected")

        def assigned(batches: Iterator[pa.RecordBatch], now: np.ndarray, others: np.ndarray):
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("x"), components)
                    yield b, x, *nearest(x, _matrix(b.column("apex"), width, np.float64), now, others)[:2]

        for _ in range(rounds):
            now = np.array(centroids, np.int64)
            others = projection.apexes(now)

            def sums(batches: Iterator[pa.RecordBatch], now=now, others=others) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(now), components + 1), object)  # whole numbers of any size
                for _, x, number, _ in assigned(batches, now, others):
                    for c in np.unique(number).tolist():
                        own = x[number == c]
                        total[c] += np.append(own.sum(0), len(own)).astype(object)
                at = [(c, p, Decimal(int(total[c, p]))) for c in range(len(now)) if total[c, -1] for p in range(components + 1)]
                if at:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*at), (pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["cluster", "place", "total"])

            met = cached.select("x", "apex").mapInArrow(sums, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
            found = {(r.cluster, r.place): int(r.total) for r in met.collect()}  # k * (components + 1) rows at most
            centroids = [[found[c, p] // found[c, components] for p in range(components)] if (c, 0) in found else was for c, was in enumerate(centroids)]

        now = np.array(centroids, np.int64)
        others = projection.apexes(now)
        names = to_arrow_type(kind)

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, number, distance in assigned(batches, now, others):
                yield pa.record_batch([b.column("key").cast(names), pa.array(number.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

        return store(cached.mapInArrow(label, result), "clusters"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op11_simplex_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance, with the inertia of its cluster and of all and its centroid's digest."""
    labelled, centroids = cluster(table(spark, sf_dir, "embeddings"))
    # A row for each centroid.
    parts = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia")).collect()
    whole = sum(int(r.cluster_inertia) for r in parts)
    rows = [(r.cluster, int(r.cluster_inertia), whole, centroid_digest(centroids[r.cluster])) for r in parts]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same by comparing all vectors with all centroids."""
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        "n AS (SELECT row_number() OVER (ORDER BY vec_id, x) AS rid, vec_id, x FROM v)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < 16)",
    ]
    distance = "list_sum(list_transform(list_zip(n.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for k in range(4):
        steps.append(
            f"a{k} AS (SELECT rid, vec_id, n.x, c.cluster, CAST({distance} AS BIGINT) AS distance FROM n, c{k} c"
            " QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c.cluster) = 1)"
        )
        if k < 3:
            steps += [
                f"s{k} AS (SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS m FROM (SELECT cluster, x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY ALL)",
                f"m{k} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY cluster)",
                f"c{k + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (cluster))",
            ]
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a3 a JOIN c3 c ON a.cluster = c.cluster"
    )


OP11_SQL = _sql()
