"""Packing into optimal length buckets: dynamic programming over the global histogram, then token-budget batches.

Every document is padded to its bucket's upper length. The bucket lengths that minimise all padding follow exactly from
a dynamic program over the histogram of lengths of all documents, a row for each length. Documents of so many different
lengths have at least half the square of that number in words, so the histogram has at most the square root of twice all
words as rows (a few million for 100 TB), and the program takes time in proportion to them. Inside a bucket, documents are numbered in a hashed order and cut into batches of as many rows as the
token budget holds; a document over the budget is a batch of its own. Numbering deals each bucket to shards of about
``SHARD_ROWS`` rows, so that no bucket meets in one task.

Null and empty texts have length 0 and go to the lowest bucket. Ties and repeated rows keep rows of their own. An empty
table gives no batches. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lend, scratch, store, table

BUCKETS = 12
BUDGET = 32_768
SHARD_ROWS = 2000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every length that occurs, ascending, and its number of rows."""
    got = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("length")
    return got["length"].to_numpy(np.int64), got["rows"].to_numpy(np.int64)


def boundaries(tops: np.ndarray, rows: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least sum of padded lengths, in whole numbers.

    best(k, j) = min over i of best(k - 1, i) + tops[j] * rows in (i, j]. For each i this is a line in tops[j] whose slope
    falls with i, so a layer is one walk along the lower hull of the lines.
    """
    n = len(tops)
    if not n:
        return []
    if n <= buckets:
        return tops.tolist()
    length, below = tops.tolist(), [0, *np.cumsum(rows).tolist()]
    best: list[int | None] = [0] + [None] * n
    choices = []
    for _ in range(buckets):
        new: list[int | None] = [0] + [None] * n
        choice, hull, at = [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            if (new_at := best[j - 1]) is not None:
                while len(hull) > 1:
                    (b1, m1, _), (b2, m2, _) = hull[-2:]  # the last line goes if the new one beats it where it would begin
                    if (new_at - b1) * (m2 - m1) > (b2 - b1) * (below[j - 1] - m1):
                        break
                    hull.pop()
                hull.append((new_at, below[j - 1], j - 1))
                at = min(at, len(hull) - 1)
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] - x * hull[at + 1][1] < hull[at][0] - x * hull[at][1]:
                at += 1
            new[j], choice[j] = x * below[j] + hull[at][0] - x * hull[at][1], hull[at][2]
        choices.append(choice)
        best = new
    out, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(tops[j - 1]))
        j = choice[j]
    return out[::-1]


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, keep: Callable[[DataFrame, str], DataFrame] = lend) -> DataFrame:
    """(key, length, bucket, padded, batch, slot): the bucket of each row, and its place in its batch of that bucket. The
    result reads a table that ``keep`` stores."""
    # Rows are dealt by a number of their own, so repeated ids of one length are not one shard's.
    lengths = docs.select(F.col(key).alias("key"), (word_count(F.col("text")) if length is None else F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint"))).alias("length"), F.monotonically_increasing_id().alias("row"))
    lengths = keep(lengths, "pack-lengths")
    tops, rows = histogram(lengths)
    bounds = boundaries(tops, rows, buckets) or [0]
    held = np.bincount(np.searchsorted(bounds, tops), rows, len(bounds)).astype(np.int64)
    padded = F.element_at(F.lit(bounds), F.col("bucket") + 1)
    shards = F.element_at(F.lit([int(x) // shard_rows + 1 for x in held]), F.col("bucket") + 1)
    placed = lengths.withColumn("bucket", F.size(F.filter(F.lit(bounds[:-1] or [bounds[0]]), lambda b: b < F.col("length"))) if len(bounds) > 1 else F.lit(0))
    placed = placed.withColumn("padded", padded.cast("bigint")).withColumn("_order", F.xxhash64(F.lit("pack"), "key", "length"))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("_order", "row"), shards.cast("bigint")))
    counts = placed.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_order", "key", "length", "row")) - 1
    numbered = placed.withColumn("_number", number).join(offsets, ["bucket", "_shard"])
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1).cast("bigint"))).cast("bigint"))
    place = F.col("_before") + F.col("_number")
    return numbered.select(F.col("key").alias(key), "length", "bucket", "padded", F.floor(place / room).cast("bigint").alias("batch"), F.pmod(place, room).cast("bigint").alias("slot"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document, its words as tokens."""
    with scratch(spark, "packing", None) as keep:
        return store(pack(table(spark, sf_dir, "documents"), keep=keep), "packed")
