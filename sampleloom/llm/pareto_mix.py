"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document's expected copies are its source's target over the source's weighted size, times its own weight. Whole
copies are certain; the fraction is drawn: documents of a source are ranked by their random odds divided by their
inclusion odds, and the front of that order is taken up to the words that are still due (the fixed size is counted in
words). Documents that would overshoot are passed over and the rest of the order fills the gap, ``PASSES`` times.

The cut is found without bringing a source into one task: ranks fall into bins, words are summed by bin, a running
sum over bins names the bin of the cut, and only that bin's documents are ranked one by one.

Null texts have size 0 and are taken 0 times as words; null sources form one source that comes last. Random numbers
are a hash of the key, so reruns agree; ties go to the smaller key, then the smaller size. Repeated rows are rows of
their own. An empty table gives an empty mix. Texts may have any length: only their words are counted. Extra columns do not
take part, and come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_GROUPS, free_name, lend, scratch, store, table

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: No document and no source is taken more often.
MOST = 2
BINS = 1 << 16
PASSES = 3


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, newline, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources in code-point order get the repeating weights; what exceeds ``most`` times
    a source's size is shared again by weight. The level at which it settles follows from sources sorted by room."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    room = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", weight.cast("double")).withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = by.withColumn("_due", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(room), F.lit(0.0)))
    by = by.withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(room), F.lit(0.0)))
    # The quotient rises while a source with too little room leaves and falls from then on: its largest value settles.
    by = by.withColumn("_level", F.max(F.col("_due") / F.col("_left")).over(whole))
    return by.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Adds the columns of the sources' table; null sources match."""
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _fill(rows: DataFrame, small: bool) -> DataFrame:
    """(source, _bin, _words, _room): for each source, the bin that holds the cut, and the words that are due in it."""
    binned = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.min("_due").alias("_room"))
    running = F.sum("_words").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    cut = binned.withColumn("_before", F.coalesce(running, F.lit(0)))
    cut = cut.where((F.col("_before") <= F.col("_room")) & (F.col("_before") + F.col("_words") > F.col("_room")))
    return cut.select("source", F.col("_bin").alias("_cut"), (F.col("_room") - F.col("_before")).alias("_room"))


def sample(sizes: DataFrame, sources: DataFrame, small: bool, passes: int = PASSES, keep: Callable[[DataFrame, str], DataFrame] = lend) -> DataFrame:
    """Copies of each row of (key, source, size, weight): certain ones plus the Pareto sample."""
    rows = with_sources(sizes, sources, small)
    expected = F.when(F.col("source_weighted") > 0, F.col("target") * F.col("weight") / F.col("source_weighted")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_expected", expected).withColumn("_certain", F.floor("_expected"))
    rows = rows.withColumn("_pi", F.col("_expected") - F.col("_certain"))
    u = uniform(F.col("key"))
    # u / (1 - u) over pi / (1 - pi); rows that nothing is due of have no rank
    rows = rows.withColumn("_q", F.when(F.col("_pi") > 0, u / (1 - u) * (1 - F.col("_pi")) / F.col("_pi")))
    rows = rows.withColumn("_bin", F.floor(BINS * F.col("_q") / (1 + F.col("_q")))).withColumn("_drawn", F.lit(0))
    certain = rows.groupBy("source").agg(F.sum(F.col("_certain") * F.col("size")).alias("_sure"))
    rows = with_sources(rows, certain, small).withColumn("_due", F.col("target") - F.col("_sure"))
    for _ in range(passes):
        free = (F.col("_drawn") == 0) & F.col("_q").isNotNull() & (F.col("size") <= F.col("_due"))
        cuts = _fill(rows.where(free), small)
        joined = with_sources(rows.withColumn("_free", free), cuts, small)
        joined = joined.withColumn("_edge", F.col("_free") & F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False)))
        # Bins before the cut are taken whole, all of them where no bin holds a cut; rows of the edge are ranked.
        edge = Window.partitionBy("source").orderBy("_q", "key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
        ranked = joined.where("_edge").withColumn("_take", F.sum("size").over(edge) <= F.col("_room"))
        others = joined.where(~F.col("_edge")).withColumn("_take", F.col("_free") & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))))
        rows = keep(others.unionByName(ranked).withColumn("_drawn", F.when(F.col("_take"), 1).otherwise(F.col("_drawn"))).drop("_free", "_edge", "_take", "_cut", "_room"), "mix")
        taken = rows.groupBy("source").agg(F.sum(F.col("_drawn") * F.col("size")).alias("_sum"))
        rows = with_sources(rows, taken, small).withColumn("_due", F.col("target") - F.col("_sure") - F.col("_sum")).drop("_sum")
    return rows.withColumn("copies", (F.col("_certain") + F.col("_drawn")).cast("int")).drop(*(c for c in rows.columns if c.startswith("_")))


def mix(docs: DataFrame, key: str = "doc_id", weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, keep: Callable[[DataFrame, str], DataFrame] = lend) -> DataFrame:
    """(key, tie, source, size, source_size, target, copies) of every row; ``tie`` is a hash of the text. The result reads
    tables that ``keep`` stores.

    ``weight`` makes documents of a source unequally likely; with weights, a document's copies are its expected number
    rounded up or down, which may exceed ``most``.
    """
    slim = docs.select(F.col(key).alias("key"), F.col("source").alias("source"), words(F.col("text")).alias("size"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), F.xxhash64("text").alias("tie"))
    slim = keep(slim, "mix-sizes")
    sources = with_sources(source_targets(slim, weights, share, most), slim.groupBy("source").agg(F.sum(F.col("size") * F.col("weight")).alias("source_weighted")), False)
    sources = keep(sources, "mix-sources")
    small = sources.count() <= BROADCAST_GROUPS
    return sample(slim, sources, small, keep=keep).withColumnRenamed("key", key)


def repeated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix, all columns as they are, each as often as the mix takes it.

    Equal ids with equal texts of one source are the same row here; their copies are added.
    """
    tie, k, t, src, n, copy = (free_name(docs.columns, x) for x in ("_tie", "_k", "_t", "_s", "_copies", "_copy"))
    with scratch(docs.sparkSession, "mix", None) as keep:
        copies = mix(docs, key, keep=keep, **options).groupBy(F.col(key).alias(k), F.col("tie").alias(t), F.col("source").alias(src)).agg(F.sum("copies").cast("int").alias(n)).where(F.col(n) > 0)
        copies = lend(copies, "copies")
    rows = docs.withColumn(tie, F.xxhash64("text")).dropDuplicates([key, tie, "source"])
    met = rows.join(copies, F.col(key).eqNullSafe(F.col(k)) & (F.col(tie) == F.col(t)) & F.col("source").eqNullSafe(F.col(src)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    with scratch(spark, "mix", None) as keep:
        mixed = mix(table(spark, sf_dir, "documents"), keep=keep)
        return store(mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")), "mixed")


OP7_SQL = """
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0) AS due, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS lft
       FROM s2 WINDOW r AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max(due / lft) AS level FROM s3),
tg AS (SELECT source, source_size, least(cap, level * w) AS target FROM s3, lv),
d0 AS (SELECT slim.*, source_size, target, CASE WHEN source_size > 0 THEN target * 1.0::DOUBLE / source_size ELSE 0 END AS e
       FROM slim JOIN tg ON slim.source IS NOT DISTINCT FROM tg.source),
d1 AS (SELECT *, floor(e) AS certain, e - floor(e) AS pi FROM d0),
d2 AS (SELECT *, CASE WHEN pi > 0 THEN u / (1 - u) * (1 - pi) / pi END AS q,
       target - sum(floor(e) * size) OVER (PARTITION BY source) AS due FROM d1),
p1 AS (SELECT *, q IS NOT NULL AND size <= due AND sum(CASE WHEN q IS NOT NULL AND size <= due THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= due AS t1 FROM d2),
e1 AS (SELECT *, due - coalesce(sum(size) FILTER (WHERE t1) OVER (PARTITION BY source), 0) AS due1 FROM p1),
p2 AS (SELECT *, q IS NOT NULL AND NOT t1 AND size <= due1 AND sum(CASE WHEN q IS NOT NULL AND NOT t1 AND size <= due1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= due1 AS t2 FROM e1),
e2 AS (SELECT *, due1 - coalesce(sum(size) FILTER (WHERE t2) OVER (PARTITION BY source), 0) AS due2 FROM p2),
p3 AS (SELECT *, q IS NOT NULL AND NOT t1 AND NOT t2 AND size <= due2 AND sum(CASE WHEN q IS NOT NULL AND NOT t1 AND NOT t2 AND size <= due2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= due2 AS t3 FROM e2)
SELECT doc_id, size, source_size, target,
       CAST((certain + CASE WHEN t1 OR t2 OR t3 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p3
"""
