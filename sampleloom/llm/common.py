"""What the operators of this subpackage share: reading tables, cutting lineage, deterministic samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that hold whole texts end at so many rows or bytes. Texts can be very long, so the bytes count.
TEXT_BATCH_ROWS = 4096
TEXT_BATCH_BYTES = 4 << 20
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
#: Groups up to which a table with a row for each of them is broadcast.
BROADCAST_GROUPS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS, size: int = TEXT_BATCH_BYTES) -> None:
    """Bounds what a Python worker holds at once: ``size`` bytes of texts or one text. Results that are not stored yet run
    with these settings, so they stay; ``scratch`` puts them back."""
    for name, value in zip(BATCH_SETTINGS, (rows, size)):
        spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and all run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="sampleloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, lost executors or not."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


#: Tables that results read later on, by session; see ``lend``.
_lent: dict[str, list[str]] = {}


def lend(df: DataFrame, what: str) -> DataFrame:
    """``store`` for a table that a result reads only when it is computed, so that its maker can't delete it. Once the
    result is stored, ``release`` does."""
    spark = df.sparkSession
    path = new_path(spark, what)
    _lent.setdefault(spark.sparkContext.applicationId, []).append(path)
    return store(df, what, path)


def release(spark: SparkSession) -> None:
    """Deletes all lent tables of this session: nothing that is still to be computed may read them."""
    for path in _lent.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession, what: str, rows: int | None = TEXT_BATCH_ROWS) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that stores tables in a folder of one run, with ``small_batches`` meanwhile (but without rows); the folder is
    deleted and the settings are put back at the end, so results go elsewhere."""
    folder, number = new_path(spark, what), count()
    before = {name: spark.conf.get(name) for name in BATCH_SETTINGS if rows}
    if rows:
        small_batches(spark, rows)
    try:
        yield lambda df, name: store(df, name, f"{folder}/{name}-{next(number)}")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        _delete(spark, folder)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_digest(key: Column, text: Column) -> Column:
    """128 bits that tell rows apart by key and text, nulls by themselves."""
    part = lambda c, mark: F.coalesce(F.concat(F.lit(mark), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\x1f", part(key, "k"), part(text, "t")).cast("binary")))


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, by: str, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows for each value of ``by``, chosen by a hash of ``key``: the same rows at every run and layout.

    One counting pass over the two columns fixes each group's rate, so no group meets in one task. Rates are broadcast up to
    ``BROADCAST_GROUPS`` groups; beyond it the join shuffles and adaptive execution splits hot groups.
    """
    rates = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).select(by, F.least(F.lit(1.0), rows / F.col("_n")).alias("_rate"))
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    small = rates.count() <= BROADCAST_GROUPS
    return df.join(F.broadcast(rates) if small else rates, by).where(draw < F.col("_rate")).drop("_rate")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]

