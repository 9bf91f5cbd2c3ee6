"""The plain tables read as signals: long frames (clip, channel, frame, sample), events, notes and effects.

Samples are 32-bit floats; positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_RATE = 48_000
EMB_RATE = 1000
#: Lines that a task has of clips made from them, or one clip's if it has more.
LINES_A_TASK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the lines are dealt to: more lines are more tasks, not larger ones, whatever the session's number of
    shuffle partitions. Parquet files know their rows without being read."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def line_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, l, r): a stereo clip for each supplier, its lines in order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").repartition(line_tasks(spark, sf_dir), "l_suppkey").select(
        F.col("l_suppkey").alias("clip"),
        (F.row_number().over(order) - 1).cast("bigint").alias("frame"),
        ((F.col("l_quantity") - 25.5) / 25.5).cast("float").alias("l"),
        ((F.col("l_discount") - 0.05) * 10).cast("float").alias("r"),
    )


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stereo clips in long form."""
    return line_stereo(spark, sf_dir).select("clip", F.posexplode(F.array("l", "r")).alias("channel", "sample"), "frame").select("clip", "channel", "frame", "sample")


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mono clip for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(0).alias("channel"), F.posexplode("embedding").alias("frame", "sample")).withColumn("frame", F.col("frame").cast("bigint")).select("clip", "channel", "frame", "sample")


def emb_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, rate, samples): the mono clips with their samples in arrays."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(EMB_RATE).alias("rate"), F.col("embedding").alias("samples"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frame, name, key, gain): events as sounds that start at a frame of a millisecond clock."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.floor(micros / 1000).cast("bigint").alias("frame"), F.col("event_type").alias("name"), F.col("user_id").alias("key"), F.col("value").alias("gain"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note, track, start, length, midi, volume, gate, velocity) in ticks: a note for each order."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("note"),
        (F.col("o_custkey") % 8).cast("int").alias("track"),
        (o * 7 % 20_000).alias("start"),
        (12 + o % 5 * 12).alias("length"),
        (36 + o % 60).cast("int").alias("midi"),
        (o % 16).cast("int").alias("volume"),
        (1 + o % 8).cast("int").alias("gate"),
        (1 + F.floor(F.col("o_totalprice")).cast("bigint") % 127).cast("int").alias("velocity"),
    )


#: The same relations as common table expressions of SQL.
LINE_SQL = """line AS MATERIALIZED (SELECT l_suppkey AS clip, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
  CAST((l_quantity - 25.5::DOUBLE) / 25.5::DOUBLE AS FLOAT) AS l, CAST((l_discount - 0.05::DOUBLE) * 10::DOUBLE AS FLOAT) AS r FROM lineitem),
frames AS MATERIALIZED (SELECT clip, 0 AS channel, frame, l AS sample FROM line UNION ALL SELECT clip, 1, frame, r FROM line)"""
EMB_SQL = "frames AS MATERIALIZED (SELECT vec_id AS clip, 0 AS channel, i - 1 AS frame, embedding[i] AS sample FROM embeddings, generate_series(1, 64) t(i))"
TRIGGER_SQL = "triggers AS (SELECT event_id AS seq, CAST(floor(epoch_us(ts) / 1000.0::DOUBLE) AS BIGINT) AS frame, event_type AS name, user_id AS key, value AS gain FROM events)"
NOTE_SQL = """notes AS (SELECT o_orderkey AS note, CAST(o_custkey % 8 AS INT) AS track, o_orderkey * 7 % 20000 AS start, 12 + o_orderkey % 5 * 12 AS length,
  CAST(36 + o_orderkey % 60 AS INT) AS midi, CAST(o_orderkey % 16 AS INT) AS volume, CAST(1 + o_orderkey % 8 AS INT) AS gate,
  CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 127 AS INT) AS velocity FROM orders)"""
