"""A corpus pipeline: identified documents, one of each group of near copies, without secrets, mixed to targets, packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet in the shared folder and read again by the next stage, so a lost executor costs a stage's
tasks, not the run. Null and empty texts have no language and go at the first stage; stages given empty tables return
empty tables; repeated rows are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sampleloom.llm import credential_scan, langid, length_buckets, pareto_mix, setsketch
from sampleloom.llm.common import discard, release, small_batches, store, table

#: A document goes if no word of it comes so far from an even chance among the languages to certainty of its span's, by ratio.
LEAST_LANGUAGE = 0.25


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; learned from the documents whose language is given."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs), LEAST_LANGUAGE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return setsketch.one_of_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    small_batches(spark)
    return credential_scan.redact(docs, credential_scan.fit(docs), length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return pareto_mix.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every copy."""
    return length_buckets.pack(docs)


STAGES = [("language ID", identified), ("MinHash near-dedup", deduplicated), ("secret scans", redacted), ("mixing to target weights", mixed), ("packing", packed)]

#: Learned models, register bands and dynamic programs are not for SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, before, sf_dir), f"stage-{k}")
        release(spark)  # what the stage's result has read
        if k:
            discard(before)
        before = docs
    return docs
