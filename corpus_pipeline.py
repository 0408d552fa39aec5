"""The corpus pipeline: its stages in order, each over all that its predecessor kept.

A stage takes documents and returns documents; its result is written as Parquet and read again before the next one. Rows
without a label, a copy or a benchmark passage just pass. Null and empty texts are scored, deduplicated and sampled like any
other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, jaccard, mixing, pii, quality
from tracemill.llm._shared import discard, parked, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them without labels to learn from. Null and empty texts are scored
    like any other, repeated rows stay or go together."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more.
    SimHash fingerprints propose the pairs that are within 4 bits, as in op3, and MinHash bands those that are farther.

    Null and empty texts are copies of each other. Of rows that repeat an id with one text one stays; rows without an id stay
    unless they are a copy of a document with one."""
    return jaccard.deduplicated(docs, shingle=5, least=(4, 5))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with [EMAIL], [IP], [CARD] or [PHONE] for personal data, and n_chars to match; null texts stay null."""
    return pii.redact_column(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens in the raked proportions of sources, languages and topics; null values are values of their own."""
    return mixing.mixed(docs, mixing.POWERS, share=0.5)


STAGES = [("quality", keep_good), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("personal_data", redact), ("mixing", mix)]

#: SQL can't express the learned stages; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = parked(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
