"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept; `run` writes every result as Parquet in
the shared folder and reads it again. All stages but the last return the columns they were
given; the last gives the packed pieces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact, language, mixing, near, packing
from tidewatch.session import shared_stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and letterless texts go."""
    return language.known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id."""
    return exact.unique_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return near.unique_documents(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; a second turn is a second row."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of every piece in sequences of 2048 tokens."""
    return packing.packed_digests(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The later stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
