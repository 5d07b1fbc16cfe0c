"""Corpus pipeline: toxicity, language ID, SimHash near-dedup, benchmark decontamination, and the mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, with
the rows they keep; the last returns the mix: doc_id, size, source_size, target and taken.

Defined results: null and empty texts have no language and go in the second stage; of repeated rows one stays in the
third; null ids and sources are kept; an empty table passes all stages empty; further columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import decontaminate, language_id, mixing, simhash, toxicity
from sedge.llm.common import remove, scratch, shared_dir
from sedge.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier takes for toxic go; it learns from those that are not held out."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is not told with a score of a half, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: Compression lengths, learned models and 64-bit hashes have no DuckDB form; tests run the stages one by one and compare run() with them.
#: The operators behind the stages are compared with brute force or held-out labels by their own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    Once a stage is written, its intermediate tables and what the stage before wrote are deleted: one copy of the documents stays,
    which the result reads.
    """
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
