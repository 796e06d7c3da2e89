"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Rows that a filtering stage rejects go, others
stay as they are; the secret scan rewrites only texts that hold secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillform.llm import decontaminate, packing, q_packing, quality, secrets, simhash
from quillform.llm.common import materialize, remove, stored, table  # noqa: F401


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail and go; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Null ids come last; of repeated rows one stays; texts without words are one group; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; empty tables on either side take nothing away.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced.

    Null texts stay null and texts without secrets as they are; repeated rows change alike; an empty table stays empty.
    """
    return secrets.redact(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.

    Null and empty texts are one piece, the end; null sources are a queue; repeated rows are packed each; an empty table has
    no pieces.
    """
    return packing.pack(docs).select(*q_packing.COLUMNS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mixture_packing", mixture_packing),
]

#: No SQL has XXH64 with a seed, trains a forest or tokenizes; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, done = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)  # the stage that read it is done
        before = done
    return docs
