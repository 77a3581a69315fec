"""The corpus pipeline: five stages from ``documents`` to token records."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ermine.llm import decontam, mixing, records, simhash, toxicity  # noqa: E402
from ermine.llm.common import store  # noqa: E402
from ermine.llm.queries import tokenizer  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored at or above the threshold go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group stays, the one with the smallest id."""
    return simhash.keep_first(docs, shingle=4, radius=4, scan=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: repeats and cuts documents to the sources' quotas."""
    return mixing.mixed(docs, scan=True)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: writes token records and returns what is read back from them."""
    return records.encode_documents(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("records", write_records),
]

ORACLE_SQL = None  # fitted models and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs)
    return docs
