"""Documents to packed training sequences: quality rules, near-dedup, secret scans, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

A null text is the empty text to every stage. Repeated rows are documents of their own, of which near-dedup keeps one;
ties go to the least doc_id, nulls last; an empty table gives an empty result; further columns come through, whatever their
names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import scratch_path
from kindred.llm.mixing import mix_documents
from kindred.llm.near_dedup import drop_near_duplicates
from kindred.llm.packing import pack_documents
from kindred.llm.quality import filter_quality
from kindred.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; see ``quality.filter_quality``. Null and empty texts are rejected."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every document stays, null texts stay null."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the sources' target weights ask. Those without a word have nothing to take."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their sequence and place. A repeated row has its own pieces."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scans", secrets), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: No SQL expresses expectation maximisation, SimHash links or tokenisers; ``tests/llm/test_pipeline.py`` holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
