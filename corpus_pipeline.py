"""A training-data pipeline over `documents`: quality, near duplicates, benchmark passages, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of `documents`. Null and empty texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, fmindex, jaccard, pii, quality
from textloom.llm.common import bounded, table, written


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside fold 0, doesn't reject."""
    bounded(spark)
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component; links at a Jaccard similarity of 0.8 of five-word shingles."""
    bounded(spark)
    return jaccard.representatives(docs, words=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` are cut out of the texts."""
    bounded(spark)
    return _measured(fmindex.removed(docs, table(spark, sf_dir, "benchmark")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities have surrogates."""
    bounded(spark)
    return _measured(pii.replaced(docs, pii.session_key(spark)).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    bounded(spark)
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("PII", replace_personal_data),
    ("byte-level BPE", encode),
]
#: SQL can't express the stages; test_pipeline_by_brute_force holds them against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
