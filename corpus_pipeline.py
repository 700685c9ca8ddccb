"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, contaminated documents go, secrets
are masked, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet in the shared folder and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import save, table
from lodestrata.llm.decontamination import decontaminate
from lodestrata.llm.ngram_jaccard import one_of_each
from lodestrata.llm.packing import pack
from lodestrata.llm.secrets import redact_secrets
from lodestrata.llm.toxicity import drop_toxic

#: No SQL can express the stages' models and tokenizers; tests/llm compares each with a plain version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents whose sets of five-word shingles reach a similarity of 0.8."""
    return one_of_each(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
