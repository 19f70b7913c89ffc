"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage works on all rows that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brooklog.llm.decontamination import drop_contaminated
from brooklog.llm.language_id import keep_languages
from brooklog.llm.packing import op6_packing
from brooklog.llm.pii import redact
from brooklog.llm.shared import read_table, write_table
from brooklog.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognised language go; lang becomes the prediction."""
    return keep_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with Jaccard similarity 0.8 or more on five-word shingles the one of the smallest id stays."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts are masked."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their places in packed sequences."""
    return op6_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]
#: Learned models, fingerprints and tokenizers have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back, so nothing is computed twice."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = write_table(docs, f"stage-{name}")
    return docs
