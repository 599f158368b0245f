"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns documents with the same columns, the last one the packed pieces. A
stage's result is written as Parquet and read again as the next one's documents.

Nulls: a null or empty text fails the quality rules and goes; rows with a null doc_id are near copies of nothing, are no
source of repeated passages, and are packed with their null id. Repeated rows are cleaned and packed once each; of a group
of near copies only the rows with its least doc_id stay. Very long texts are gone through in slices. An empty table gives an
empty result. Columns of any other name, clashing ones too, pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm import near_copies, packing, pii, quality, suffix_dedup
from tickspark.llm.common import forget, settled, small_batches, table

#: Bytes of a batch of rows that goes to a Python worker. What an executor's JVM allocates beside its heap for batches grows from
#: stage to stage, and less so with small ones.
BATCH = "2m"
#: Bytes of words that a worker of packing keeps.
WORDS = 64 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much."""
    small_batches(spark, BATCH)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; five-word shingles of 0.8 Jaccard similarity link two."""
    return near_copies.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document has too go."""
    return suffix_dedup.remove_duplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, most=WORDS)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("pii", personal_data), ("packing", pack)]

#: Fingerprints, suffix arrays and tokens are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs, f"stage-{name}")
            forget(before)  # nothing reads a stage's result after the next one's is written
            before = docs
    return docs
