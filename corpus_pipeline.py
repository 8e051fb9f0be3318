"""Corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows that the stage before kept.  SQL can't express
the packing (a search) and the tokenizer, so there is no ``ORACLE_SQL``; the
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchtide.llm import decontaminate, minhash, packing, pii, repetition
from benchtide.llm.common import prepare, stage, table, unstage

# per cent; the general rule for near copies (op3 has a limit of its own)
NEAR_SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the repetition rules reject."""
    prepare(spark)
    return repetition.keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    prepare(spark)
    return minhash.drop_near_duplicates(docs, similarity=NEAR_SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with an item of ``benchmark``."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; n_chars follows."""
    prepare(spark)
    return pii.sanitise(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(packing.cut_documents(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("decontamination", benchmark_decontamination), ("pii", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
