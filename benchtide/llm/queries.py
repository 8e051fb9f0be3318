"""Query keys of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.llm import (decontaminate, langid, minhash, mixing, packing, pii, quality, repetition, resampling,
                           secrets, shards, suffixes, vectorcodes)
from benchtide.llm.common import held_out, prepare, table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if oracle is not None:
            ORACLES[key] = oracle.strip()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[key] = run
        return fn
    return deco


@register("op2_quality_classifier")
def q_quality(spark, sf_dir):
    """Scores every document; trained on labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.train(docs, labels)
    return quality.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op8_language_id")
def q_language(spark, sf_dir):
    """Predicts the language of every document; trained outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op10_quality_rules")
def q_rules(spark, sf_dir):
    """Repetition rules over every document."""
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


@register("op9_pack")
def q_pack(spark, sf_dir):
    """Packs the pieces of every document into sequences of at most 4096 tokens."""
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op6_token_shards")
def q_shards(spark, sf_dir):
    """Writes every document's tokens as shards in training order and reads them back."""
    rows = shards.materialise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("slot", "shard", "at", "n_tokens", "ids_crc32",
                       F.col("docs.doc_id").alias("doc_ids"))


@register("op5_secret_scan")
def q_secrets(spark, sf_dir):
    """Rule and network spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.train(docs))


@register("op1_decontaminate")
def q_decontaminate(spark, sf_dir):
    """Overlaps of every document with every benchmark item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_minhash_dedup")
def q_near(spark, sf_dir):
    """Near-duplicate group of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("_th", "_root")


@register("op4_suffix_dedup")
def q_suffixes(spark, sf_dir):
    """Repeated 100-byte strings removed from every document."""
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


@register("op7_pii")
def q_pii(spark, sf_dir):
    """Personal data and disclosing words of every document."""
    return pii.report(table(spark, sf_dir, "documents"))


@register("op11_vector_codes", vectorcodes.SQL)
def q_vector_codes(spark, sf_dir):
    """Product codes of every usable embedding."""
    return vectorcodes.code_report(table(spark, sf_dir, "embeddings"))


@register("op12_resample")
def q_resample(spark, sf_dir):
    """Importance weights of every document towards the benchmark, and the draw."""
    return resampling.resample_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_mix_sources", mixing.SQL)
def q_mix(spark, sf_dir):
    """What the mix of all sources takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))
