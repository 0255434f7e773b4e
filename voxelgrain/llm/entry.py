"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelgrain.llm import decontamination, licenses, lm_scoring, ngram_join, quality_rules, ring_sharding, secret_scan, sentencepiece_codec, toxicity, warc
from voxelgrain.llm.common import table


def piece_model_path() -> str:
    """Where the public piece model is; the operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), piece_model_path())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "n": "n_shingles", "component": "component_id"})


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.assign(table(spark, sf_dir, "documents"), 16)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select(*kept)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passages=True)
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_ngram_join": op2_ngram_join,
        "op3_ring_sharding": op3_ring_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_warc": op5_warc,
        "op6_quality_rules": op6_quality_rules,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontamination": op9_decontamination,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.sql(), "op6_quality_rules": quality_rules.sql(), "op7_lm_scoring": lm_scoring.sql(), "op10_licenses": licenses.sql()}
