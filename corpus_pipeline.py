"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's ``docs``. All but the last return the columns of ``documents``.

* quality rules: rows that the rules reject go.
* n-gram Jaccard join: of each component of near copies (80 % of all five-word shingles in common) the row with the smallest id stays, one of them if several have it.
* benchmark decontamination: rows that a benchmark item leaks into go, each judged by itself.
* secret scans: secrets are masked in the text, and ``n_chars`` follows; no row goes.
* SentencePiece: each text's ids, their digest, and that of the text decoded from them.

Null, empty and blank texts have no words, so the quality rules reject them; a stage called by itself takes them as its
operator says. Null ids are ids like others: of a group of copies, the row with an id stays. Rows that share a key are
told apart by their texts; of rows that share both, the near-duplicate stage keeps one, and the other stages decide
alike for all. Ties go to the smallest id. Very long texts are taken whole. An empty table gives an empty result, and
columns of any name beyond those of ``documents`` are carried along by all stages but the last.

As a stage's result is written before the next begins, each stage deletes what its predecessor kept in the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm import decontamination, ngram_join, quality_rules, secret_scan, sentencepiece_codec
from voxelgrain.llm.common import discard, fresh, noting, remove, table, written
from voxelgrain.llm.entry import piece_model_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage has in the shared folder, by application.
_kept: dict[str, list[str]] = {}


def _sweep(spark: SparkSession) -> None:
    remove(spark, _kept.pop(spark.sparkContext.applicationId, []))


def _stage(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(spark)
        with noting() as paths:
            out = stage(spark, docs, sf_dir)
        _kept[spark.sparkContext.applicationId] = paths
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is its id and its text: equal texts leak alike, and rows that only share an id are told apart.
    row = fresh(docs, "leak_row")
    told = docs.withColumn(row, F.struct(F.col("doc_id"), F.xxhash64("text")))
    return decontamination.drop_leaks(told, table(spark, sf_dir, "benchmark"), row, passages=True).drop(row)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(docs, piece_model_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("SentencePiece", tokens),
]

#: SQL can express neither the tokens nor the entropy windows; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
        if name != STAGES[0][0]:
            discard(before)
    _sweep(spark)
    return docs
