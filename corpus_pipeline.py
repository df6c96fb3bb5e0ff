"""From raw documents to token ids, in five stages over whole tables.

quality -> near_dup -> secrets -> mixing -> sentencepiece. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarlake.llm import mixing, near_dup, pieces, quality, secrets
from scholarlake.llm.common import saved, table, temporaries

#: SQL cannot express a tokenizer, a dynamic program or minwise trees; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go. Rows, ties and repeats stay as they are; an empty table stays empty."""
    return quality.keep(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: that of the smallest doc_id, once even if its row repeats.

    Documents without shingles (null and empty texts), rows without a doc_id, and texts linked with no other stay.
    """
    return near_dup.keep_one(docs, near_dup.Join(percent=80))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become <SECRET>; all documents stay."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.apply_mix(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and decoded of every row."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. A stage's own tables are deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporaries(spark):
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return docs
