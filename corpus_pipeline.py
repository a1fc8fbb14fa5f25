"""A training corpus in five stages, each one operator of ``quern.llm``.

Every stage takes (spark, docs, sf_dir), where docs is a stored table, and works
on all that the stage before it kept; it first deletes the intermediate tables of
stages before it. In order: rows rejected by a quality rule go; repeated lines go; of each group of
near duplicates one document stays; documents that hold a benchmark item go; the
rest is encoded.  All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, lines, minhash, quality
from quern.llm.common import scratch_dir, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return lines.filter_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    tidy(spark)
    return minhash.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return decontaminate.filter_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, text``; the text is decoded from the ids."""
    tidy(spark)
    out = bpe.encode(docs)
    return out.select("doc_id", "n_tokens", "token_ids", out["decoded"].cast("string").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express byte-pair merges or edit-distance neighbourhoods at this size; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
