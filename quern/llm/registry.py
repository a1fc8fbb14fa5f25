"""The queries of this subpackage and their DuckDB twins, where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, lines, lm, minhash, quality, suffixes, toxicity, warc


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_minhash_near_dups": minhash.op2_minhash_near_dups,
        "op3_lm_score": lm.op3_lm_score,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_warc_index": warc.op6_warc_index,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality_rules": quality.op10_quality_rules,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_index": warc.ORACLE, "op10_quality_rules": quality.ORACLE}
