"""Readers and writers of the other file formats: JSON lines, sidecars, vocabularies, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl_documents(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each line; a line without it is an error when it is read."""
    rows = spark.read.schema("text string, _corrupt_record string").json(path)
    return rows.select(F.coalesce("text", F.raise_error(F.lit("a document without text")).cast("string")).alias("text"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """``docs``: lines of the files, whether they parse or not."""
    return spark.read.text(path).agg(F.count("*").alias("docs"))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("num_docs long, docs_val long, docs_sha256 string, shuffle_seed long").json(path, multiLine=True)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token_id, piece, score``; the id is the line's place, so the file is read as one partition (65,536 lines at most)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("token_id", "line"))
    return lines.select(F.col("token_id").cast("long"), F.split_part("line", F.lit("\t"), F.lit(1)).alias("piece"), F.split_part("line", F.lit("\t"), F.lit(2)).cast("double").alias("score"))


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("val_bpb double, artifact_bytes long, memory_mb long, notes string").csv(path, sep="\t", header=True)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and the JSON text; fields are taken with ``get_json_object`` because their kinds differ."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
