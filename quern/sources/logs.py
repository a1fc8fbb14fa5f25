"""Training logs: text files whose lines follow a few grammars, as typed tables.

``read_log`` gives the lines of files; each function below picks the lines of one
grammar and takes their fields.  A field that a line lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, id, line``; the id is the line's place in its file, from 0."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("id", "line"))


def field(pattern: str, kind: str) -> Column:
    found = F.regexp_extract("line", pattern, 1)
    return F.when(found != "", found).cast(kind)


def step_lines(lines: DataFrame) -> DataFrame:
    """Lines such as ``step:1/9 train_loss:3.2 train_time:43ms step_avg:43.5ms``."""
    return lines.where(F.col("line").rlike(r"^step:\d+/\d+ ")).select(
        "id", field(r"^step:(\d+)/", "long").alias("step"), field(r"^step:\d+/(\d+)", "long").alias("steps"), field(r"train_loss:([\d.]+)", "double").alias("train_loss"),
        field(r"val_loss:([\d.]+)", "double").alias("val_loss"), field(r"val_bpb:([\d.]+)", "double").alias("val_bpb"), field(r"train_time:(\d+)ms", "long").alias("time_ms"), field(r"step_avg:([\d.]+)ms", "double").alias("step_avg"),
    )


def slash_lines(lines: DataFrame) -> DataFrame:
    """Lines such as ``1/9 train_loss: 3.2 train_time: 0.9m tok/s: 100``; minutes become milliseconds."""
    return lines.where(F.col("line").rlike(r"^\d+/\d+ ")).select(
        "id", field(r"^(\d+)/", "long").alias("step"), field(r"train_loss: ([\d.]+)", "double").alias("train_loss"), field(r"val_loss: ([\d.]+)", "double").alias("val_loss"), field(r"val_bpb: ([\d.]+)", "double").alias("val_bpb"),
        F.round(field(r"train_time: ([\d.]+)m", "double") * 60000).cast("long").alias("time_ms"), field(r"tok/s: (\d+)", "long").alias("tokens_per_s"),
    )


def final_scores(lines: DataFrame) -> DataFrame:
    scores = lines.where(F.col("line").rlike("^(final|quantized|ttt)"))
    return scores.select("id", F.regexp_extract("line", "^([a-z0-9_]+)[ :]", 1).alias("label"), field(r"val_loss[:=]([\d.]+)", "double").alias("val_loss"), field(r"val_bpb[:=]([\d.]+)", "double").alias("val_bpb"), field(r"eval_time:(\d+)ms", "long").alias("eval_ms"))


def settings(lines: DataFrame) -> DataFrame:
    of = lines.where(F.col("line").rlike("^  [a-z_]+: "))
    return of.select("id", F.regexp_extract("line", "^  ([a-z_]+): ", 1).alias("name"), F.regexp_extract("line", "^  [a-z_]+: (.*)$", 1).alias("setting"))


def sizes(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(r"\d bytes|MiB")).select("id", field(r"(\d+) bytes", "long").alias("bytes"), field(r"allocated: (\d+) MiB", "long").alias("peak_mib"))


def early_stops(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").startswith("stopping_early")).select("id", field(r"train_time:(\d+)ms", "long").alias("time_ms"), field(r"step:(\d+)/", "long").alias("step"))


def throughput(lines: DataFrame) -> DataFrame:
    """Milliseconds of a step so far; step 0 counts as 1."""
    timed = lines.where(F.col("line").rlike(r"train_time:\d+ms"))
    return timed.select("id", F.round(field(r"train_time:(\d+)ms", "long") / F.greatest(field(r"step:(\d+)/", "long"), F.lit(1)), 4).alias("step_ms"))
