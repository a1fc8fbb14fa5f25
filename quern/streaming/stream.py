"""An endless token stream as a live query: shard files arrive one by one and are counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import token_count


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """Documents and byte tokens of each source so far."""
    return stream.groupBy("source").agg(F.count("*").alias("docs"), F.sum(token_count(F.col("text"))).alias("tokens"))
