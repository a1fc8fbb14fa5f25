"""Byte accounting and compression metrics over token streams with a loss column.

The engine has no model: losses are an input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabularies up to this many rows are broadcast as lookup tables.
LUT_ROWS = 65_536


def byte_lut(vocab: DataFrame, specials: int = 4) -> DataFrame:
    """``token_id, base_bytes, has_leading_space, is_boundary`` of ``vocab(token_id, piece)``.

    Special pieces count no bytes and are boundaries; a byte piece counts one; a
    leading space mark is taken off and flagged.
    """
    special = F.col("token_id") < specials
    byte = F.col("piece").rlike("^<0x[0-9A-F]{2}>$")
    space = ~special & ~byte & F.col("piece").startswith("▁")
    size = F.when(special, 0).when(byte, 1).otherwise(F.octet_length(F.regexp_replace("piece", "^▁", "")))
    return vocab.select("token_id", size.cast("long").alias("base_bytes"), space.alias("has_leading_space"), special.alias("is_boundary"))


def target_bytes(pairs: DataFrame, lut: DataFrame) -> DataFrame:
    """``pairs(prev, tgt, ...)`` with ``bytes``: the target's bytes, and its space unless a boundary is before it."""
    small = F.broadcast(lut) if lut.count() <= LUT_ROWS else lut
    t = small.select(F.col("token_id").alias("tgt"), "base_bytes", "has_leading_space")
    p = small.select(F.col("token_id").alias("prev"), "is_boundary")
    extra = (F.col("has_leading_space") & ~F.col("is_boundary")).cast("long")
    return pairs.join(t, "tgt").join(p, "prev").withColumn("bytes", F.col("base_bytes") + extra).drop("base_bytes", "has_leading_space", "is_boundary")


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    return nll / F.log(F.lit(2.0)) / n_bytes


def loss_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums and the two scores of ``rows(nll, bytes)``, for each key."""
    agg = rows.groupBy(*keys).agg(F.sum("nll").alias("nll"), F.count("*").alias("tokens"), F.sum("bytes").alias("n_bytes"))
    return agg.select(*keys, "tokens", "n_bytes", F.round(F.col("nll") / F.col("tokens"), 6).alias("val_loss"), F.round(bits_per_byte(F.col("nll"), F.col("n_bytes")), 6).alias("val_bpb"))
