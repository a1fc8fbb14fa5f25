"""Windows over a token stream: frames, sliding windows, document chunks, rank slices, samplers."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import BUCKET, offsets

#: Sliding-window modes: how far starts go, and where scoring begins. They are not equivalent; V2 is canonical.
MODES = ("V1", "V2", "V3", "V4", "V5", "V6", "V7")


def usable(total: int, length: int) -> int:
    """Targets of a stream after cutting it to whole sequences."""
    return (total - 1) // length * length


def frames(spark: SparkSession, total: int, length: int) -> DataFrame:
    """Non-overlapping sequences: ``seq, x_start, x_end, y_start, y_end``; neighbours share one token."""
    i = F.col("id")
    return spark.range(usable(total, length) // length).select(i.alias("seq"), (i * length).alias("x_start"), ((i + 1) * length).alias("x_end"), (i * length + 1).alias("y_start"), ((i + 1) * length + 1).alias("y_end"))


def sliding(spark: SparkSession, n: int, length: int, stride: int, mode: str = "V2") -> DataFrame:
    """``ws, wlen, score_from`` of the windows over ``n`` targets in one of MODES."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    stop = {"V1": n, "V2": n - (length - stride), "V3": n - length, "V4": (n - length) // stride * stride + 1, "V5": n - length + 1, "V6": n + 1 - length, "V7": n}[mode]
    rows = spark.range(0, max(stop, 0), stride).select(F.col("id").alias("ws")).withColumn("wlen", F.least(F.col("ws") + length, F.lit(n)) - F.col("ws"))
    if mode == "V7":
        rows = rows.where((F.col("wlen") >= stride) | (F.col("ws") == 0))
    tail = F.greatest(F.col("wlen") - stride, F.lit(0))
    if mode == "V2":
        tail = F.lit(length - stride).cast("long")
    first_full = mode not in ("V4", "V6")
    return rows.withColumn("score_from", F.when(F.lit(first_full) & (F.col("ws") == 0), F.lit(0)).otherwise(tail).cast("long"))


def coverage(windows: DataFrame, n: int) -> DataFrame:
    """``times, positions``: how many targets are scored how often.

    Only the ends of the windows' spans are rows: a span adds one at its begin and
    takes one away behind its end, and a prefix sum in two levels counts the spans
    over each stretch between two ends.
    """
    begin, end = F.least(F.col("ws") + F.col("score_from"), F.lit(n)), F.least(F.col("ws") + F.col("wlen"), F.lit(n))
    marks = F.array(F.struct(begin.alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.greatest(begin, end).alias("pos"), F.lit(-1).cast("long").alias("d")))
    ends = windows.select(F.explode(marks).alias("e")).select("e.*")
    edge = windows.sparkSession.createDataFrame([(0, 0), (n, 0)], "pos long, d long")
    rows = ends.unionByName(edge).groupBy("pos").agg(F.sum("d").alias("d")).withColumn("all", F.lit(0))
    width = max(1, n // max(1, windows.count()) * BUCKET // 2)
    depth = offsets(rows, size="d", key="pos", group="all", bucket=width).withColumn("b", F.expr(f"pos div {width}"))
    following = rows.groupBy(F.expr(f"pos div {width}").alias("b")).agg(F.min("pos").alias("first")).select("b", F.lead("first").over(Window.orderBy("b")).alias("after"))  # a row for each bucket
    upto = F.coalesce(F.lead("pos").over(Window.partitionBy("b").orderBy("pos")), F.col("after"))
    runs = depth.join(following, "b").select((F.col("offset") + F.col("d")).alias("times"), (upto - F.col("pos")).alias("positions"))
    return runs.where("positions > 0").groupBy("times").agg(F.sum("positions").alias("positions"))


def document_spans(placed: DataFrame) -> DataFrame:
    """``doc_id, start, len`` in one stream; the length includes the next begin mark unless the document is last."""
    last = placed.agg(F.max("doc_id").alias("last_doc"))
    return placed.join(F.broadcast(last)).select("doc_id", F.col("offset").alias("start"), (F.col("n") + (F.col("doc_id") < F.col("last_doc")).cast("long")).alias("len"))


def document_chunks(spans: DataFrame, chunk: int, length: int) -> DataFrame:
    """``doc_id, ci, win_start, win_len, chunk_offset, chunk_len`` of every chunk of every document."""
    rows = spans.withColumn("pred", F.col("len") - 1).where("pred > 0").withColumn("chunks", F.expr(f"(pred + {chunk - 1}) div {chunk}"))
    rows = rows.withColumn("ci", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    begin = F.col("ci") * chunk
    end = F.when(F.col("ci") == F.col("chunks") - 1, F.col("pred")).otherwise((F.col("ci") + 1) * chunk)
    start = F.greatest(F.lit(0), end - length)
    return rows.select("doc_id", "ci", start.alias("win_start"), (end - start).alias("win_len"), (begin - start).alias("chunk_offset"), (end - begin).alias("chunk_len"))


def update_chunks(windows: DataFrame, n: int, chunk: int) -> DataFrame:
    """``windows`` with ``ci``: the update chunk of the first target that a window scores."""
    last = (n + chunk - 1) // chunk - 1
    return windows.withColumn("ci", F.least(F.expr(f"(ws + score_from) div {chunk}"), F.lit(last)))


def rank_of(i: str, total: int, world: int) -> Column:
    """The rank whose slice [total*r//world, total*(r+1)//world) holds index i."""
    return F.expr(f"(({i} + 1) * {world} - 1) div {total}")


def batch_spans(spark: SparkSession, steps: int, world: int, local: int) -> DataFrame:
    """Tokens that each rank takes from the shared stream at each step: ``step, rank, start, end``."""
    span = local + 1
    ranks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(world - 1).cast("long")))
    at = F.col("step") * (world * span) + F.col("rank") * span
    return spark.range(steps).select(F.col("id").alias("step"), ranks.alias("rank")).select("step", "rank", at.alias("start"), (at + span).alias("end"))


def stream_places(spans: DataFrame, total: int) -> DataFrame:
    """Epoch and place within the stream of spans of an endless, repeating stream."""
    return spans.select("*", (F.expr(f"start div {total}") + 1).alias("epoch"), (F.col("start") % total).alias("place"))


def micro_batches(total: int, length: int, most: int) -> list[int]:
    """Whole chunks, then the rest; all multiples of the sequence length."""
    left = total // length * length
    if left <= 0:
        raise ValueError("fewer tokens than one sequence")
    size = max(most // length * length, length)
    return [size] * (left // size) + ([left % size] if left % size else [])


def coprime_stride(blocks: int, seed: int) -> int:
    """A stride without a common factor with ``blocks``: the first one at or after seed modulo blocks."""
    if blocks <= 1:
        return 1
    return next(s for s in (1 + (seed + k) % (blocks - 1) for k in range(blocks)) if gcd(s, blocks) == 1)


def coprime_order(spark: SparkSession, blocks: int, start: int, stride: int) -> DataFrame:
    """``j, block``: a permutation of all blocks for each cycle."""
    return spark.range(blocks).select(F.col("id").alias("j"), ((F.lit(start) + F.col("id") * stride) % blocks).alias("block"))


def shuffled_order(sequences: DataFrame, seed: int, shard: str = "shard_id", seq: str = "seq") -> DataFrame:
    """A reproducible order of sequences in each shard, by a hash of (seed, shard, sequence)."""
    w = Window.partitionBy(shard).orderBy(F.xxhash64(F.lit(seed), shard, seq), seq)
    return sequences.withColumn("draw", F.row_number().over(w).cast("long"))
