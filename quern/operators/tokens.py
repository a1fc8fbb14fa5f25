"""Documents to token streams: byte tokens, framing, splits, offsets, shard packing, counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, BYTE_OFFSET, BYTE_VOCAB = 1, 4, 260
#: Documents in one bucket of the two-level prefix sum.
BUCKET = 4096
#: Bytes of text that a Python step works on at once; a longer text is worked on alone.
SLICE = 1 << 20


def text_slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut into rows with at most ``most`` bytes in its second column, texts or bytes; what is made of them is bounded, too."""
    text = batch.column(1).cast(pa.large_binary())
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        end = max(int(np.searchsorted(off, off[at] + most, "right")) - 1, at + 1)
        yield batch.slice(at, end - at)
        at = end


def byte_tokens(docs: DataFrame, bos: bool = True) -> DataFrame:
    """``doc_id, tokens array<int>``: each UTF-8 byte plus 4, behind a begin mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            if bos:  # room for the marks is made among bytes, a quarter of the tokens' size
                data = np.insert(data, off[:-1], 0)
                off = off + np.arange(len(off))
            data = data.astype(np.int32)
            data += BYTE_OFFSET
            if bos:
                data[off[:-1]] = BOS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(data))], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<int>")


def byte_pieces(parts: DataFrame) -> DataFrame:
    """``split, shard_id, doc_id, tokens binary`` of packed parts with their document's ``text``: byte tokens as 16-bit little-endian ids.

    Only the part's bytes leave the text; as ids they take twice their place, as an array of int four times.
    """
    first = F.greatest("lo", F.lit(1))  # place 0 is the begin mark
    piece = F.substring(F.coalesce(F.col("text"), F.lit("")).cast("binary"), first.cast("int"), (F.col("hi") - first).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            held = batch.column(1).cast(pa.large_binary())
            off = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            ids = np.frombuffer(held.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype("<u2") + np.uint16(BYTE_OFFSET)
            begins = np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool)
            off = off - off[0]
            ids = np.insert(ids, off[:-1][begins], BOS).astype("<u2")
            off = (off + np.concatenate([[0], np.cumsum(begins)])) * 2
            tokens = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), tokens], ["split", "shard_id", "doc_id", "tokens"])

    rows = parts.select("split", piece.alias("piece"), "shard_id", "doc_id", (F.col("lo") == 0).alias("begins"))
    return rows.mapInArrow(run, "split string, shard_id long, doc_id long, tokens binary")


def token_count(text: Column) -> Column:
    """Byte tokens of a text (null: none) with its begin mark; needs no tokens."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def trainer_text(docs: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Text for a tokenizer trainer: NUL becomes a space, ends are stripped, empty texts go.

    ``max_docs`` counts documents before empty ones go.
    """
    rows = docs if max_docs is None else docs.where(F.col("doc_id") < max_docs)
    clean = F.regexp_replace(F.translate("text", "\0", " "), r"(?U)^\s+|\s+$", "")
    return rows.select("doc_id", clean.alias("text")).where("text <> ''")


def first_bad_token(tokens: DataFrame, vocab: int) -> DataFrame:
    """Documents with a token outside 0..vocab-1, and the first such token."""
    bad = F.filter("tokens", lambda t: (t < 0) | (t >= vocab))
    return tokens.select("doc_id", bad.alias("bad")).where(F.size("bad") > 0).select("doc_id", F.col("bad")[0].alias("first_bad"))


def split_of(doc_id: Column, num_val: int) -> Column:
    """The first ``num_val`` documents are for validation."""
    return F.when(doc_id < num_val, "val").otherwise("train")


def offsets(counts: DataFrame, size: str = "n", key: str = "doc_id", group: str = "split", bucket: int = BUCKET) -> DataFrame:
    """``counts`` with ``offset``: the sum of ``size`` over earlier keys of the group.

    A two-level prefix sum: sums of key buckets are ordered in one small window,
    and each bucket is ordered on its own, so no task sees all rows.
    """
    b = F.expr(f"{key} div {bucket}")
    rows = counts.withColumn("__b", b)
    sums = rows.groupBy(group, "__b").agg(F.sum(size).alias("__s"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [group, "__b"]).withColumn("offset", F.col("__base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__b", "__base")


def bucket_width(rows: DataFrame, key: str = "doc_id", per: int = BUCKET) -> int:
    """Keys of a bucket that holds ``per`` rows on average, however sparse the keys are."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    return max(1, (high - low + 1) * per // n) if n else per


def document_offsets(docs: DataFrame, num_val: int) -> DataFrame:
    """``doc_id, split, n, offset``: token counts and places in the split's stream."""
    counts = docs.select("doc_id", split_of(F.col("doc_id"), num_val).alias("split"), token_count(F.coalesce("text", F.lit(""))).alias("n"))
    return offsets(counts, bucket=bucket_width(docs)).select("doc_id", "split", "n", "offset")


def part_ordinals(placed: DataFrame, shard_size: int) -> DataFrame:
    """``ordinal, split, shard_id, doc_id``: all parts of all shards in one order, validation first, from 1."""
    parts = placed.withColumn("first", F.expr(f"offset div {shard_size}")).withColumn("parts", F.expr(f"(offset + n - 1) div {shard_size}") - F.col("first") + 1)
    ranked = offsets(parts.drop("offset"), size="parts", bucket=bucket_width(placed))
    val = parts.agg(F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("parts"))), F.lit(0)).alias("before"))
    each = ranked.join(F.broadcast(val)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    before = F.when(F.col("split") == "train", F.col("before")).otherwise(0)
    return each.select((before + F.col("offset") + F.col("k") + 1).alias("ordinal"), "split", (F.col("first") + F.col("k")).alias("shard_id"), "doc_id")


def pack(placed: DataFrame, shard_size: int) -> DataFrame:
    """``split, shard_id, doc_id, lo, hi``: the part of each document in each shard; documents straddle shards."""
    first, last = F.expr(f"offset div {shard_size}"), F.expr(f"(offset + n - 1) div {shard_size}")
    rows = placed.withColumn("shard_id", F.explode(F.sequence(first, last)))
    lo = F.greatest("offset", F.col("shard_id") * shard_size)
    hi = F.least(F.col("offset") + F.col("n"), (F.col("shard_id") + 1) * shard_size)
    return rows.select("split", "shard_id", "doc_id", (lo - F.col("offset")).alias("lo"), (hi - F.col("offset")).alias("hi"))


def shard_stats(parts: DataFrame) -> DataFrame:
    return parts.groupBy("split", "shard_id").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("tokens"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum((F.col("lo") == 0).cast("long")).alias("docs_begun")
    )


def export_counters(placed: DataFrame, shard_size: int) -> DataFrame:
    """Documents, files and tokens of each split and in total (three by three counters)."""
    by = placed.groupBy("split").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).withColumn("files", F.expr(f"(tokens + {shard_size - 1}) div {shard_size}"))
    return by.rollup("split").agg(F.sum("docs").alias("docs"), F.sum("files").alias("files"), F.sum("tokens").alias("tokens")).select(F.coalesce("split", F.lit("total")).alias("split"), "docs", "files", "tokens")


def bigram_rows(vocab: Column) -> Column:
    """Recommended size of a bigram table: five times the vocabulary rounded up to 128."""
    return F.expr(f"(({vocab._jc.toString()} + 127) div 128) * 128 * 5")


def bigram_size(vocab: int) -> int:
    return (vocab + 127) // 128 * 128 * 5
