"""Queries of formats: shards written and read back, SentencePiece ids, seeds from names, a live stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..sources.files import count_lines, jsonl_documents
from ..sources.tokshard import read_range, read_shards, shard_sizes, write_shards
from ..streaming import stream
from .corpus import PARTS, PLACED, SHARD, TOKENS, docs, placed
from .registry import register, shared_folder


SIZES = f"WITH {PLACED}, {PARTS}, s AS (SELECT split, shard_id, sum(hi - lo) AS n FROM pt GROUP BY 1, 2) SELECT split || '_' || printf('%06d', shard_id) || '.bin' AS name, CAST(n AS BIGINT) AS n FROM s"


def exported(spark: SparkSession, d: str) -> str:
    """Folder of the byte-token export; a shard's pieces are streamed to its file in order."""
    parts = T.pack(placed(spark, d), SHARD).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    path = shared_folder(spark, "shards")
    write_shards(T.byte_pieces(parts), path, order="doc_id")
    return path


@register("s9_shard_roundtrip", SIZES)
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Shards are packed, written (S9, S10), read back and checked (S5, S8)."""
    return read_shards(spark, exported(spark, d)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "n")


@register("s6_shard_sizes", SIZES)
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of shard files whose content is not read."""
    return shard_sizes(spark, exported(spark, d)).select("name", "n")


S7 = f"WITH {PLACED}, {TOKENS}, t AS (SELECT \"offset\", unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM pl JOIN tk USING (doc_id) WHERE split = 'train') SELECT \"offset\" + i AS pos, token FROM t WHERE \"offset\" + i >= 99900 AND \"offset\" + i < 100200"


@register("s7_random_access", S7)
def s7(spark: SparkSession, d: str) -> DataFrame:
    """A range of the training stream across a shard's border."""
    return read_range(spark, exported(spark, d), "train", 99_900, 100_200)


@register("p2_sentencepiece_ids")
def p2(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a SentencePiece model, decoded again; the model is sent to the executors as bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        for batch in batches:
            for b in T.text_slices(batch):  # ids are Python objects, many times the text
                ids = sp.encode([t or "" for t in b.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.count(sp.unk_id()) for i in ids], pa.int64())], ["doc_id", "n", "n_unknown"])

    return docs(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, n_unknown long")


@register("t13_seed_of_names")
def t13(spark: SparkSession, d: str) -> DataFrame:
    """A 64-bit seed folded over names: xor, then multiply by a prime modulo 2**64."""

    @F.pandas_udf("string")
    def seed(names: pd.Series) -> pd.Series:
        def one(name: str) -> str:
            s = 0
            for byte in name.encode():
                s = (s ^ byte) * 0x100000001B3 % (1 << 64)
            return str(s)

        return names.map(one)

    return spark.range(100).select(F.format_string("train_%06d.bin", "id").alias("name")).withColumn("seed", seed("name"))


@register("r1s_live_stream", "SELECT source, count(*) AS docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def r1s(spark: SparkSession, d: str) -> DataFrame:
    """The same counters from a stream that takes a file at a time until all are read."""
    schema = docs(spark, d).schema
    name = f"quern_live_{abs(hash(d)) % 10**8}"
    q = stream.running_counts(stream.parquet_stream(spark, f"{d}/documents.parquet*", schema)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_folder(spark, "live")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def jsonl(spark: SparkSession, d: str) -> str:
    """Folder with the documents as JSON lines."""
    path = shared_folder(spark, "jsonl")
    docs(spark, d).select("text", "lang").write.option("ignoreNullFields", False).json(path)
    return path


@register("s1j_jsonl_scan", "SELECT CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, count(*) AS docs FROM documents GROUP BY 1")
def s1j(spark: SparkSession, d: str) -> DataFrame:
    """Documents from JSON lines, of which only the text is taken."""
    return jsonl_documents(spark, jsonl(spark, d)).groupBy(F.octet_length("text").cast("long").alias("n_bytes")).agg(F.count("*").alias("docs"))


@register("s2j_jsonl_count", "SELECT count(*) AS docs FROM documents")
def s2j(spark: SparkSession, d: str) -> DataFrame:
    return count_lines(spark, jsonl(spark, d))
