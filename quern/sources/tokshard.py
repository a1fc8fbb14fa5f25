"""The token shard format: 256 little-endian int32 of header, then 16-bit token ids.

Reading goes through Spark's binary file source, so shards can lie in any store
that Spark reads; the header is checked in every file.  Writing is a Python data
source: each task writes the shards of its partition and renames them on commit.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# fixed values of the format
MAGIC, VERSION, HEADER = 20240520, 1, 256


def encode_shard(tokens: np.ndarray) -> bytes:
    t = np.asarray(tokens, np.int64)
    if len(t) >= 2**31 or (len(t) and (t.min() < 0 or t.max() > 65535)):
        raise ValueError("a shard holds under 2**31 tokens of 16 bits")
    head = np.zeros(HEADER, "<i4")
    head[:3] = MAGIC, VERSION, len(t)
    return head.tobytes() + t.astype("<u2").tobytes()


def shard_tokens(data: bytes, header_only: bool = False) -> int | np.ndarray:
    """The token count, or the tokens; magic, version and exact size are checked."""
    head = np.frombuffer(data[: HEADER * 4], "<i4")
    if len(head) < HEADER or head[0] != MAGIC or head[1] != VERSION:
        raise ValueError("not a token shard")
    if header_only:
        return int(head[2])
    if len(data) != HEADER * 4 + 2 * int(head[2]):
        raise ValueError(f"a shard of {head[2]} tokens has {len(data)} bytes")
    return np.frombuffer(data, "<u2", offset=HEADER * 4)


def read_shards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, n, tokens array<int>`` of each shard file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = shard_tokens(batch.column(1)[k].as_py()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(t)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.array(t))], ["path", "n", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, n long, tokens array<int>")


def shard_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, n`` of each shard file, from its size alone; nothing of the files is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), ((F.col("length") - 4 * HEADER) / 2).cast("long").alias("n"))


def read_range(spark: SparkSession, path: str, split: str, start: int, stop: int) -> DataFrame:
    """``pos, token`` of the places start..stop-1 of a split's stream; only the shards that hold them are read."""
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = shard_sizes(spark, path).where(F.col("name").startswith(f"{split}_")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = sizes.where((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).select("path", "first").collect()  # names and places of those few
    firsts = spark.createDataFrame([(r["path"], r["first"]) for r in held], "path string, first long")
    if not held:
        return spark.createDataFrame([], "pos long, token int")
    rows = read_shards(spark, [r["path"] for r in held]).join(F.broadcast(firsts), "path")
    lo, hi = F.greatest(F.lit(start) - F.col("first"), F.lit(0)), F.least(F.lit(stop) - F.col("first"), F.col("n"))
    part = F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int"))
    return rows.select((F.col("first") + lo).alias("from"), F.posexplode(part).alias("i", "token")).select((F.col("from") + F.col("i")).alias("pos"), "token")


def _piece(tokens: pa.Scalar) -> bytes | pa.Buffer:
    """16-bit ids of an array of tokens; binary holds them already."""
    if not tokens.is_valid:
        raise ValueError("a piece of a shard without tokens")
    if pa.types.is_binary(tokens.type) or pa.types.is_large_binary(tokens.type):
        data = tokens.as_buffer()
        if len(data) % 2:
            raise ValueError("a piece of 16-bit ids has an odd length")
        return data
    if tokens.values.null_count:
        raise ValueError("a piece of a shard has a null for a token")
    return encode_shard(tokens.values.to_numpy(zero_copy_only=False))[4 * HEADER :]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        names: list[str] = []
        seen: set[str] = set()
        out, n = None, 0
        for batch in iterator:  # pieces of one shard follow each other
            tokens = batch.column("tokens")
            for k, (split, shard) in enumerate(zip(batch.column("split").to_pylist(), batch.column("shard_id").to_pylist())):
                name = f"{split}_{shard:06d}.bin"
                if not names or name != names[-1]:
                    self._close(out, n, names)
                    if name in seen:
                        raise ValueError(f"the pieces of {name} do not follow each other")
                    names.append(name)
                    seen.add(name)
                    out, n = open(self._part(name), "wb"), 0
                    out.write(bytes(4 * HEADER))
                piece = _piece(tokens[k])
                out.write(piece)
                n += len(piece) // 2
        self._close(out, n, names)
        return _Written(names)

    def _part(self, name: str) -> str:
        return os.path.join(self.path, f".{name}.{os.getpid()}")

    def _close(self, out, n: int, names: list[str]) -> None:
        """The header is known at the end; a shard gets its name when it is whole."""
        if out is None:
            return
        if n >= 2**31:
            raise ValueError("a shard holds under 2**31 tokens")
        out.seek(0)
        out.write(np.array([MAGIC, VERSION, n], "<i4").tobytes())
        out.close()
        os.replace(self._part(names[-1]), os.path.join(self.path, names[-1]))

    def commit(self, messages: list) -> None:
        """Files that this export did not write are stale and go."""
        if self.overwrite:
            keep = {n for m in messages if m for n in m.names}
            for n in os.listdir(self.path):
                if n.endswith(".bin") and n not in keep:
                    os.remove(os.path.join(self.path, n))

    def abort(self, messages: list) -> None:
        for m in messages:
            for n in m.names if m else []:
                if os.path.exists(p := os.path.join(self.path, n)):
                    os.remove(p)


class TokenShards(DataSource):
    """Sink for rows (split, shard_id, tokens), pieces of shards in order, with tokens as an array or as binary of 16-bit little-endian ids; ``path`` must be a folder that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "tokshard"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter(self.options, overwrite)


def write_shards(shards: DataFrame, path: str, order: str | None = None) -> None:
    """Write rows (split, shard_id, tokens); with ``order``, a shard's rows are its pieces in that order and meet in one task, streamed."""
    shards.sparkSession.dataSource.register(TokenShards)
    if order:
        shards = shards.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", order)
    shards.select("split", "shard_id", "tokens").write.format("tokshard").mode("overwrite").option("path", path).save()
