"""Helpers that the operators of this subpackage share.

Three concerns live here: where intermediate tables go (the shared folder the
cluster names in ``spark.checkpoint.dir``), how Arrow batches are cut into
pieces of bounded size, and how text becomes words without a Python loop.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into numpy arrays at once.
CHUNK_BYTES = 2 << 20

#: Ids (8 bytes each) that are broadcast at most.
SENT = 1 << 21

_freed = 0.0
_runs: dict[str, str] = {}
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables.

    It lies in ``spark.checkpoint.dir``.  Where that is unset and the master is
    local (tests, bench), a temporary folder is made and set; on a cluster an
    unset folder is an error, because executors share no other place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{base.rstrip('/')}/quern-{app}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner removes it
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The shuffle files of the write are of no more use; Spark's cleaner deletes
    them once the driver's garbage is collected, which is asked for here.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    _tables.append(path)
    global _freed
    if time.monotonic() > _freed + 5:  # a collection takes longer than a small table
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed = time.monotonic()
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    _remove(df.sparkSession, df.quern_path)


def only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``ids`` (a written table of that column alone, distinct).

    Up to SENT ids, counted here, go to all executors; more are joined by a shuffle.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, column, "left_semi")


def mark() -> int:
    """How many tables there are; for :func:`drop_since`."""
    return len(_tables)


def drop_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a mark but for those kept, which :func:`written` returned."""
    paths = {df.quern_path for df in keep if hasattr(df, "quern_path")}
    for path in _tables[since:]:
        if path not in paths:
            _remove(spark, path)
    _tables[since:] = [p for p in _tables[since:] if p in paths]


def tidy(spark: SparkSession) -> None:
    """Delete all tables made by :func:`written` so far.

    Only for callers that have stored what they need of earlier results, such as
    a pipeline between two stages.
    """
    while _tables:
        _remove(spark, _tables.pop())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones cannot matter."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each column (the first of those that share a name).

    Names that an operator adds can then clash with none of the caller's;
    ``toDF(*docs.columns)`` brings the old names back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(reversed(list(zip(docs.columns, names))))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of ``batch`` with at most ``limit`` bytes of text (or one longer row), nulls as ''."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64), 1))
    start = 0
    while start < n:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(start, end - start), pc.fill_null(text.slice(start, end - start), "")
        start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and one executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a null-free large_string array, and the rows' offsets in them."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat words ``[^\\x20\\x09-\\x0D]+`` of all rows, and the offsets of each row's words."""
    parts = pc.ascii_split_whitespace(text)
    flat, off = parts.flatten(), np.asarray(parts.offsets, np.int64)
    off = off - off[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():  # leading or trailing white space leaves empty strings
        flat = flat.filter(pa.array(full))
        off = np.concatenate([[0], np.cumsum(full)])[off]
    return flat, off


def row_of(off: np.ndarray) -> np.ndarray:
    """The row index of each element of a ragged array."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count values) for each pair, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes (xxh3)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the strings, and the distinct strings."""
    d = values.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices).astype(np.int64), d.dictionary
