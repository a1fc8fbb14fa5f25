"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 1).

Every suffix of every text is ordered only through its first WINDOW bytes; groups
that are equal to that depth are exactly the repeated windows.  The digits, most
significant first, are chosen so that whole runs of suffixes move as one row and
a group of one leaves the sort at once:

1. The first digit of a suffix is the smallest (by hash) GRAM-byte string among its
   first WINDOW bytes, its anchor.  Neighbouring suffixes mostly have the same
   anchor and make one row: about two rows for each WINDOW bytes of text.  Rows
   whose anchor string occurs once are done.
2. The second digit is all that a row's windows cover.  Rows that are equal in it
   are repeated in every window; one of them goes on, if its anchor group has
   other rows.
3. The last digit is the window itself, at each place relative to the anchor, for
   one row of each such class.  Anchor groups with up to GROUP classes are sorted
   together in one task, streamed; larger ones (a passage in very many texts,
   with a different surrounding in each) are grouped window by window in Spark.

Digits are 64-bit hashes; a match needs the anchor's and the window's (128 bits).
Copies and hot passages are counted before they are shuffled by class, and
Spark splits the joins of their occurrences.

Defined cases: a null text counts as empty; texts under WINDOW bytes lose nothing;
rows are documents, so a repeated row (same id and text) loses all that its twin
repeats; null ids work like any other; an empty table gives an empty result;
other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling

WINDOW, GRAM, GROUP = 200, 40, 4096
#: Windows of a long text that are looked at together; places within it fit the 28 bits of _PLACE.
PIECE = 4 << 20
_PLACE = np.uint64((1 << 28) - 1)
_A = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values, by blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchor_rows(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Rows of windows with a common anchor: text, anchor hash, content hash, first window, anchor's distance, windows - 1."""
    none = (np.zeros(0, np.int64),) * 6
    if len(data) < window:
        return none
    p = rolling.prefix(data)
    at = np.arange(len(data) - gram + 1)
    g = C.mix((p[gram:] - p[:-gram][: len(at)]) * rolling.powers(rolling.INVERSE, len(at))[: len(at)])
    low = sliding_min(g & ~_PLACE | at.astype(np.uint64), window - gram + 1)
    text = C.row_of(off)[: len(data) - window + 1]
    fits = np.flatnonzero(np.arange(len(text)) + window <= off[1:][text])
    if not len(fits):
        return none
    anchor = (low[fits] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(fits) != 1)]))
    last = np.concatenate([first[1:], [len(fits)]]) - 1
    lo, hi, a = fits[first], fits[last], anchor[first]
    u = C.mix(rolling.span_hash(p, lo, hi + window) + ((a - lo) * 1024 + hi - lo).astype(np.uint64) * _A)
    return text[lo], g[a].view(np.int64), u.view(np.int64), lo - off[:-1][text[lo]], a - lo, hi - lo


def _pieces(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """:func:`anchor_rows` of texts, of a long one in pieces that overlap, so that each window is in one of them."""
    step = PIECE if len(off) == 2 else len(data) + 1  # chunks hold several texts only up to their limit
    for k in range(0, max(len(data) - window + 1, 0), step):
        part = data[k : k + step + window - 1]
        row, g, u, lo, near, more = anchor_rows(part, off if step > len(data) else np.array([0, len(part)]), window, gram)
        if len(row):
            yield row, g, u, lo + k, near, more


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text"):
                for row, g, u, lo, near, more in _pieces(*C.buffers(text), window, gram):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(g), pa.array(u), pa.array((lo * 1024 + near) * 1024 + more)], ["dk", "g", "u", "at"])

    return run


def _cut(window: int):
    """The bytes that the named rows' windows cover (columns dk, text, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text"):
                data, off = C.buffers(text)
                lists = part.column(2)
                ends = np.asarray(lists.offsets, np.int64)
                rows = lists.flatten()
                g, u, at = (np.asarray(rows.field(k), np.int64) for k in range(3))
                start = off[:-1][C.row_of(ends - ends[0])] + (at >> 20)
                size = (at & 1023) + window
                blob = data[C.spread(start, size)]
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(u), pa.array(at & 0xFFFFF), pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(blob)])], ["g", "u", "shape", "bytes"])

    return run


def _windows(batch: pa.RecordBatch, window: int):
    """Row, place in the row, and hash of each window of the rows (g, u, shape, bytes)."""
    data, off = C.buffers(batch.column(3).cast(pa.large_binary()))
    shape = batch.column(2).to_numpy()
    near, count = shape >> 10, (shape & 1023) + 1
    row = np.repeat(np.arange(len(shape)), count)
    i = C.spread(np.zeros(len(shape), np.int64), count)
    start = off[:-1][row] + i
    h = C.mix(rolling.span_hash(rolling.prefix(data), start, start + window) + (near[row] - i).astype(np.uint64) * _A)
    return row, i, h


def _compare(window: int):
    """Repeated places of each class, for classes sorted by g."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        row, i, h = _windows(batch, window)
        key = C.mix(h ^ C.mix(g.view(np.uint64))[row])
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero((key[order][1:] == key[order][:-1]) & (g[row[order]][1:] == g[row[order]][:-1]))
        hit = np.zeros(len(key), bool)
        hit[order[same]] = True
        hit[order[same + 1]] = True
        at = np.flatnonzero(hit)
        begin = at[np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)])] if len(at) else at
        end = at[np.concatenate([(np.diff(at) != 1) | (np.diff(row[at]) != 0), [True]])] if len(at) else at
        return pa.RecordBatch.from_arrays([pa.array(g[row[begin]]), pa.array(u[row[begin]]), pa.array(i[begin] * 1024 + i[end])], ["g", "u", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g != g[-1], False)) if (g == g[-1]).all() else int(np.flatnonzero(g != g[-1])[-1]) + 1
            if cut:
                yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _each_window(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                row, i, h = _windows(part, window)
                idx = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(i * 1025), pa.array(h.view(np.int64))], ["g", "u", "span", "h"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``dk, spans``: for each document key, its repeated windows as runs (first start * 1024 + bytes)."""
    if not gram < window or 2 * window - gram >= 1024:
        raise ValueError("a window must be longer than its anchor, and both fit the packed places")
    base = C.pick(docs, "doc_id", "text").where(F.octet_length("text") >= window).select(F.xxhash64("doc_id", "text").alias("dk"), "text")
    rows = C.written(base.mapInArrow(_anchors(window, gram), "dk long, g long, u long, at long"), "anchors")
    # written, so that the join below has a plain exchange on either side and Spark can split a hot anchor's rows
    again = C.written(rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "anchors-again")
    live = C.written(rows.join(again, "g", "left_semi").select("dk", "g", "u", "at"), "anchors-live")
    C.forget(rows)
    classes = C.written(live.groupBy("g", "u").agg(F.count("*").alias("k"), F.min(F.struct("dk", "at")).alias("rep")), "anchor-classes")
    several = C.written(classes.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchor-groups")
    wanted = classes.join(several, "g").select(F.col("rep.dk").alias("dk"), F.struct("g", "u", "rep.at").alias("row")).groupBy("dk").agg(F.collect_list("row").alias("rows"))
    shapes = C.written(base.join(wanted, "dk").select("dk", "text", "rows").mapInArrow(_cut(window), "g long, u long, shape long, bytes binary"), "anchor-bytes")
    small = shapes.join(several.where(F.col("kinds") <= group), "g", "left_semi").select("g", "u", "shape", "bytes")
    spans = small.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(window), "g long, u long, span long")
    if several.where(F.col("kinds") > group).limit(1).count():
        large = shapes.join(several.where(F.col("kinds") > group), "g", "left_semi").select("g", "u", "shape", "bytes").mapInArrow(_each_window(window), "g long, u long, span long, h long")
        twice = large.groupBy("g", "h").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a <> b").select("g", "h")
        spans = spans.unionByName(large.join(twice, ["g", "h"], "left_semi").select("g", "u", "span"))
    partial = spans.groupBy("g", "u").agg(F.collect_set("span").alias("found"))
    # written, so that the join below has a plain exchange on either side and Spark can split a hot class's rows
    marked = C.written(classes.select("g", "u", "k").join(partial, ["g", "u"], "left").where("k > 1 OR found IS NOT NULL"), "anchor-marked")
    hits = live.join(marked, ["g", "u"])
    start = F.shiftright("at", 20)
    whole = F.array(start * 1024 + F.col("at").bitwiseAND(1023) + window)
    part = F.transform("found", lambda s: (start + F.shiftright(s, 10)) * 1024 + s.bitwiseAND(1023) - F.shiftright(s, 10) + window)
    return hits.select("dk", F.when(F.col("k") > 1, whole).otherwise(part).alias("spans")).groupBy("dk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in C.chunks(batch, "text"):
            data, off = C.buffers(text)
            lists = part.column(2)
            n, gone, runs, digest, rest = [], [], [], [], []
            for k in range(len(text)):
                own = data[off[k] : off[k + 1]]
                spans = np.asarray(lists[k].values, np.int64) if lists[k].is_valid else np.zeros(0, np.int64)
                n.append(len(own))
                if len(spans):
                    depth = np.zeros(len(own) + 1, np.int32)
                    np.add.at(depth, spans >> 10, 1)
                    np.add.at(depth, (spans >> 10) + (spans & 1023), -1)
                    out = np.cumsum(depth[:-1]) > 0
                    gone.append(int(out.sum()))
                    runs.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                    own = own[~out]
                else:
                    gone.append(0)
                    runs.append(0)
                rest.append(own.tobytes())
                digest.append(hashlib.sha256(rest[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary`` for each row of ``docs``."""
    spans = repeated_spans(docs, window, gram, group)
    rows = C.pick(docs, "doc_id", "text").withColumn("dk", F.xxhash64("doc_id", "text")).join(spans, "dk", "left")
    return rows.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir)).drop("kept")
