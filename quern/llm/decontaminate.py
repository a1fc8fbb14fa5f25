"""Benchmark decontamination by intact stretches and exact edit distance (operator 8).

A document holds an item if some part of it is within MAX_EDITS of the item's
length in edits, in characters of the lower-cased texts with one space between
words.  The edits may be anywhere, and every item with a word is looked for.

All stretches of an item (its grams of ``span`` characters, at every place) are
looked up in the text.  The span follows from the item's length m and its edits k:
k edits at random places leave SEEDS stretches of that many characters intact on
average, or one for certain where that allows a longer span (m // (k + 1): short
items are found without exception).  A stretch at place o of the item and p of the
text says that a held part begins at p - o, give or take k; such places are put in
bands, and for each band the item's exact edit distance to the best part is
computed, for many bands at once.  So all finds are right, and an item is missed
only if its edits leave no stretch intact; the tests measure that against the edit
distance of every item to every text.

The benchmark is sent to all, in parts of bounded size, and so the text is read
once for each part and nothing is joined.

Defined cases: null and empty texts hold nothing, and empty items are held by
nothing; documents are told apart by id and text, so repeated rows give one result
and are dropped together, and null ids work like any other; an empty benchmark or
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAX_EDITS = 0.2
#: Intact stretches of an item that edits up to the limit leave on average.
SEEDS = 3
#: Bits of the table of stretches that a text is held against first, and characters of text in bands at once.
BITS, AT_ONCE = 20, 1 << 19
#: Bytes of benchmark text that is sent to all at once, about; a larger benchmark is searched for in parts.
PART_BYTES = 8 << 20
_63 = np.uint64(63)
_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def normal(text: pa.Array) -> pa.Array:
    """Lower-cased texts with one space between words."""
    flat, off = C.words_of(pc.utf8_lower(text.cast(pa.large_string())))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), flat.cast(pa.string())), " ")


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(c: np.ndarray, spans: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each span, a hash of the characters from each place on; its high bits are mixed."""
    x = c.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c), np.uint64)
    for q in range(1, min(max(spans, default=0), len(c)) + 1):
        h = h[: len(c) - q + 1]
        h *= _P
        h += x[q - 1 :]
        if q in spans:
            yield q, h * _MIX


def span(m: int, k: int) -> int:
    """Characters of an item's stretches."""
    q = 1
    while (k + 1) * (1 - k / m) ** (q + 1) >= SEEDS:
        q += 1
    return max(q, m // (k + 1))


class Items:
    """A benchmark in normal form, its stretches, and its characters as bits."""

    def __init__(self, items: list[tuple[int | None, str | None]], max_edits: float):
        text = normal(pa.array([t or "" for _, t in items], pa.large_string())).to_pylist() if items else []
        full = [(i, t) for (i, _), t in zip(items, text) if t]
        self.ids = [i for i, _ in full]
        own = [characters(t) for _, t in full]
        self.m = np.array([len(c) for c in own], np.int64)
        self.k = np.array([int(max_edits * n) for n in self.m], np.int64)
        self.band = np.maximum(self.k, 8)
        self.code = np.zeros(0x110000, np.uint16)
        used = np.unique(np.concatenate([*own, np.zeros(0, np.uint32)]))
        self.code[used] = np.arange(1, len(used) + 1)
        made: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, c in enumerate(own):
            q = span(int(self.m[i]), int(self.k[i]))
            made.setdefault(q, []).append((next(grams(c, {q}))[1], i))
        self.index = {}
        for q, parts in made.items():
            key = np.concatenate([g for g, _ in parts])
            order = np.argsort(key, kind="stable")
            item = np.concatenate([np.full(len(g), i) for g, i in parts])[order]
            place = np.concatenate([np.arange(len(g)) for g, _ in parts])[order]
            seen = np.zeros(1 << BITS, bool)
            seen[(key >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.index[q] = (key[order], item, place, seen)
        # items of as many 64-bit words: for each, which of its characters are which
        self.words = (self.m + 63) // 64
        self.slot = np.zeros(len(own), np.int64)
        self.bits = {}
        for w in np.unique(self.words).tolist():
            who = np.flatnonzero(self.words == w)
            self.slot[who] = np.arange(len(who))
            bits = np.zeros((w, len(who), len(used) + 1), np.uint64)
            for s, i in enumerate(who):
                at = np.arange(len(own[i]))
                np.bitwise_or.at(bits, (at >> 6, s, self.code[own[i]]), np.uint64(1) << (at & 63).astype(np.uint64))
            self.bits[w] = bits.reshape(w, -1)

    def bands(self, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (item, row, place where the band begins) of the stretches in the characters of rows."""
        out = [np.zeros((3, 0), np.int64)]
        for q, h in grams(c, set(self.index)):
            key, item, place, seen = self.index[q]
            at = np.flatnonzero(seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(key, h[at]), np.searchsorted(key, h[at], "right")
            hit = C.spread(lo, hi - lo)
            p = np.repeat(at, hi - lo)
            row = np.searchsorted(start, p, "right") - 1
            i = item[hit]
            begin = (p - place[hit] - start[row]) // self.band[i]  # counted from the row's begin, may be negative
            most = int(begin.max(initial=0)) + int(self.m.max()) + 2
            code = np.unique((i * len(start) + row) * (2 * most) + begin + most)
            i, row = np.divmod(code // (2 * most), len(start))
            out.append(np.stack([i, row, (code % (2 * most) - most) * self.band[i] + start[row]]))
        return tuple(np.concatenate(out, axis=1))

    def distances(self, c: np.ndarray, start: np.ndarray, item: np.ndarray, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Least edit distance of each item to any part of the row that begins in the band; if over the item's edits, some number over these."""
        out = np.empty(len(item), np.int64)
        code = self.code[c]
        lo = np.maximum(begin - self.k[item], start[row])
        hi = np.minimum(begin + self.band[item] + self.m[item] + self.k[item], start[row + 1] - 1)
        order = np.lexsort((hi - lo, self.words[item]))
        ends = np.flatnonzero(np.diff(self.words[item][order])) + 1
        for some in np.split(order, ends):
            for part in np.array_split(some, -(-int((hi - lo)[some].sum()) // AT_ONCE) or 1) if len(some) else []:
                if len(part):
                    out[part] = self._distances(code, item[part], lo[part], hi[part])
        return out

    def _distances(self, code: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Bit-parallel, one step for a character of all the stretches of text.

        A step lowers a score by 1 at most, so stretches whose score cannot come
        down to the item's edits, or below their best, by their end are left out.
        """
        one, w = np.uint64(1), int(self.words[item[0]])
        bits = self.bits[w]
        alphabet = bits.shape[1] // int((self.words == w).sum())
        base = self.slot[item] * alphabet
        last = ((self.m[item] - 1) & 63).astype(np.uint64)
        score = self.m[item].copy()
        best = score.copy()
        pv = [np.full(len(item), ~np.uint64(0)) for _ in range(w)]
        mv = [np.zeros(len(item), np.uint64) for _ in range(w)]
        end = len(code) - 1
        eq, xv, xh, ph, mh, up, down, top = (np.empty(len(item), np.uint64) for _ in range(8))
        out, own, most = best.copy(), np.arange(len(item)), self.k[item]
        for t in range(int((hi - lo).max())):
            if t % 8 == 0:
                live = np.flatnonzero(score - (hi - lo - t) <= np.minimum(most, best - 1))
                if len(live) <= 0.8 * len(own):
                    out[own] = best
                    if not len(live):
                        return out
                    own, base, last, score, best, lo, hi, most = (x[live] for x in (own, base, last, score, best, lo, hi, most))
                    pv, mv = [x[live] for x in pv], [x[live] for x in mv]
                    eq, xv, xh, ph, mh, up, down, top = (x[: len(live)] for x in (eq, xv, xh, ph, mh, up, down, top))
            at = lo + t
            sym = base + np.where(at < hi, code[np.minimum(at, end)], 0)  # after its end a text has a character that no item has
            up[:] = down[:] = 0  # a part may begin anywhere: the first row stays 0
            for b in range(w):  # all in place, so that the arrays stay in a fast cache
                p, m = pv[b], mv[b]
                bits[b].take(sym, out=eq, mode="clip")
                np.bitwise_or(eq, m, out=xv)
                eq |= down
                np.bitwise_and(eq, p, out=xh)
                xh += p
                xh ^= p
                xh |= eq
                np.bitwise_or(xh, p, out=ph)
                np.invert(ph, out=ph)
                ph |= m
                np.bitwise_and(p, xh, out=mh)
                if b == w - 1:
                    score += np.bitwise_and(np.right_shift(ph, last, out=top), one, out=top).view(np.int64)
                    score -= np.bitwise_and(np.right_shift(mh, last, out=top), one, out=top).view(np.int64)
                np.right_shift(ph, _63, out=top)
                ph <<= one
                ph |= up
                up[:] = top
                np.right_shift(mh, _63, out=top)
                mh <<= one
                mh |= down
                down[:] = top
                np.bitwise_and(ph, xv, out=m)
                np.bitwise_or(xv, ph, out=p)
                np.invert(p, out=p)
                p |= mh
            np.minimum(best, score, out=best)
        out[own] = best
        return out

    def finds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item (its index) and distance for what the texts (in normal form) hold."""
        c = characters("\n".join(texts) + "\n")  # no text in normal form has a line break
        start = np.cumsum([0] + [len(t) + 1 for t in texts])
        item, row, begin = self.bands(c, start)
        d = self.distances(c, start, item, row, begin)
        held = d <= self.k[item]
        return row[held], item[held], d[held]


def best_distance(item: str, window: str) -> int:
    """Least edit distance of ``item`` to any part of ``window`` (bit-parallel, one step a character)."""
    if item in window:
        return 0
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best = m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a part may begin anywhere: the first row stays 0
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, score)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``doc_id, dk, item_id, distance`` for each document and item that it holds."""
    items = C.pick(benchmark, "item_id", "text").where("text IS NOT NULL").dropDuplicates()
    parts = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    slim = C.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("dk"), "text")
    out = None
    for k in range(parts):
        some = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]
        found = slim.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(Items(some, max_edits))), "doc_id long, dk long, item_id long, distance long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "dk", "item_id").agg(F.min("distance").alias("distance"))


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text", 1 << 20):
                row, item, d = held.value.finds(normal(text).to_pylist())
                idx = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array([held.value.ids[i] for i in item], pa.int64()), pa.array(d)], ["doc_id", "dk", "item_id", "distance"])

    return run


def filter_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    plain, at = C.by_place(docs)
    own = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    bad = C.written(contaminated(own, benchmark).select("dk").distinct(), "contaminated")
    return plain.withColumn("dk", F.xxhash64(F.col(at["doc_id"]).cast("long"), at["text"])).join(bad, "dk", "left_anti").drop("dk").toDF(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds, with the edit distance."""
    return contaminated(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("dk")
