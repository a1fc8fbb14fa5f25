"""Line dedup by a deletion-neighbourhood join (operator 4).

A line goes if an earlier line, in the order of doc_id and place, is equal to it
or within one edit of it (a character inserted, lost or replaced).  Lines are
judged on the input, not on what is left.  Lines without a word stay; all others
are judged, however short.

Equal lines are classes with one earliest line.  Within one edit, lines are found
by variants emitted as hashed keys and joined where equal, coarse to fine:

1. each distinct line with one half deleted (two halves, as the shorter and as
   the longer line of a pair): lines whose keys nobody shares have no partner;
2. for what is left, each line with one sixteenth deleted;
3. for what is left, each line with one character of that sixteenth deleted.
   Two lines with the same rest after losing the character at the same place
   differ by a replacement; a line that equals another's rest differs by an
   insertion.  Keys are two independent 64-bit hashes, and the place belongs to
   the key.  Each line's edit distance to its earliest partner is verified on the
   lines themselves.

Because equal keys of one kind are all partners of each other, the smallest line
of a key decides for all of them: groups are aggregated, never paired.

Defined cases: a null text is left as it is and has no lines; an empty text has
one empty line; rows that repeat id and text are one document and keep or lose
lines together; null ids sort first; a text that loses all its lines becomes ''
in the report and its row leaves the filtered table; an empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling

#: The operator and the pipeline judge lines of any length (least=1); this is only the helpers' default.
MIN_CHARS = 16
HALVES, FINE = 2, 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Lines:
    """Hashes of parts of the lines of one column, all at once."""

    def __init__(self, lines: pa.Array):
        self.data, self.off = C.buffers(lines)
        self.lead = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self.first = np.searchsorted(self.lead, self.off)
        self.n = np.diff(self.first)
        self.p = rolling.prefix(self.data)

    def byte(self, line: np.ndarray, char: np.ndarray) -> np.ndarray:
        return self.lead[self.first[line] + char]

    def whole(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = rolling.span_hash(self.p, self.off[line], self.off[line + 1])
        return self._pair(h, self.n[line])

    @staticmethod
    def _pair(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n.astype(np.uint64)
        return C.mix(h + n * _A).view(np.int64), C.mix((h ^ (h >> np.uint64(31))) * _B + n).view(np.int64)

    def without_block(self, line: np.ndarray, size: np.ndarray, q: np.ndarray, blocks: int) -> np.ndarray:
        """Keys of lines without block q, where ``size`` is the shorter partner's length."""
        s, e = q * size // blocks, (q + 1) * size // blocks
        lo, hi = self.byte(line, s), self.byte(line, self.n[line] - (size - e))
        a = rolling.span_hash(self.p, self.off[line], lo)
        b = rolling.span_hash(self.p, hi, self.off[line + 1])
        return C.mix(C.mix(a) + C.mix(b + _A) * _B + (size * blocks + q).astype(np.uint64) * _A).view(np.int64)

    def without_char(self, line: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Hash of each line without one character: that of the same text as a line."""
        lo, hi = self.byte(line, char), self.byte(line, char + 1)
        start, end = self.off[line], self.off[line + 1]
        inv = rolling.powers(rolling.INVERSE, int(max(len(self.data), 1)) + 1)
        return ((self.p[lo] - self.p[start]) + (self.p[end] - self.p[hi]) * inv[hi - lo]) * inv[start]


def _split(text: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines long enough to be judged, their rows, places in the row, and the rows' line counts."""
    parts = pc.split_pattern(text, "\n")
    flat, off = parts.flatten(), np.asarray(parts.offsets, np.int64)
    off = off - off[0]
    row = C.row_of(off)
    place = np.arange(len(flat)) - off[:-1][row]
    use = (np.asarray(pc.utf8_length(flat)) >= least) & (np.asarray(pc.binary_length(pc.ascii_trim_whitespace(flat))) > 0)
    return flat.filter(pa.array(use)).cast(pa.large_string()), row[use], place[use], np.diff(off)


def _roles(n: np.ndarray) -> np.ndarray:
    """Lengths of the shorter partner: the line's own, and one less."""
    return np.stack([n, n - 1], axis=1)


def _coarse(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Every judged line: document, place, class, and keys of the line without a half."""
    for batch in batches:
        for part, text in C.chunks(batch, "text"):
            lines, row, place, _ = _split(text, least)
            x = Lines(lines)
            at = np.arange(len(lines))
            h, g = x.whole(at)
            keys = np.stack([x.without_block(at, size, np.full(len(at), q), HALVES) for size in _roles(x.n).T for q in range(HALVES)], axis=1) if len(at) else np.zeros((0, 4), np.int64)
            idx = pa.array(row)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), 4).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(place), pa.array(h), pa.array(g), lists], ["doc_id", "dk", "no", "h", "g", "keys"])


def _texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The named lines' texts (columns dk, text, nos)."""
    for batch in batches:
        for part, text in C.chunks(batch, "text"):
            lines, row, place, _ = _split(text, least)
            wanted = [set(x) for x in part.column(2).to_pylist()]
            use = np.array([p in wanted[r] for r, p in zip(row.tolist(), place.tolist())], bool)
            lines = lines.filter(pa.array(use))
            h, g = Lines(lines).whole(np.arange(len(lines)))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), lines.cast(pa.string())], ["h", "g", "line"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of lines (h, g, line) without a sixteenth."""
    for batch in batches:
        for part, line in C.chunks(batch, "line"):
            x = Lines(line)
            at = np.repeat(np.arange(len(line)), 2 * FINE)
            q = np.tile(np.arange(FINE), 2 * len(line))
            size = np.repeat(_roles(x.n).ravel(), FINE)
            idx = pa.array(at)
            yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(x.without_block(at, size, q, FINE)), pa.array((size < x.n[at]).astype(np.int32)), pa.array(q.astype(np.int32))], ["h", "g", "key", "longer", "q"])


def _chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of lines (h, g, line, blocks) without a character of the named blocks (longer * FINE + q)."""
    for batch in batches:
        for part, line in C.chunks(batch, "line", 1 << 18):
            x = Lines(line)
            blocks = part.column(3)
            off = np.asarray(blocks.offsets, np.int64)
            flat = np.asarray(blocks.flatten(), np.int64)
            at = C.row_of(off - off[0])
            longer, q = flat // FINE, flat % FINE
            size = x.n[at] - longer
            s, e = q * size // FINE, x.n[at] - (size - (q + 1) * size // FINE)
            char = C.spread(s, e - s)
            who = np.repeat(at, e - s)
            kind = np.repeat(longer, e - s)  # 0: replaced, 1: this line is the longer one
            h1, h2 = Lines._pair(x.without_char(who, char), x.n[who] - 1)
            place = np.where(kind == 0, char, -1)
            own = np.unique(at[longer == 0])  # as the shorter one, a line is its partner's rest
            o1, o2 = x.whole(own)
            who, place, role = np.concatenate([who, own]), np.concatenate([place, np.full(len(own), -1)]), np.concatenate([kind, np.zeros(len(own), np.int64)])
            idx = pa.array(who)
            yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(np.concatenate([h1, o1])), pa.array(np.concatenate([h2, o2])), pa.array(place), pa.array(role)], ["h", "g", "k1", "k2", "place", "role"])


def duplicate_lines(docs: DataFrame, least_chars: int = MIN_CHARS) -> DataFrame:
    """``dk, nos``: for each document key, the places of its lines that go."""
    base = C.pick(docs, "doc_id", "text").where("text IS NOT NULL").select(F.col("doc_id").cast("long"), _key("doc_id", "text").alias("dk"), "text")
    found = base.mapInArrow(partial(_coarse, least=least_chars), "doc_id long, dk long, no long, h long, g long, keys array<long>")
    start = C.mark()
    lines = C.written(found, "lines")
    spot = F.struct("doc_id", "dk", "no")
    classes = C.written(lines.groupBy("h", "g").agg(F.min(spot).alias("first"), F.count("*").alias("k")), "line-classes")
    # 1: halves. A key is shared if two different lines have it; copies of one line do not count.
    keyed = lines.select("h", "g", F.explode("keys").alias("key"))
    shared = C.written(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"), "line-keys")
    found = keyed.join(shared, "key", "left_semi").select("h", "g").distinct()
    some = found.join(classes, ["h", "g"]).select("first.dk", "first.no").groupBy("dk").agg(F.collect_set("no").alias("nos"))
    texts = C.written(base.join(some, "dk").select("dk", "text", "nos").mapInArrow(partial(_texts, least=least_chars), "h long, g long, line string").dropDuplicates(["h", "g"]), "line-texts")
    # 2: sixteenths
    fine = texts.mapInArrow(_fine, "h long, g long, key long, longer int, q int")
    shared = fine.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    left = fine.join(shared, "key", "left_semi").groupBy("h", "g").agg(F.collect_set(F.col("longer") * FINE + F.col("q")).alias("blocks"))
    # 3: characters
    chars = texts.join(left, ["h", "g"]).select("h", "g", "line", "blocks").mapInArrow(_chars, "h long, g long, k1 long, k2 long, place long, role long")
    chars = C.written(chars.join(classes, ["h", "g"]), "line-variants")
    who = F.struct("first", "h", "g")
    least = chars.groupBy("k1", "k2", "place").agg(F.min(F.when(F.col("role") == 0, who)).alias("short"), F.min(F.when(F.col("role") == 1, who)).alias("long"))
    least = least.where("place >= 0 OR (short IS NOT NULL AND long IS NOT NULL)")
    partner = F.when(F.col("place") >= 0, F.col("short")).when(F.col("role") == 0, F.col("long")).otherwise(F.col("short"))
    near = chars.join(least, ["k1", "k2", "place"]).select("h", "g", "first", partner.alias("partner")).where("partner.first < first")
    # the earliest partner of each line; its distance is verified on the lines themselves
    near = C.written(near.groupBy("h", "g").agg(F.min("partner").alias("p")).select("h", "g", F.col("p.h").alias("ph"), F.col("p.g").alias("pg")), "line-partners")
    with_text = near.join(texts, ["h", "g"]).join(texts.toDF("ph", "pg", "other"), ["ph", "pg"])
    near = with_text.where(F.levenshtein("line", "other", 1).between(0, 1)).select("h", "g", F.lit(True).alias("near"))
    # all lines but the first of each class, and all lines of a class with an earlier neighbour; written, so that
    # the join below has a plain exchange on either side and Spark can split a hot line's rows
    gone = C.written(classes.join(near, ["h", "g"], "left").where("k > 1 OR near"), "lines-gone")
    C.drop_since(docs.sparkSession, start, lines, gone)
    judged = lines.select("h", "g", "doc_id", "dk", "no").join(gone, ["h", "g"]).where((spot != F.col("first")) | F.coalesce("near", F.lit(False)))
    return judged.groupBy("dk").agg(F.collect_set("no").alias("nos"))


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), text)


def _without(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """``docs`` with ``lines``, ``nos`` (places of those that go) and the remaining text as ``rest``."""
    gone = duplicate_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least_chars)
    cut = docs.withColumn("dk", _key(doc_id, text)).join(gone, "dk", "left").drop("dk").withColumn("lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), F.col("nos"))
    rest = F.array_join(F.transform(left, lambda i: F.col("lines")[i.cast("int")]), "\n")
    return cut.withColumn("rest", F.when(F.col("nos").isNull() | F.col(text).isNull(), F.col(text)).otherwise(rest))


def filter_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and ``n_chars`` counted anew; texts left without a line go."""
    plain, at = C.by_place(docs)
    cut = _without(plain, at["doc_id"], at["text"]).where(F.col("nos").isNull() | (F.size("nos") < F.size("lines")))
    new = {at["text"]: F.col("rest")}
    if "n_chars" in at:
        new[at["n_chars"]] = F.length("rest").cast(plain.schema[at["n_chars"]].dataType)
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` (what is left) for each document."""
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    lines, gone = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("nos"), F.lit(0))
    return _without(docs).select("doc_id", F.greatest(lines, F.lit(0)).cast("long").alias("n_lines"), F.greatest(gone, F.lit(0)).cast("long").alias("n_removed"), F.col("rest").alias("text"))
