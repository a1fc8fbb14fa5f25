"""Quality rules as a short-circuit cascade (operator 10).

Every rule is a cheap test over features of a document's words, lines and
characters.  A bounded sample (the first ``sample_rows`` documents)
gives each rule's cost in seconds and the share it rejects; rules then run in the
order of rejection per cost, each over the documents that all earlier rules let
through.  The order changes the work, never the verdict: a document is kept if
no rule rejects it.

Defined cases: a null text counts as empty; an empty text has no words and fails
``too_short``; repeated rows and null ids are judged row by row; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SYMBOLS = b"#*$%&|<>"
WINDOW = 5


class Features:
    """Lazily computed features of one chunk of documents."""

    def __init__(self, text: pa.Array):
        self.text, self.n, self._memo = text, len(text), {}

    def __getattr__(self, name: str):
        if name not in self._memo:
            self._memo[name] = getattr(self, f"_{name}")()
        return self._memo[name]

    def _words(self):
        return C.words_of(self.text)

    def _n_words(self):
        return np.diff(self.words[1])

    def _word_chars(self):
        flat, off = self.words
        total = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(flat)).astype(np.int64))])
        return total[off[1:]] - total[off[:-1]]

    def _codes(self):
        return C.coded(self.words[0])[0]

    def _n_symbols(self):
        data, off = C.buffers(self.text)
        table = np.zeros(256, np.int64)
        table[list(SYMBOLS)] = 1
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[off[1:]] - total[off[:-1]]

    def _lines(self):
        parts = pc.split_pattern(self.text, "\n")
        flat, off = parts.flatten(), np.asarray(parts.offsets, np.int64)
        rows = C.row_of(off - off[0])
        full = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(flat))) > 0
        codes, _ = C.coded(flat)
        return rows[full], codes[full]

    def _n_lines(self):
        return np.bincount(self.lines[0], minlength=self.n)

    def _n_dup_lines(self):
        rows, codes = self.lines
        if not len(rows):
            return np.zeros(self.n, np.int64)
        distinct = np.unique(np.stack([rows, codes]), axis=1)[0] if len(rows) < 64 else np.unique(rows * (codes.max() + 1) + codes) // (codes.max() + 1)
        return self.n_lines - np.bincount(distinct, minlength=self.n)

    def _n_repeat_words(self):
        """Words inside a window of five words that occurs at least twice in its document."""
        codes, off = self.codes, self.words[1]
        rows = C.row_of(off)
        m = len(codes) - WINDOW + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        inside = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
        key = rows[inside].astype(np.uint64)
        for j in range(WINDOW):
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[inside + j].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        at = inside[order]
        same = key[order][1:] == key[order][:-1]
        pairs = np.flatnonzero(same)
        real = rows[at[pairs]] == rows[at[pairs + 1]]
        for j in range(WINDOW):  # equal hashes are confirmed on the words themselves
            real &= codes[at[pairs] + j] == codes[at[pairs + 1] + j]
        pairs = pairs[real]
        hit = np.zeros(len(codes) + 1, np.int64)
        found = np.unique(np.concatenate([at[pairs], at[pairs + 1]]))
        np.add.at(hit, found, 1)
        np.add.at(hit, found + WINDOW, -1) if len(found) else None
        total = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        return total[off[1:]] - total[off[:-1]]

    def _top_word(self):
        """Occurrences of each document's most frequent word."""
        codes, rows = self.codes, C.row_of(self.words[1])
        out = np.zeros(self.n, np.int64)
        if len(codes):
            pairs, counts = np.unique(rows * (codes.max() + 1) + codes, return_counts=True)
            np.maximum.at(out, pairs // (codes.max() + 1), counts)
        return out


#: name -> True where the rule rejects. Integer arithmetic only, so that SQL agrees exactly.
RULES: dict[str, Callable[[Features], np.ndarray]] = {
    "too_short": lambda f: f.n_words < 10,
    "repeated_windows": lambda f: 100 * f.n_repeat_words > 20 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words,
    "word_length": lambda f: (2 * f.word_chars < 3 * f.n_words) | (f.word_chars > 25 * f.n_words),
    "repeated_lines": lambda f: 2 * f.n_dup_lines > f.n_lines,
    "one_word": lambda f: 10 * f.top_word > 6 * f.n_words,
}
BASE = ("too_short", "repeated_windows")


def cascade(text: pa.Array, order: list[str], spent: dict[str, list] | None = None) -> np.ndarray:
    """Which rows no rule rejects; each rule sees only rows that are still alive."""
    alive = np.arange(len(text))
    feats = Features(text)
    for name in order:
        if not len(alive):
            break
        began = time.perf_counter()
        bad = np.asarray(RULES[name](feats))
        if spent is not None:
            s = spent.setdefault(name, [0.0, 0, 0])
            s[0] += time.perf_counter() - began
            s[1] += len(bad)
            s[2] += int(bad.sum())
        if bad.any():
            alive = alive[~bad]
            feats = Features(text.take(pa.array(alive))) if len(alive) else None
    kept = np.zeros(len(text), bool)
    kept[alive] = True
    return kept


def rule_order(docs: DataFrame, sample_rows: int = 256) -> list[str]:
    """Rules by rejected rows per second, measured on a bounded sample.

    The sample is the first ``sample_rows`` rows that Spark's incremental take
    reaches, so its cost does not grow with the table.
    """
    sample = pa.array([r[0] for r in C.pick(docs, "text").take(sample_rows)], pa.large_string())
    batch = pa.RecordBatch.from_arrays([sample], ["text"])
    gain = {}
    for name in RULES:  # each alone, so that no rule profits from another's features
        spent: dict[str, list] = {}
        for _, text in C.chunks(batch, "text"):
            cascade(text, [name], spent)
        cost, _, bad = spent.get(name, (0.0, 0, 0))
        gain[name] = (bad + 0.01) / max(cost, 1e-9)
    return sorted(RULES, key=lambda k: (-gain[k], k))


def filter_quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns unchanged."""
    order = order or rule_order(docs)
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, f"c{at}"):
                yield part.filter(pa.array(cascade(text, order)))

    plain = docs.toDF(*names)  # by position: clashing names cannot meet
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_report(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the base columns, ``base_failed`` and the cascade's verdict ``kept``."""
    order = order or rule_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text"):
                f = Features(text)
                failed = RULES["too_short"](f) | RULES["repeated_windows"](f)
                alive = np.flatnonzero(~failed)
                kept = np.zeros(len(text), bool)
                kept[alive] = cascade(text.take(pa.array(alive)), [r for r in order if r not in BASE])
                cols = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(kept)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, OUT)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(C.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(ls) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lin.dup, 0) AS n_dup_lines, coalesce(lin.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS top_word
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN lin USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 2 * coalesce(word_chars, 0) < 3 * n_words OR coalesce(word_chars, 0) > 25 * n_words
    OR 2 * n_dup_lines > n_lines OR 10 * top_word > 6 * n_words) AS kept
FROM b
"""
