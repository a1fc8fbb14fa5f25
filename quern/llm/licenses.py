"""License scans by diagonal voting (operator 5).

Each template is a short sequence of words.  The hash of every pair of
neighbouring words of every text is joined, in Spark, to the template positions
with the same hash (a table of fixed size, hence a broadcast).  A match at text
position p and template position t votes for the diagonal p - t.

The phrases of the base labels are templates whose spans hold every pair on one
diagonal, which means that the words stand consecutively.

Notices may have edits.  Their votes are dealt to overlapping blocks of the text,
each longer than any span, so that a group of votes is bounded by the template
and not by the text; they are aggregated by diagonal, and blocks with too few
votes go.  Neighbouring diagonals (an inserted or lost word moves the diagonal by
one) are merged: DRIFT + 1 of them make a band.  A band's span is verified on the
template's places: the longest chain of matches whose text positions and template
places both increase must hold SHARE of the template's pairs, each place once.

Defined cases: a null text counts as empty; without words or matches the label
strings are '' and the score is 0; rows are told apart by their place in the
input, so repeated rows and null ids each give their own row; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling

#: Base phrases: label, words.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: Public notices: label, words as in the notice. Fixed values.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("agpl", "gnu affero general public license"),
]
#: Diagonals of one span are this far apart at most.
DRIFT = 4
#: Share of a notice's pairs that a span must hold.
SHARE = 0.85

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_word = np.zeros(256, bool)
_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all rows, and the offsets of each row's words."""
    data, off = C.buffers(text)
    low = _low[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _word[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True  # words never cross rows
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return C.mix(rolling.span_hash(rolling.prefix(low), starts, ends)), np.searchsorted(starts, off)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one, as a signed 64-bit value other than 0 and 1."""
    g = C.mix(h[:-1] * np.uint64(0xA24BAED4963EE407) + h[1:] * np.uint64(0x9FB21C651E98DF25)).view(np.int64)
    return np.where((g == 0) | (g == 1), np.int64(2), g)


def template_index(templates: list[tuple[str, str, bool]]) -> tuple[list[tuple], list[tuple]]:
    """Rows (hash, template, place) of the index, and rows (template, label, is_base, pairs)."""
    index, heads = [(0, -1, 0), (1, -2, 0)], []
    for k, (label, phrase, base) in enumerate(templates):
        h, _ = word_hashes(pa.array([phrase], pa.large_string()))
        index += [(int(g), k, i) for i, g in enumerate(pair_hashes(h))]
        heads.append((k, label, base, len(h) - 1))
    return index, heads


def needed(pairs: int) -> int:
    """Pairs that a verified span of a notice holds at least."""
    return -int(-pairs * round(100 * SHARE) // 100)


def longest_chain(votes: list[tuple[int, int]]) -> int:
    """The longest chain of votes (text position, template place), both increasing, within a band of diagonals."""
    best = 0
    for first in sorted({p - t for p, t in votes}):
        band = sorted((p, -t) for p, t in votes if first <= p - t <= first + DRIFT)  # of one position, only one place can be taken
        if len(band) > best:
            ends: list[int] = []
            for _, t in band:
                at = bisect_left(ends, -t)
                ends[at : at + 1] = [-t]
            best = max(best, len(ends))
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (rid, template, pairs, diagonals: each with its positions) with a span, and the span's share."""
    for batch in batches:
        rid, template, share = [], [], []
        for r in batch.to_pylist():
            held = longest_chain([(p, p - d["diagonal"]) for d in r["diagonals"] for p in d["positions"]])
            if held >= needed(r["pairs"]):
                rid.append(r["rid"])
                template.append(r["template"])
                share.append(held / r["pairs"])
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(template, pa.int32()), pa.array(share, pa.float64())], ["rid", "template", "share"])


def votes(docs: DataFrame, templates: list[tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """``rid, template, pos, place`` of all matches, and the facts of the templates.

    Each input row also has a row with template -1 whose ``pos`` is its number
    of words, and one with template -2 whose ``pos`` is its doc_id.
    """
    spark = docs.sparkSession
    index, heads = template_index(templates)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text", 1 << 20):
                rid, doc = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                h, off = word_hashes(text)
                rows = C.row_of(off)
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(rid, 2)), pa.concat_arrays([pa.array(np.diff(off)), doc]), pa.array(np.repeat(np.arange(2), n))], ["rid", "pos", "hash"])
                if len(h) > 1:
                    at = np.flatnonzero(rows[:-1] == rows[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(rid[rows[at]]), pa.array(at - off[rows[at]]), pa.array(pair_hashes(h)[at])], ["rid", "pos", "hash"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text")).mapInArrow(grams, "rid long, pos long, hash long")
    places = spark.createDataFrame(index, "hash long, template int, place int")
    facts = spark.createDataFrame(heads, "template int, label string, is_base boolean, pairs int")
    return C.written(rows.join(F.broadcast(places), "hash").select("rid", "template", "pos", "place"), "votes"), facts


def spans(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Verified spans ``rid, template, label, is_base, diagonal, share``; only base phrases have a diagonal."""
    diagonal = F.col("pos") - F.col("place")
    base = found.join(F.broadcast(facts.where("is_base")), "template").groupBy("rid", "template", "label", "pairs", diagonal.alias("diagonal")).agg(F.count("*").alias("n")).where("n = pairs")
    base = base.select("rid", "template", "label", F.lit(True).alias("is_base"), "diagonal", F.lit(1.0).alias("share"))
    # a span covers pairs + DRIFT text positions at most, and so lies in one of two blocks of twice that length
    half = F.col("pairs") + DRIFT
    blocks = F.explode(F.array(F.floor(F.col("pos") / half), F.floor(F.col("pos") / half) - 1)).alias("block")
    least = facts.where("NOT is_base").withColumn("least", F.ceil(F.col("pairs") * round(100 * SHARE) / 100))
    dealt = found.join(F.broadcast(least), "template").select("rid", "template", "pairs", "least", "pos", diagonal.alias("diagonal"), blocks)
    by_diagonal = dealt.groupBy("rid", "template", "pairs", "least", "block", "diagonal").agg(F.collect_list("pos").alias("positions"))
    by_block = by_diagonal.groupBy("rid", "template", "pairs", "least", "block").agg(F.sum(F.size("positions")).alias("n"), F.collect_list(F.struct("diagonal", "positions")).alias("diagonals")).where("n >= least")
    held = by_block.select("rid", "template", "pairs", "diagonals").mapInArrow(_verify, "rid long, template int, share double").groupBy("rid", "template").agg(F.max("share").alias("share"))
    notices = held.join(F.broadcast(facts), "template").select("rid", "template", "label", "is_base", F.lit(None).cast("long").alias("diagonal"), "share")
    return base.unionByName(notices)


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """One row per row of ``docs``: word count, places of the base phrases, labels, score."""
    found, facts = votes(docs, templates or [(*b, True) for b in BASE] + [(*n, False) for n in NOTICES])
    none = F.lit(None)
    heads = found.where("template < 0").select("rid", "template", none.cast("string").alias("label"), none.cast("boolean").alias("is_base"), F.col("pos").alias("diagonal"), none.cast("double").alias("share"))
    base = F.col("is_base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        heads.unionByName(spans(found.where("template >= 0"), facts))
        .groupBy("rid")
        .agg(
            F.max(F.when(F.col("template") == -2, F.col("diagonal"))).alias("doc_id"),
            F.max(F.when(F.col("template") == -1, F.col("diagonal"))).alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
            labels(F.when(base, F.col("label"))).alias("base_labels"),
            labels(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))
