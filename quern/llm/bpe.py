"""Byte-level BPE encoding and decoding by a two-tier lookup (operator 7).

Tier one: the distinct pre-tokens of a chunk are looked up in a minimal perfect
hash of the vocabulary (hash, displace and compare, all vectorised); a pre-token
that is itself a vocabulary entry is one id.  Tier two: each other distinct
pre-token is merged once, with a heap of candidate pairs over doubly linked
bytes, lowest rank first and leftmost among equals, in O(n log n).  Decoding
gathers the ids' bytes.

The rank file is read on the driver and sent to the executors: its size is fixed
by the vocabulary (under 1 MB), not by the data.

Defined cases: a null text counts as empty; an empty text has no tokens and both
its digests are those of no bytes; repeated rows and null ids are encoded row by
row; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common as C

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct merged pre-tokens that a worker remembers before it starts anew.
CACHE = 500_000


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, in id order."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    vocab: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        vocab[int(rank)] = base64.b64decode(token)
    return vocab


#: The pattern that :func:`split` carries out on whole columns.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of each code point, as the pattern's own engine sees it."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(what, every):
                lo, hi = m.span()
                table[ord(every[lo]) : ord(every[hi - 1]) + 1] = kind
        _classes.append(table)
    return _classes[0]


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What SPLIT finds in each row, for all rows of a null-free column at once.

    The matches of one row follow each other without a gap, so it is enough to
    mark where they start: at each change of class; before the last of several
    white-space characters that stand before something else; at a single space
    instead of the run behind it; and behind a contraction.
    """
    data, off = C.buffers(text)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # the byte where each code point starts
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = _class_table()[cp]
    first = np.zeros(n + 1, bool)  # the first code point of a row (or the end)
    rows = np.searchsorted(at, off)
    first[rows] = True
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change |= first
    start = change.copy()
    blank = kind == SPACE
    last = np.zeros(n, bool)  # white space right before something else in its row
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start[:n] |= last
    merged = np.flatnonzero(last & (cp == 0x20)) + 1
    start[merged] = False  # the space opens the run
    quote = np.flatnonzero((cp == 0x27) & start[:n] & change[1:])
    quote = quote[~first[quote + 1]]
    if len(quote):
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = padded[quote + 1], np.where(first[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        q, size = quote[hit], size[hit]
        start[q + 1] = False
        start[q + 1 + size] = True
    begins = np.flatnonzero(start[:n])
    ends = np.concatenate([at[begins], [len(data)]]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data))
    return pieces, np.searchsorted(begins, rows)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings, by hash and displace.

    Keys fall into buckets of about four; large buckets first, each bucket gets
    the first displacement that sends all its keys to free slots.  There are as
    many slots as keys.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.m = max(1, n // 4)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        self.shift = np.zeros(self.m, np.uint64)
        self.slot_to_id = np.full(n, -1, np.int64)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.m))[:-1])
        for b in sorted(range(self.m), key=lambda i: -len(members[i])):
            own = members[b]
            if not len(own):
                continue
            step = 0
            while True:  # many displacements are tried at once
                tries = np.arange(step, step + 64, dtype=np.uint64)
                at = self._slot(h[own][None, :], tries[:, None])
                free = (self.slot_to_id[at] < 0).all(axis=1)
                if len(own) > 1:
                    free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    first = int(np.argmax(free))
                    self.shift[b] = tries[first]
                    self.slot_to_id[at[first]] = own
                    break
                step += 64

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (C.mix(h + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """For each key hash the only id that its key can have."""
        return self.slot_to_id[self._slot(h, self.shift[(h % np.uint64(self.m)).astype(np.int64)])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: pairs leave the heap by rank, then by place."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # end of the part that starts here
    prev = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if dead[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop:  # one of the two has grown since
            continue
        dead[j] = 1
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes columns of text with one vocabulary."""

    def __init__(self, vocab: list[bytes], pattern: str):
        self.vocab, self.pattern = vocab, pattern
        self.hash = PerfectHash(vocab)
        self._ready = False

    def __getstate__(self):
        return {"vocab": self.vocab, "pattern": self.pattern, "hash": self.hash, "_ready": False}

    def _prepare(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.ranks = {t: i for i, t in enumerate(self.vocab)}
        self.tokens = pa.array(self.vocab, pa.large_binary())
        self.merged: dict[bytes, bytes] = {}
        self._ready = True

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct pre-tokens, and their offsets."""
        h = C.hash_strings(pieces)
        at = self.hash.candidates(h)
        raw = pieces.cast(pa.large_binary())
        hit = np.asarray(pc.equal(self.tokens.take(pa.array(at)), raw))
        parts: list[bytes] = []
        if len(self.merged) > CACHE:
            self.merged.clear()
        merged, ranks = self.merged, self.ranks
        for piece in raw.filter(pa.array(~hit)).to_pylist():
            ids = merged.get(piece)
            if ids is None:
                ids = merged[piece] = array("I", merge(piece, ranks)).tobytes()
            parts.append(ids)
        counts = np.ones(len(pieces), np.int64)
        counts[~hit] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        off = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(off[-1], np.uint32)
        flat[off[:-1][hit]] = at[hit]
        flat[C.spread(off[:-1][~hit], counts[~hit])] = np.frombuffer(b"".join(parts), np.uint32)
        return flat, off

    def pieces(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens of all rows, and the offsets of each row's pre-tokens."""
        if self.pattern == SPLIT:
            return split(text)
        found = [self.find(t) for t in text.to_pylist()]
        return pa.array([p for f in found for p in f], pa.large_string()), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and the offsets of each row's ids."""
        if not self._ready:
            self._prepare()
        pieces, ends = self.pieces(text)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        codes, distinct = C.coded(pieces)
        del pieces
        flat, off = self.ids_of(distinct)
        counts = np.diff(off)[codes]
        total = np.concatenate([[0], np.cumsum(counts)])
        return flat[C.spread(off[:-1][codes], counts)], total[ends]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The bytes of each row's ids."""
        if not self._ready:
            self._prepare()
        parts = self.tokens.take(pa.array(ids.astype(np.int64)))
        data, ends = C.buffers(parts)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(ends[off].astype(np.int64).tobytes()), pa.py_buffer(data)])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def _held(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    return spark.sparkContext.broadcast(codec(path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, token_ids array<int>, decoded binary`` for each row of ``docs``.

    ``decoded`` is made from the ids, not from the text.
    """
    held = _held(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text", 1 << 20):
                ids, off = held.value.encode(text)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), lists, held.value.decode(ids, off).cast(pa.binary())], ["doc_id", "n_tokens", "token_ids", "decoded"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of ids and bytes."""
    held = _held(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text", 1 << 20):
                ids, off = held.value.encode(text)
                data, ends = C.buffers(held.value.decode(ids, off))
                raw = ids.astype("<u4")
                spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
                a = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in spans]
                b = [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.documents(spark, sf_dir))
