"""Language-model scoring with a hashed maximum-entropy model (operator 3).

The probability of a token w after the words before it, h, is factored by class:
p(w | h) = p(class(w) | h) * p(w | class(w)).

* Frequent words are classes of their own; other words share a class with the
  words that end alike (a rule on the word's own bytes, so no table is needed).
  Within a class a word has its smoothed share of the class's training tokens.
* The softmax over classes is factored again, along a Huffman tree of the
  classes: each inner node is a two-way softmax.  Its log odds are those of the
  training counts plus one weight for each history feature, hashed with the node:
  the previous word, the two previous words together (the n-grams), and the word
  before the previous one (the skip).  Without weights this is the unigram model.

Counts cover every training document.  Weights are trained by gradient updates
that are distributed by feature: tokens are dealt to buckets by their previous
word (and, where that word is hot, by the one before and by the document), and
each bucket has a weight table of its own, makes updates on mini-batches of its
training tokens in the order of the documents' keys, and then scores all its
tokens.  A bucket has BUCKET_TOKENS tokens on average, so tables grow in number
with the corpus, none is broadcast or merged, and no result depends on how the
input is partitioned.  A task takes several buckets, one after the other, and adds
up their parts of a document, so that a document has a sum for each task and not
for each bucket (but where a task sees more than SUMS documents).

Only tables of bounded size are sent to the executors: the tree with its class
totals, and the counts of at most HEAD frequent words.  Rarer words are looked up
by a shuffle join on the word, so that no part of the method bounds the vocabulary.

Defined cases: a null text counts as empty; an empty text has one token, the
end; rows are told apart by id and text, so repeated rows get equal results;
null ids are held out (the crc32 of an empty text is 0); with no training token
at all, c = N = V = 0; other columns are never looked at.
"""

from __future__ import annotations

import heapq
import itertools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling

#: Words whose counts every executor holds, at most.
HEAD = 1 << 17
#: Frequent words (and the end) that are classes of their own, at most; classes of other words.
SINGLE, SHARED = 1 << 15, 1 << 13
#: Tokens of a bucket on average; slots of its weight table for each kind of feature.
BUCKET_TOKENS, BITS = 1 << 20, 21
#: The first of the slots, with weight 0, of features that do not count.
IDLE = 1 << BITS
#: Words with more tokens than this are dealt to buckets with the word before them.
HOT = BUCKET_TOKENS // 8
#: Tasks that take the buckets, where there are as many buckets; buckets of a task on average, at most.
TASKS, PER_TASK = 32, 64
#: Documents' sums that such a task holds (16 bytes each); those of more documents leave in parts.
SUMS = 1 << 22
#: First steps of the weights of each kind of feature; tokens of a mini-batch.
RATES, BATCH = (0.4, 1.5, 0.25), 4096
END = "\n"  # cannot be a word
_A = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _training(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i in ids.to_pylist()], bool)


def token_rows(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens of all rows and, flat, each token's code; every row ends with code 0, the end."""
    flat, off = C.words_of(pc.ascii_lower(text))
    codes, distinct = C.coded(flat)
    n = np.diff(off)
    out = np.zeros(len(codes) + len(n), np.int64)
    keep = np.ones(len(out), bool)
    ends = off[1:] + np.arange(len(n))
    keep[ends] = False
    out[keep] = codes + 1
    return pa.concat_arrays([pa.array([END], pa.large_string()), distinct.cast(pa.large_string())]), out, np.concatenate([[0], ends + 1])


def hashes(words: pa.Array) -> np.ndarray:
    data, off = C.buffers(words)
    return C.mix(rolling.span_hash(rolling.prefix(data), off[:-1], off[1:]))


def shared_class(words: pa.Array) -> np.ndarray:
    """Class, from 0, of words that are not classes of their own: by their last letters."""
    bare = pc.ascii_rtrim(words, characters=string.punctuation)
    data, off = C.buffers(bare)
    tail = np.maximum(off[1:] - 4, off[:-1])
    marks = (np.asarray(pc.binary_length(bare)) != np.asarray(pc.binary_length(words))).astype(np.uint64)
    h = C.mix(rolling.span_hash(rolling.prefix(data), tail, off[1:]) + marks)
    return (h % np.uint64(SHARED)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over all training documents, the end included (map-side counts, one shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_training(batch.column(0))))
            for _, text in C.chunks(batch, "text", 8 << 20):
                words, codes, _ = token_rows(text)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Tree:
    """A Huffman tree of weighted leaves: the path of each leaf, and the log odds of each inner node."""

    def __init__(self, weight: np.ndarray):
        n = len(weight)
        total = np.concatenate([weight, np.zeros(n)])
        parent, branch = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.float32)
        heap = list(zip(weight.tolist(), range(n)))
        heapq.heapify(heap)
        top = n
        while len(heap) > 1:
            (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = top
            branch[j], total[top] = 1, x + y
            heapq.heappush(heap, (x + y, top))
            top += 1
        up = np.flatnonzero(branch)
        ones = np.bincount(parent[up], total[up], 2 * n)[n:top]
        self.bias = np.log(ones / (total[n:top] - ones)).astype(np.float32)
        self.depth = np.zeros(n, np.int64)
        steps, live, at = [], np.arange(n), np.arange(n)
        while len(live):
            live, at = live[at != top - 1], at[at != top - 1]
            steps.append((live, parent[at] - n, branch[at]))
            self.depth[live] += 1
            at = parent[at]
        self.start = np.concatenate([[0], np.cumsum(self.depth)])[:-1]
        self.node, self.side = np.zeros(int(self.depth.sum()), np.int32), np.zeros(int(self.depth.sum()), np.float32)
        for k, (leaf, node, side) in enumerate(steps):
            self.node[self.start[leaf] + k], self.side[self.start[leaf] + k] = node, side
        # nodes of four levels share a mark and differ by four bits: their weights lie within 64 bytes
        high, mark, bits = np.zeros(2 * n, np.int64), np.arange(2 * n, dtype=np.uint32), np.ones(2 * n, np.uint32)
        for i in range(top - 2, n - 1, -1):
            over = parent[i]
            high[i] = (high[over] + 1) % 4
            if high[i]:
                mark[i], bits[i] = mark[over], 2 * bits[over] + branch[i]
        # the same paths level by level, from the root: in each level, only the leaves that reach so deep, by falling depth
        deep = np.argsort(-self.depth, kind="stable")
        self.rank = np.empty(n, np.uint16 if n <= 1 << 16 else np.int64)  # 16 bits: a radix sort
        self.rank[deep] = np.arange(n)
        mark, bits, self.levels = mark[n:] * np.uint32(0x9E3779B1), bits[n:].astype(np.int64), []
        self.reach = []  # how many leaves reach each level
        for k in range(int(self.depth.max(initial=0))):
            live = deep[: np.count_nonzero(self.depth > k)]
            at = self.start[live] + self.depth[live] - 1 - k
            node = self.node[at]
            self.reach.append(len(live))
            self.levels.append((None if k % 4 else mark[node], bits[node], self.bias[node], self.side[at]))

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps of each leaf's path; flat, their nodes and branches."""
        n = self.depth[leaf]
        at = C.spread(self.start[leaf], n)
        return n, self.node[at], self.side[at]


class Weights:
    """Hashed weights of one bucket, and the sums of squared gradients that set their rates."""

    def __init__(self, tree: Tree, kinds: int):
        self.tree = tree
        self.w = np.zeros((kinds, IDLE + 16), np.float32)
        self.g = np.ones((kinds, IDLE + 16), np.float32)
        self._room(1 << 16)

    def _room(self, steps: int) -> None:
        """Room for the steps of a call, used again by the next one: fresh memory costs more than the work in it."""
        self.slots = np.empty((len(self.w), steps), np.int64)
        self.parts = np.empty((3, steps), np.float32)

    def _logits(self, feats: np.ndarray, use: np.ndarray, leaf: np.ndarray):
        """The steps of all paths, level by level from the root, where a level has the first tokens of an order by depth.

        That order and the places where levels begin; flat, until the next call: branches, slots and log odds.
        Levels are short arrays that stay in the processor's cache, and four of them share the hash of a feature
        and its weights' 64 bytes.
        """
        rank = self.tree.rank[leaf]
        order = np.argsort(rank, kind="stable")
        rank = rank[order].astype(np.int64)
        feats, idle = feats[:, order], np.where(use[:, order], np.uint32(0), np.uint32(IDLE))
        many = np.searchsorted(rank, self.tree.reach)
        many = many[many > 0].tolist()
        begin = [0, *itertools.accumulate(many)]
        if begin[-1] > self.slots.shape[1]:
            self._room(begin[-1])
        (side, z), slots = self.parts[:2, : begin[-1]], self.slots[:, : begin[-1]]
        for top in range(0, len(many), 4):
            n = many[top]
            base = feats[:, :n] ^ self.tree.levels[top][0].take(rank[:n])
            base *= np.uint32(0x85EBCA6B)
            base >>= np.uint32(32 - BITS)
            base = np.maximum(base, idle[:, :n], out=base).astype(np.int64)
            level = []
            for k in range(top, min(top + 4, len(many))):
                lo, hi, at = begin[k], begin[k + 1], rank[: many[k]]
                _, bits, odds, branch = self.tree.levels[k]
                odds.take(at, out=z[lo:hi], mode="clip")
                branch.take(at, out=side[lo:hi], mode="clip")
                np.bitwise_xor(base[:, : hi - lo], bits.take(at), out=slots[:, lo:hi])
                level.append((lo, hi, z[lo:hi]))
            for w, slot in zip(self.w, slots):
                for lo, hi, sums in level:
                    np.add(sums, w.take(slot[lo:hi]), out=sums)
        return (order, begin), side, [(k, slot) for k, slot in enumerate(slots)], z

    def update(self, feats: np.ndarray, use: np.ndarray, leaf: np.ndarray) -> None:
        """One gradient step on a mini-batch of tokens; ``use`` tells which features count."""
        _, side, slots, z = self._logits(feats, use, leaf)
        d = np.clip(z, -30, 30, out=z)
        np.exp(np.negative(d, out=d), out=d)
        np.divide(1, np.add(d, 1, out=d), out=d)
        d -= side
        step, root = side, self.parts[2, : len(d)]  # the branches are of no more use
        for w, g, (_, slot), rate in zip(self.w, self.g, slots, RATES):
            np.add.at(g, slot, np.multiply(d, d, out=step))
            np.sqrt(g.take(slot, out=root, mode="clip"), out=root)
            np.subtract.at(w, slot, np.divide(np.multiply(d, np.float32(rate), out=step), root, out=step))
            w[IDLE:], g[IDLE:] = 0, 1

    def log_class(self, feats: np.ndarray, use: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The log probability of each token's class."""
        (order, begin), side, _, z = self._logits(feats, use, leaf)
        x = np.multiply(z, np.subtract(1, np.multiply(side, 2, out=side), out=side), out=z)
        ones = np.abs(x, out=self.parts[2, : len(x)])
        np.exp(np.negative(ones, out=ones), out=ones)
        np.maximum(x, 0, out=x)
        product, total = np.ones(len(leaf)), np.zeros(len(leaf))
        for lo, hi in zip(begin, begin[1:]):
            product[: hi - lo] *= 1 + ones[lo:hi].astype(np.float64)  # in (1, 2], so that the product of a path is exact enough
            total[: hi - lo] += x[lo:hi]
        out = np.empty(len(leaf))
        out[order] = -np.log(product) - total
        return out


def grouped(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys, from 0 and below ``size``, are neighbours, and there whether a key is another than the one before."""
    low = len(key).bit_length()
    if low + (size - 1).bit_length() <= 64:  # values with their places sort several times faster than places
        key = (key.astype(np.uint64) << np.uint64(low)) | np.arange(len(key), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
        key >>= np.uint64(low)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]


class Shared:
    """Features, below ``size``, of tokens: the distinct ones in rising order, and which of them a training token has and some other token too.

    A weight of any other feature is 0 or read by no token but the one that moved
    it; without these, fewer features meet in a slot.
    """

    def __init__(self, feature: np.ndarray, size: int, trains: np.ndarray):
        self.order, new = grouped(feature, size)
        self.which = np.cumsum(new) - 1  # of the tokens in ``order``
        start = np.flatnonzero(new)
        self.distinct = feature[self.order[start]]
        self.use = (np.add.reduceat(trains[self.order].astype(np.int64), start) > 0) & (np.diff(start, append=len(new)) > 1)

    def by_token(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.which), values.dtype)
        out[self.order] = values[self.which]
        return out


def features(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Hashes of the features of tokens after the word a, which follows the word s, 64 bits of each."""
    a, s = a.astype(np.uint64), s.astype(np.uint64)
    return np.stack([C.mix(a + np.uint64(11)), C.mix((a << np.uint64(32)) + s), C.mix(s + (np.uint64(5) << np.uint64(40)))])


def short(feats: np.ndarray) -> np.ndarray:
    """The 32 bits of features that go into slots; many 32-bit products are made at once."""
    return (feats >> np.uint64(32)).astype(np.uint32)


def plan(a: np.ndarray, s: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], Shared]:
    """Features of tokens and which of them count; the same for each distinct history, and the tokens' histories."""
    ones, skips = Shared(a, 1 << 32, trains), Shared(s, 1 << 32, trains)
    n = len(skips.distinct)
    pairs = Shared(ones.by_token(np.arange(len(ones.distinct))) * n + skips.by_token(np.arange(n)), len(ones.distinct) * n, trains)
    one, skip = pairs.distinct // n, pairs.distinct % n
    feats = short(features(ones.distinct[one], skips.distinct[skip]))
    use = np.stack([ones.use[one], pairs.use, skips.use[skip]])
    return short(features(a, s)), np.stack([x.by_token(x.use) for x in (ones, pairs, skips)]), (feats, use), pairs


def scores(weights: Weights, leaf: np.ndarray, feats: np.ndarray, use: np.ndarray, rows: Shared) -> np.ndarray:
    """Each token's log probability of its class: once for each history and class, in an order in which neighbours have weights in common."""
    classes = len(weights.tree.rank)
    key = rows.which * classes + leaf[rows.order]
    order, new = grouped(key, len(rows.use) * classes)
    distinct = key[order[new]]
    row, leaves = distinct // classes, distinct % classes
    each = np.concatenate([weights.log_class(feats[:, row[k : k + BATCH]], use[:, row[k : k + BATCH]], leaves[k : k + BATCH]) for k in range(0, len(row), BATCH)])
    lp = np.empty(len(leaf))
    lp[rows.order[order]] = each[np.cumsum(new) - 1]
    return lp


class Model:
    """Class map, class totals, the tree of classes, and the head of the vocabulary."""

    def __init__(self, head: list[tuple[str, int]], total: int, size: int):
        self.total, self.size = total, size
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.words = pa.array([w for w, _ in head], pa.large_string())
        self.count = np.array([c for _, c in head], np.float64)
        self.marks = np.concatenate([[0, 1], hashes(self.words) >> np.uint64(32)]).astype(np.uint32)  # behind those of a row's begin
        self.single = min(len(head), SINGLE)
        self.classes_in_all = self.single + SHARED
        self.buckets = 1 + total // BUCKET_TOKENS
        self.tasks = min(self.buckets, max(TASKS, -(-self.buckets // PER_TASK)))
        self.tree, self.within = None, np.zeros(self.classes_in_all)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is in the head, and its place there."""
        at = pc.index_in(words, self.words)
        return np.asarray(pc.is_valid(at)), np.asarray(pc.fill_null(at, 0)).astype(np.int64)

    def classes(self, words: pa.Array, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Classes of words; ``found`` is what :meth:`known` gave for them."""
        known, at = found or self.known(words)
        return np.where(known & (at < self.single), at, self.single + shared_class(words))

    def settle(self, tokens: np.ndarray, words: np.ndarray) -> None:
        """Take the classes' training tokens and distinct words."""
        self.within = np.log10(tokens + 0.1 * (words + 1))
        self.tree = Tree(tokens + 0.5)

    def hot(self, words: pa.Array, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        known, at = found or self.known(words)
        return known & (self.count[at] > HOT) if len(self.count) else known


def previous(values: np.ndarray, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, by code, of the word before each token and of the one before that (0 and 1 stand for the row's begin)."""
    a, s, first = np.empty(len(codes), values.dtype), np.empty(len(codes), values.dtype), off[:-1]
    a[1:], s[2:] = values[codes[:-1]], values[codes[:-2]]
    second = first + 1
    a[first], s[first], s[second[second < off[1:]]] = 0, 0, 1
    return a, s


def history(words: pa.Array, codes: np.ndarray, off: np.ndarray, hot: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the previous word and the one before (0 and 1 stand for the row's begin), and each token's bucket."""
    n, first = len(codes), off[:-1]
    a, s = previous(hashes(words) >> np.uint64(32), codes, off)
    second = first + 1
    second = second[second < off[1:]]
    hot_a, hot_s = np.zeros(n, bool), np.zeros(n, bool)
    hot_a[1:], hot_s[2:] = hot[codes[:-1]], hot[codes[:-2]]
    hot_a[first] = hot_s[first] = hot_s[second] = True
    key = C.mix(a + np.uint64(1))
    key = np.where(hot_a, C.mix(key * _A + s), key)
    key = np.where(hot_a & hot_s, C.mix(key * _A + docs.view(np.uint64)[C.row_of(off)]), key)
    return a.astype(np.uint32), s.astype(np.uint32), (key % np.uint64(buckets)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit values, place by place, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _values(data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view("<u4").ravel()


def _packed(place: np.ndarray, marks: np.ndarray, head: int) -> bytes:
    """Marks of words, for those with a place below ``head`` that place: it is small where the word is frequent, and marks are random."""
    near = _planes(place)
    return len(near).to_bytes(4, "little") + near + _planes(marks[place == head])


def _unpacked(data: bytes, n: int, marks: np.ndarray) -> np.ndarray:
    """Undoes :func:`_packed`; ``marks`` are those of the places below the head's size."""
    cut = 4 + int.from_bytes(data[:4], "little")
    place = _values(data[4:cut], n)
    far = place == len(marks)
    out = marks[np.where(far, 0, place)]
    out[far] = _values(data[cut:], np.count_nonzero(far))
    return out


def _deal(held):
    """Tokens by bucket: documents, their numbers of tokens, whether they train, and the tokens' histories and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, text in C.chunks(batch, "text", 4 << 20):
                dk, trains = part.column(0).to_numpy(), _training(part.column(1))
                words, codes, off = token_rows(text)
                found = model.known(words)  # once: each look-up makes a hash table of the head
                cls = model.classes(words, found)
                a, s, bucket = history(words, codes, off, model.hot(words, found), dk, model.buckets)
                near, nearer = previous(np.where(found[0], found[1] + 2, len(model.marks)).astype(np.uint32), codes, off)
                order = np.argsort(bucket.astype(np.uint16) if model.buckets < 1 << 16 else bucket, kind="stable")  # 16 bits: a radix sort
                row, leaf = C.row_of(off)[order], cls[codes][order]
                a, s, near, nearer, bucket = a[order], s[order], near[order], nearer[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for lo, hi in zip(cut[:-1], cut[1:]):
                    own, n = np.unique(row[lo:hi], return_counts=True)
                    packed = [_packed(near[lo:hi], a[lo:hi], len(model.marks)), _packed(nearer[lo:hi], s[lo:hi], len(model.marks)), _planes(leaf[lo:hi])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[lo])]), pa.array([dk[own]]), pa.array([n]), pa.array([trains[own]]), *[pa.array([x], pa.binary()) for x in packed]], ["bucket", "dk", "n", "trains", "a", "s", "leaf"]
                    )

    return run


class Sums:
    """Sums by document of what a task's buckets give: a row for each document, unless there are more than SUMS."""

    def __init__(self):
        self.dk, self.lp, self.size = [], [], 0

    def add(self, dk: np.ndarray, lp: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.dk.append(dk)
        self.lp.append(lp)
        self.size += len(dk)
        if self.size > SUMS:
            self._merge()
            if self.size > SUMS // 2:
                yield from self.rest()

    def _merge(self) -> None:
        dk, at = np.unique(np.concatenate(self.dk), return_inverse=True)
        self.dk, self.lp, self.size = [dk], [np.bincount(at, np.concatenate(self.lp), len(dk))], len(dk)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            for k in range(0, self.size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][k : k + (1 << 16)]) for x in (self.dk, self.lp)], ["dk", "lp"])
        self.dk, self.lp, self.size = [], [], 0


def _learn(held):
    """For each bucket: train on its training tokens, then score its part of each document; ``dk, lp`` are sums over a task's buckets."""

    def bucket(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        dk, n, trains = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        a, s = (np.concatenate([_unpacked(b[k], int(b[1].sum()), held.value.marks) for b in blocks]) for k in (3, 4))
        leaf = np.concatenate([_values(b[5], int(b[1].sum())) for b in blocks])
        order = np.argsort(dk, kind="stable")  # whatever the order in which the blocks came
        token = C.spread((np.cumsum(n) - n)[order], n[order])
        dk, n, trains = dk[order], n[order], trains[order]
        a, s, leaf, learns = a[token], s[token], leaf[token].astype(np.int64), np.repeat(trains, n)
        feats, use, pairs, rows = plan(a, s, learns)
        weights = Weights(held.value.tree, 3)
        own = np.flatnonzero(learns)
        for k in range(0, len(own), BATCH):
            at = own[k : k + BATCH]
            weights.update(feats[:, at], use[:, at], leaf[at])
        lp = scores(weights, leaf, *pairs, rows)
        lp = np.add.reduceat(lp, np.cumsum(n) - n)
        first = np.concatenate([[True], dk[1:] != dk[:-1]])  # repeated rows have equal parts
        return dk[first], lp[first] / np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, sums = [], None, Sums()
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != now and blocks:
                    yield from sums.add(*bucket(blocks))
                    blocks = []
                now = batch.column(0)[k].as_py()
                blocks.append((*[batch.column(j)[k].values.to_numpy(zero_copy_only=False).copy() for j in (1, 2, 3)], *[batch.column(j)[k].as_py() for j in (4, 5, 6)]))
        if blocks:
            yield from sums.add(*bucket(blocks))
        yield from sums.rest()
        C.give_back()

    return run


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model without its weights, and the table of all training counts."""
    table = C.written(counts(docs), "lm-counts")
    # as many words as fit in the head, down to some count; told by a histogram that is exact for small counts
    step = F.when(F.col("c") < 256, F.col("c")).otherwise(F.floor(F.log2("c") * 32))
    fits, total, size, least = True, 0, 0, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect(), key=lambda r: -r["least"]):
        total, size = total + r["c"], size + r["n"]
        fits = fits and size <= HEAD
        least = r["least"] if fits else least
    head = [] if least is None else [(r[0], r[1]) for r in table.where(F.col("c") >= least).collect()]
    model = Model(head, total, size)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(model.classes_in_all, np.int64), np.zeros(model.classes_in_all, np.int64)
        for batch in batches:
            cls = model.classes(batch.column(0).cast(pa.large_string()))
            tokens += np.bincount(cls, batch.column(1).to_numpy(), len(tokens)).astype(np.int64)
            words += np.bincount(cls, minlength=len(words))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens[some]), pa.array(words[some])], ["class", "tokens", "words"])

    tokens, words = np.zeros(model.classes_in_all), np.zeros(model.classes_in_all)
    for r in table.mapInArrow(by_class, "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect():  # a row for each class
        tokens[r[0]], words[r[0]] = r[1], r[2]
    model.settle(tokens, words)
    return model, table


def score(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with the base score and the model's log10 probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    log_n = float(np.log10(model.total + 0.1 * (model.size + 1)))
    slim = C.pick(docs, "doc_id", "text").select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("dk"), F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        n_out = 0
        for batch in batches:
            for part, text in C.chunks(batch, "text", 4 << 20):
                words, codes, off = token_rows(text)
                known, at = m.known(words)
                lc = np.where(known, np.log10(m.count[at] + 0.1), 0.0) if len(m.count) else np.zeros(len(words))
                local, within = lc[codes], m.within[m.classes(words, (known, at))][codes]
                sums = lambda x: np.add.reduceat(x, off[:-1])
                n = np.diff(off)
                far = ~known[codes]
                rows = C.row_of(off)
                key = rows[far] * len(words) + codes[far]
                pairs, times = np.unique(key, return_counts=True)
                row, word = pairs // len(words), pairs % len(words)
                rid = np.arange(n_out, n_out + len(n))
                n_out += len(n)
                null = pa.nulls(len(n), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), part.column(0), part.column(1), null, pa.array(n), pa.array(sums(known[codes].astype(np.int64))), pa.array(sums(local)), pa.array(sums(local - within))],
                    ["seq", "dk", "doc_id", "word", "n", "known", "base", "share"],
                )
                if len(pairs):
                    none = lambda kind: pa.nulls(len(row), kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[row]), none(pa.int64()), none(pa.int64()), words.take(pa.array(word)).cast(pa.string()), pa.array(times), none(pa.int64()), none(pa.float64()), none(pa.float64())],
                        ["seq", "dk", "doc_id", "word", "n", "known", "base", "share"],
                    )

    # a row of the input is known by its partition and its place there; both sides below come from one written table
    made = C.written(slim.mapInArrow(run, "seq long, dk long, doc_id long, word string, n long, known long, base double, share double").withColumn("task", F.spark_partition_id()), "lm-rows")
    rare = table.where(F.col("c") < float(model.count.min())) if len(model.count) else table
    tail = made.where("word IS NOT NULL").join(rare, "word", "left")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1) * F.col("n")
    none = F.lit(None).cast("long")
    parts = tail.select("task", "seq", none.alias("dk"), none.alias("doc_id"), F.lit(0).cast("long").alias("n"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), log_c.alias("base"), log_c.alias("share"))
    own = made.where("word IS NULL").select("task", "seq", "dk", "doc_id", "n", "known", "base", "share")
    # written before the tokens are dealt, so that neither these rows nor the shuffles above lie on disk beside them
    sums = own.unionByName(parts).groupBy("task", "seq").agg(F.max("dk").alias("dk"), F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "share")])
    sums = C.written(sums, "lm-sums")
    C.forget(made)
    blocks = slim.mapInArrow(_deal(held), "bucket long, dk array<long>, n array<long>, trains array<boolean>, a binary, s binary, leaf binary")
    dealt = blocks.repartitionById(model.tasks, (F.col("bucket") % model.tasks).cast("int"))  # as many buckets for each task
    learnt = dealt.sortWithinPartitions("bucket").mapInArrow(_learn(held), "dk long, lp double")
    classes = learnt.groupBy("dk").agg(F.sum("lp").alias("lp"))
    return sums.join(classes, "dk").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") - log_n * F.col("n")).alias("base_score"), (F.col("share") + F.col("lp")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, *fit(docs))
