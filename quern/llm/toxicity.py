"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 9).

Inputs of each word are a hashed word embedding and the mean of hashed
character n-gram embeddings.  Windows of WIDTH words, each overlapping the next by half,
run through a forward and a backward gated recurrent unit; attention pools the
states, a logistic unit scores the pool, and a text's score is that of its worst
window.  Everything is numpy: training by back-propagation through time on the
driver, scoring on the executors, a batch of windows at a time.

Training rows are a bounded sample (``max_positive`` and ``max_negative`` labelled
documents that have a text, chosen by a hash of the id, with ``max_bytes`` of text
at most) of the rows that the caller marks as trainable; texts of any length are in
it, whole.  A toxic document's label is put on its worst window, found anew in each
epoch; all windows of clean documents are clean.  Each epoch scores all windows
anew; its gradient steps see the clean windows with the highest scores and as many
random ones.

Defined cases: a null or empty text has one window without words and gets that
window's score; rows are scored one by one, so repeated rows and null ids each
give their own row; an empty table gives an empty result; without any labelled
row of both kinds the score is 0 everywhere; of several texts with one id the
smallest is trained on; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import rolling

WIDTH, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
WORD_DIM, CHAR_DIM = 6, 10
HIDDEN = 8
BATCH = 4096

def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: rows of the word table; rows of the character table, flat, with owners and sizes.

    The character rows are those of all n-grams of 3 to 5 bytes of the word
    between marks, so that each word has at least one.
    """
    marked = pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), words, pa.scalar("$$", pa.large_string()), pa.scalar("", pa.large_string()))
    data, off = C.buffers(marked)
    p = rolling.prefix(data)
    own = np.arange(len(words))
    rows = (C.mix(rolling.span_hash(p, off[:-1], off[1:])) % np.uint64(WORD_ROWS)).astype(np.int64)
    flat, owner = [], []
    for n in (3, 4, 5):
        count = np.maximum(np.diff(off) - n + 1, 0)
        at = C.spread(off[:-1], count)
        flat.append((C.mix(rolling.span_hash(p, at, at + n) + np.uint64(n)) % np.uint64(CHAR_ROWS)).astype(np.int32))
        owner.append(np.repeat(own.astype(np.int32), count))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows, np.concatenate(flat)[order], owner[order], np.bincount(owner, minlength=len(words))


def tokens(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes of all rows, the distinct words (letters and digits, lower case), row offsets."""
    flat, off = C.words_of(pc.utf8_lower(text))
    codes, distinct = C.coded(flat)
    return codes, pc.replace_substring_regex(distinct, r"^[^\pL\pN]+|[^\pL\pN]+$", ""), off


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of all overlapping windows; the last one ends with its row."""
    n = np.diff(off)
    count = np.maximum(1, -(-(n - WIDTH) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    at = np.minimum(C.spread(np.zeros(len(n), np.int64), count) * STRIDE, np.maximum(n - WIDTH, 0)[row])
    return row, off[:-1][row] + at, np.minimum(n[row], WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.scale = (1.0, 0.0)
        self.p = {"word": n(WORD_ROWS, WORD_DIM) * 0.1, "char": n(CHAR_ROWS, CHAR_DIM) * 0.1, "att": n(2 * h, h), "vec": n(h), "out": n(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": n(d, 3 * h), f"h{side}": n(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    def embed(self, made: tuple) -> np.ndarray:
        """An input vector for each distinct word of :func:`features`; a last row of zeros stands for padding."""
        rows, flat, _, sizes = made
        out = np.zeros((len(rows) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(rows):
            out[:-1, :WORD_DIM] = self.p["word"][rows]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for lo in range(0, len(rows), 1 << 14):  # bounded pieces
                hi = min(lo + (1 << 14), len(rows))
                part = self.p["char"][flat[begin[lo] : begin[hi]]]
                out[lo:hi, WORD_DIM:] = np.add.reduceat(part, begin[lo:hi] - begin[lo]) / sizes[lo:hi, None]
        return out

    def forward(self, projected: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        """Scores of windows; ``at[b, t]`` is the input row of step t (-1: padding)."""
        p, h = self.p, HIDDEN
        b, steps = at.shape
        states = np.zeros((steps, b, 2 * h), np.float32)
        tape = {}
        for k, side in enumerate("fb"):
            s = np.zeros((b, h), np.float32)
            order = range(steps) if side == "f" else range(steps - 1, -1, -1)
            for t in order:
                x = projected[side][at[:, t]]
                g = s @ p[f"h{side}"]
                gates = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                new = s + z * (c - s)
                new = np.where((at[:, t] < 0)[:, None], s, new)
                if keep:
                    tape[side, t] = (s, z, r, c, g[:, 2 * h :])
                s = new
                states[t, :, k * h : (k + 1) * h] = s
        u = np.tanh(states @ p["att"])
        e = u @ p["vec"] + np.where(at.T < 0, np.float32(-1e9), np.float32(0))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pool = np.einsum("tb,tbh->bh", a, states)
        score = _sigmoid(pool @ p["out"] + p["bias"][0])
        return (score, (states, u, a, pool, tape)) if keep else score

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"x{s}"] + self.p[f"b{s}"] for s in "fb"}

    def gradients(self, x: np.ndarray, owners: tuple, at: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        proj = self.project(x)
        score, (states, u, a, pool, tape) = self.forward(proj, at, keep=True)
        d = ((score - label) / len(label)).astype(np.float32)
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dpool, states)
        de = a * (da - (a * da).sum(axis=0))
        du = de[:, :, None] * p["vec"] * (1 - u * u)
        g["vec"] = np.einsum("tb,tbh->h", de, u)
        g["att"] = np.einsum("tbi,tbj->ij", states, du)
        ds = a[:, :, None] * dpool + du @ p["att"].T
        dx = np.zeros_like(x)
        by_row = np.argsort(at.T.ravel(), kind="stable")
        where = at.T.ravel()[by_row]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for k, side in enumerate("fb"):
            steps = np.zeros((at.shape[1], len(at), 3 * h), np.float32)
            g[f"h{side}"] = np.zeros_like(p[f"h{side}"])
            carry = np.zeros((len(at), h), np.float32)
            order = range(at.shape[1] - 1, -1, -1) if side == "f" else range(at.shape[1])
            for t in order:
                s, z, r, c, gc = tape[side, t]
                live = (at[:, t] >= 0)[:, None]
                dn = carry + ds[t, :, k * h : (k + 1) * h]
                dc = np.where(live, dn * z * (1 - c * c), 0)
                dz = np.where(live, dn * (c - s) * z * (1 - z), 0)
                dr = dc * gc * r * (1 - r)
                full = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"h{side}"] += s.T @ full
                carry = np.where(live, dn * (1 - z), dn) + full @ p[f"h{side}"].T
                steps[t] = np.concatenate([dz, dr, dc], axis=1)
            dproj = np.zeros_like(proj[side])
            dproj[where[first]] = np.add.reduceat(steps.reshape(-1, 3 * h)[by_row], first)
            dproj[-1] = 0
            g[f"x{side}"] = x.T @ dproj
            g[f"b{side}"] = dproj.sum(axis=0)
            dx += dproj @ p[f"x{side}"].T
        rows, flat, owner, sizes = owners
        dw = dx[:-1]
        g["word"] = np.stack([np.bincount(rows, dw[:, j], WORD_ROWS) for j in range(WORD_DIM)], axis=1)
        per = (dw[:, WORD_DIM:] / sizes[:, None])[owner]
        g["char"] = np.stack([np.bincount(flat, per[:, j], CHAR_ROWS) for j in range(CHAR_DIM)], axis=1)
        return g


def _grid(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    steps = np.arange(WIDTH)
    at = np.minimum(start[:, None] + steps, max(len(codes) - 1, 0))
    return np.where(steps < length[:, None], codes[at] if len(codes) else -1, -1).astype(np.int32)


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, seed: int = 7, per_toxic: int = 4) -> Network:
    """Fit a network on texts with labels 0 and 1 (Adam); an epoch's steps see ``per_toxic`` clean windows for a toxic text, and 2000 more."""
    net, rng = Network(seed), np.random.default_rng(seed)
    codes, words, off = tokens(pa.array(texts, pa.large_string()))
    row, start, length = windows(off)
    # evidence of each character n-gram and word: log odds of document frequencies
    made = features(words)
    which, flat, _, sizes = made
    pairs = np.unique(C.row_of(off) * len(words) + codes)
    doc, word = pairs // len(words), pairs % len(words)
    npos = max(1, labels.sum())
    nneg = max(1, len(labels) - npos)

    def odds(of_word, size: int) -> np.ndarray:
        """Log odds per table row; ``of_word(w)`` gives the rows of words w and how many each has."""
        a, b = np.zeros(size), np.zeros(size)
        edges = np.searchsorted(doc, np.arange(0, len(texts) + 64, 64))
        for lo, hi in zip(edges[:-1], edges[1:]):  # 64 texts at a time
            ids, count = of_word(word[lo:hi])
            seen = np.unique(np.repeat(doc[lo:hi], count) * size + ids)
            d, i = seen // size, seen % size
            a += np.bincount(i, labels[d], size)
            b += np.bincount(i, 1 - labels[d], size)
        return np.clip(np.log(((a + 0.5) / (npos + 1)) / ((b + 0.5) / (nneg + 1))) * np.minimum(1, (a + b) / 8), -3, 4)

    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    char = odds(lambda w: (flat[C.spread(begin[w], sizes[w])], sizes[w]), CHAR_ROWS)
    wrd = odds(lambda w: (which[w], np.ones(len(w), np.int64)), WORD_ROWS)
    net.p["char"][:, 0], net.p["word"][:, 0] = char / 2, wrd / 2
    evidence = np.maximum.reduceat(char[flat], begin) + wrd[which]
    grid = _grid(codes, start, length)
    hint = np.where(grid < 0, -9.0, evidence[grid]).max(axis=1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    positive = labels[row] == 1
    for epoch in range(epochs):
        proj = net.project(net.embed(made))
        rank = hint if epoch == 0 else np.concatenate([net.forward(proj, grid[i : i + BATCH]) for i in range(0, len(grid), BATCH)])
        order = np.lexsort((-rank, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        pos = best[positive[best]]
        neg = np.flatnonzero(~positive)
        cap = min(len(neg), per_toxic * len(pos) + 2000)
        hard = neg[np.argsort(-rank[neg], kind="stable")[: cap // 2]]
        use = np.concatenate([pos, pos, hard, rng.choice(neg, cap - len(hard), replace=False)]) if len(neg) else pos
        rng.shuffle(use)
        for i in range(0, len(use), 256):
            b = use[i : i + 256]
            inside, at = np.unique(grid[b], return_inverse=True)
            pad = inside[0] < 0
            at = at.reshape(grid[b].shape) - int(pad)  # -1 stands for padding again
            own = inside[int(pad) :]
            part = (which[own], flat[C.spread(begin[own], sizes[own])], np.repeat(np.arange(len(own)), sizes[own]), sizes[own])
            g = net.gradients(net.embed(part), part, at, positive[b].astype(np.float32))
            step += 1
            rate = 0.02 / (1 + step / 150)
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.scale = _calibrate(_worst(net, net.project(net.embed(made)), grid, row, len(texts)), labels)
    return net


def _worst(net: Network, proj: dict[str, np.ndarray], grid: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for i in range(0, len(row), BATCH):
        np.maximum.at(out, row[i : i + BATCH], net.forward(proj, grid[i : i + BATCH]))
    return out


def _logit(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 1e-7, 1 - 1e-7)
    return np.log(s / (1 - s))


#: Where the score 0.7 lies: this part of the way up to the toxic texts' low end, in logits.
PLACE = 0.65


def _calibrate(s: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that place the score 0.7 below the toxic texts and above the clean ones."""
    x = _logit(s)
    if not (labels == 1).any():
        return 1.0, 0.0
    low = float(np.quantile(x[labels == 1], 0.01))
    at = max(PLACE * low, min(low, float(x[labels == 0].max(initial=-20)))) if low > 0 else low
    return 1.0, float(np.log(0.7 / 0.3)) - at


def score_rows(net: Network, text: pa.Array) -> np.ndarray:
    """The worst window's score of each row."""
    codes, words, off = tokens(text)
    proj = net.project(net.embed(features(words)))
    row, start, length = windows(off)
    out = np.zeros(len(text))
    for i in range(0, len(row), BATCH):
        s = slice(i, i + BATCH)
        np.maximum.at(out, row[s], net.forward(proj, _grid(codes, start[s], length[s])))
    a, b = net.scale
    return _sigmoid(a * _logit(out) + b)


def fold(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 1200, max_negative: int = 2800, max_bytes: int = 64 << 20) -> Network | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = C.pick(docs, "doc_id", "text").where("text <> ''").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"))
    near = F.xxhash64(F.col("doc_id"), F.lit(11))
    full = ids.join(sizes, "doc_id")
    chosen = [full.where(F.col("toxic") == k).orderBy(near, "doc_id").limit(most).collect() for k, most in ((1, max_positive), (0, max_negative))]
    picked = [(r["doc_id"], r["toxic"]) for rows in chosen for r, total in zip(rows, np.cumsum([r["bytes"] for r in rows])) if total <= max_bytes // 2]
    few = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")  # at most max_positive + max_negative
    texts = C.pick(docs, "doc_id", "text").where("text <> ''").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.select("doc_id", "text", "toxic").collect())
    if len({r["toxic"] for r in rows}) < 2:
        return None
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in C.chunks(batch, "text"):
                s = score_rows(held.value, text) if held.value else np.zeros(len(text))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
