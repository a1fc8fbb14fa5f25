"""Operator 3: the base score exactly, the model against the base on held-out texts."""

import math
import os
import re
import uuid
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import lm


def tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def trains(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0


@pytest.mark.parametrize("head", [1 << 17, 8])  # 8: most words are looked up by the join
def test_base_score_is_exact(table, rng, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(vocab[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 80)))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "w1 W2 \n w3"), (3, docs[3][1]), (502, "unseen words " * 10)]
    count = Counter(x for d, t in docs if trains(d) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d or -1, not trains(d), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for d, t in docs)
    out = lm.score(table(docs), *lm.fit(table(docs))).collect()
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)


def test_model_beats_base_on_held_out(table, rng):
    def text():
        k = rng.randrange(2)
        return " ".join(f"{'ab'[k]}{rng.randrange(40)}{'xo'[k]}" for _ in range(60))

    docs = table([(i, text()) for i in range(600)])
    out = [r for r in lm.score(docs, *lm.fit(docs)).collect() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.score(table([]), *lm.fit(table([]))).count() == 0


def test_classes_have_probability_one_and_updates_follow_the_gradient():
    tree = lm.Tree(np.array([5.0, 1.0, 3.0, 3.0, 9.0, 0.5]))
    weights = lm.Weights(tree, 3)
    a, s = np.arange(40, dtype=np.uint32) % 7, np.arange(40, dtype=np.uint32) % 5
    feats, leaf = lm.short(lm.features(a, s)), np.arange(40) % 6
    use = np.ones((3, 40), bool)
    start = weights.log_class(feats, use, leaf)
    share = np.array([5.0, 1.0, 3.0, 3.0, 9.0, 0.5]) / 21.5
    assert np.allclose(np.exp(start), share[leaf], rtol=1e-5)  # without weights: the counts
    for _ in range(5):
        weights.update(feats, use, leaf)
    assert weights.log_class(feats, use, leaf).sum() > start.sum()
    for t in range(7):
        every = np.exp(weights.log_class(np.repeat(feats[:, t : t + 1], 6, axis=1), use[:, :6], np.arange(6)))
        assert abs(every.sum() - 1) < 1e-6
    # the gradient of one token's loss by one weight, against a difference
    one, at = feats[:, :1], leaf[:1]
    _, side, slots, z = weights._logits(one, use[:, :1], at)
    slope, k = 1 / (1 + np.exp(-z[0])) - side[0], slots[0][1][0]
    loss = []
    for step in (1e-2, -1e-2):
        weights.w[0, k] += np.float32(step)
        loss.append(-weights.log_class(one, use[:, :1], at)[0])
        weights.w[0, k] -= np.float32(step)
    assert abs((loss[0] - loss[1]) / 2e-2 - slope * (slots[0][1] == k).sum()) < 1e-2


def test_paths_of_few_leaves():
    for n in (1, 2, 3):
        tree = lm.Tree(np.ones(n))
        steps, node, side = tree.paths(np.arange(n))
        assert len(node) == len(side) == steps.sum() == [0, 2, 5][n - 1]


def test_scores_do_not_depend_on_partitions_and_hot_words_are_dealt(table, rng, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 700)
    monkeypatch.setattr(lm, "HOT", 90)
    vocab = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(["the", "the", *vocab]) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(7, "the the w1"), (7, "the the w1"), (900, "the " * 300)]
    got = []
    for parts in (1, 5):
        df = table(docs).repartition(parts, "doc_id")
        got.append(sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lm.score(df, *lm.fit(df)).collect()))
    assert got[0] == got[1] and len(got[0]) == len(docs)
    words = pa.array(["\n", "the", "x"], pa.large_string())
    codes, off = np.array([1, 1, 1, 2, 0]), np.array([0, 5])
    of = lambda dk: lm.history(words, codes, off, np.array([False, True, False]), np.array([dk]), 1 << 30)[2]
    assert of(1)[2] != of(2)[2] and of(1)[0] != of(2)[0] and of(1)[4] == of(2)[4]  # hot pairs go by document, others do not


def test_model_beats_a_smoothed_bigram(spark):
    """Interpolated with the base, at the best of several weights."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    rows = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    count, pair = Counter(x for d, t in rows if trains(d) for x in t), Counter(p for d, t in rows if trains(d) for p in zip(["", *t], t))
    n, v = sum(count.values()), len(count)
    base = lambda x: (count[x] + 0.1) / (n + 0.1 * (v + 1))
    before = Counter()
    for (x, _), c in pair.items():
        before[x] += c
    held = [(x, y) for d, t in rows if not trains(d) for x, y in zip(["", *t], t)]
    plain = max(sum(math.log10((pair[p] + k * base(p[1])) / (before[p[0]] + k)) for p in held) for k in (1, 10, 100, 1000))
    out = [r for r in lm.score(docs, *lm.fit(docs)).collect() if r["held_out"]]
    assert sum(r["n_tokens"] for r in out) == len(held)
    assert sum(r["score"] for r in out) > plain > sum(r["base_score"] for r in out)


def test_rows_of_the_base_score_are_gone_before_tokens_are_dealt(table, rng, monkeypatch):
    made = {}
    written = lm.C.written

    def noted(df, tag):
        out = written(df, tag)
        made[tag] = out.quern_path.removeprefix("file:")
        return out

    monkeypatch.setattr(lm.C, "written", noted)
    docs = table([(i, " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for i in range(60)])
    out = lm.score(docs, *lm.fit(docs))
    assert os.path.isdir(made["lm-sums"]) and not os.path.exists(made["lm-rows"])
    assert out.count() == 60


def test_rows_of_sums_grow_with_the_documents_not_with_the_buckets(table, rng, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm, "TASKS", 4, raising=False)
    learn, folder = lm._learn, str(tmp_path)

    def noted(held):
        run = learn(held)

        def rows(batches):
            for batch in run(batches):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(batch.num_rows))
                yield batch

        return rows

    monkeypatch.setattr(lm, "_learn", noted)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(200)]
    made = {}
    for n in (40, 200):
        model, counts = lm.fit(table(docs[:n]))
        assert lm.score(table(docs[:n]), model, counts).count() == n and model.buckets >= n // 10
        made[n] = sum(int(f.read_text()) for f in tmp_path.iterdir())
        for f in tmp_path.iterdir():
            f.unlink()
    assert made[40] <= 4 * 40 and made[200] <= 4 * 200


def test_sums_of_more_documents_than_a_task_holds_leave_in_parts(monkeypatch):
    parts = [(np.arange(k, k + 40), np.full(40, 0.5 + k)) for k in (0, 20, 20, 60, 0)]
    want = Counter()
    for dk, lp in parts:
        want.update(dict(zip(dk.tolist(), lp.tolist())))
    for limit in (1 << 22, 50, 1):
        monkeypatch.setattr(lm, "SUMS", limit)
        sums = lm.Sums()
        out = [b for dk, lp in parts for b in sums.add(dk, lp)]
        assert len(out) == {1 << 22: 0, 50: 2, 1: 5}[limit] and sums.size <= limit
        got = Counter()
        for b in out + list(sums.rest()):
            for dk, lp in zip(*(c.to_pylist() for c in b.columns)):
                got[dk] += lp
        assert got == want and sums.size == 0


def dealt(rng, words, texts):
    """A model of some texts in one bucket and the blocks that its tokens are dealt in."""
    rows = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(texts)]
    count = Counter(x for t in rows for x in tokens(t))
    model = lm.Model(list(count.items()), sum(count.values()), len(count))
    at = model.classes(model.words)
    model.settle(np.bincount(at, model.count, model.classes_in_all), np.bincount(at, minlength=model.classes_in_all))
    held = SimpleNamespace(value=model)
    batch = pa.RecordBatch.from_arrays([pa.array(range(texts)), pa.array(range(texts)), pa.array(rows)], ["dk", "doc_id", "text"])
    return held, list(lm._deal(held)([batch])), sum(count.values())


def test_dealt_tokens_take_few_bytes_and_come_back(rng):
    words = [f"w{min(999, int(rng.expovariate(0.02)))}" for _ in range(4000)]
    _, blocks, n = dealt(rng, words, 400)
    assert sum(len(b.column(k)[0].as_py()) for b in blocks for k in (4, 5)) < 4 * n  # 32-bit marks of two words: above 5 bytes
    marks = np.frombuffer(rng.randbytes(400), "<u4")
    for far in (0, 0.2, 1):
        place = np.array([100 if rng.random() < far else rng.randrange(100) for _ in range(500)], np.uint32)
        want = np.where(place < 100, marks[np.minimum(place, 99)], np.arange(500)).astype(np.uint32)
        assert (lm._unpacked(lm._packed(place, want, 100), 500, marks) == want).all()


def test_equal_tokens_are_scored_once(rng, monkeypatch):
    held, blocks, n = dealt(rng, ["a", "b", "c"], 200)
    seen, log_class = [], lm.Weights.log_class

    def noted(self, feats, use, leaf):
        seen.append(len(leaf))
        return log_class(self, feats, use, leaf)

    monkeypatch.setattr(lm.Weights, "log_class", noted)
    out = list(lm._learn(held)(blocks))
    assert sum(b.num_rows for b in out) == 200 and sum(seen) <= 5 * 5 * 4 < n
