"""Operator 1 against a count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import suffixes

W = 20


def brute(docs):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + W] for i in range(len(b) - W + 1))
    out = Counter()
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [4096, 2])  # the streamed and the shuffled way
def test_equals_brute_force(table, rng, group):
    base = ["".join(rng.choices("abcdé", k=rng.randint(10, 60))) for _ in range(12)]
    docs = []
    for d in range(100):
        t = "".join(rng.choice([rng.choice(base), "".join(rng.choices("abcdefgh", k=rng.randint(3, 40)))]) for _ in range(rng.randint(0, 5)))
        if t and rng.random() < 0.3:
            i = rng.randrange(len(t))
            t = t[:i] + "Z" + t[i + 1 :]
        docs.append((d, t))
    docs += [(200, ""), (201, None), (202, "a" * 100), (203, "ab" * 60), (None, docs[3][1]), (3, docs[3][1]), (204, "q" * 19), (205, "q" * 20), (206, "q" * 20), (207, "xyz" * 20000)]
    got = Counter(tuple(r[:5]) for r in suffixes.remove_repeats(table(docs), W, 6, group).collect())
    assert got == brute(docs)


def test_empty_table(table):
    assert suffixes.remove_repeats(table([])).count() == 0


def test_long_texts_in_pieces(rng, monkeypatch):
    data, off = np.frombuffer("".join(rng.choices("abcd", k=900)).encode(), np.uint8), np.array([0, 900])

    def windows():
        out = {}
        for _, g, _, lo, near, more in suffixes._pieces(data, off, W, 6):
            for anchor, first, at, n in zip(g.tolist(), lo.tolist(), near.tolist(), more.tolist()):
                for i in range(n + 1):
                    assert first + i not in out
                    out[first + i] = (anchor, first + at)
        return out

    whole = windows()
    assert sorted(whole) == list(range(900 - W + 1))
    monkeypatch.setattr(suffixes, "PIECE", 64)
    parts = windows()  # the same anchor strings; of equal ones, any
    assert sorted(parts) == sorted(whole) and all(parts[i][0] == whole[i][0] for i in whole)


def test_production_window_against_brute_force(table, rng, monkeypatch):
    monkeypatch.setattr("tests.llm.test_suffixes.W", suffixes.WINDOW)
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(150, 450))) for _ in range(8)]
    docs = [(d, "".join(rng.choice([rng.choice(base), "".join(rng.choices("ijklm", k=rng.randint(1, 300)))]) for _ in range(rng.randint(0, 5)))) for d in range(60)]
    docs += [(90, "x" * 199), (91, "x" * 200), (92, "x" * 201), (93, "y" * 500), (94, base[0]), (94, base[0])]
    got = Counter(tuple(r[:5]) for r in suffixes.remove_repeats(table(docs)).collect())
    assert got == brute(docs)
