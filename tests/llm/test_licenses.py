"""Operator 5 against counting phrases word by word."""

import re

from quern.llm import licenses


def brute(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(table, rng):
    words = "mit license apache general public licenses License, the of MIT. été gnu".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "mit license " * 5000), (None, "MIT-License"), (503, "Apache\nLicense"), (503, "Apache\nLicense")]
    want = sorted(repr((d, *brute(t))) for d, t in docs)
    out = licenses.scan(table(docs)).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out) == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)


def test_notices_with_edits(table):
    text = "x y z " + licenses.NOTICES[7][1].replace("binary forms", "compiled binary forms") + " tail"
    got = {r["doc_id"]: r for r in licenses.scan(table([(1, text), (2, "all rights reserved"), (3, "redistribution and use of the in"), (4, "Licensed under CC BY-NC 4.0.")])).collect()}
    assert got[1]["labels"] == "bsd" and 0.85 <= got[1]["score"] < 1
    assert got[2]["labels"] == "proprietary" and got[3]["labels"] == "" and got[3]["score"] == 0 and got[4]["labels"] == "cc-by-nc"
    assert licenses.scan(table([])).count() == 0


def brute_labels(text):
    """Labels by a longest chain over all matches of the whole text, for each band of diagonals, and the score."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(filter(None, brute(text)[4].split(","))), float(brute(text)[1] > 0)
    for label, phrase in licenses.NOTICES:
        t = phrase.split()
        match = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
        best = 0
        for d in {i - j for i, j in match}:
            band = sorted(m for m in match if d <= m[0] - m[1] <= d + licenses.DRIFT)
            length = []
            for k, (i, j) in enumerate(band):
                length.append(1 + max((length[x] for x in range(k) if band[x][0] < i and band[x][1] < j), default=0))
            best = max([best, *length])
        if 100 * best >= 85 * (len(t) - 1):
            labels.add(label)
            score = max(score, best / (len(t) - 1))
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_equal_brute_force(table, rng):
    docs = [(1, "All rights reserved rights reserved " * 12), (2, "all rights all rights"), (3, None), (4, "reserved rights all"), (5, "x " * 500 + "all rights reserved"), (None, "Licensed under CC BY-SA 4.0")]
    filler = "the of and software license any this is word permission".split()
    for d in range(10, 110):
        own = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(licenses.NOTICES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k, at = rng.randrange(4), rng.randrange(len(w))
                w[at : at + (k != 0)] = [] if k == 1 else [rng.choice(filler)] if k < 3 else [w[at], w[at]]
            own += rng.choices(filler, k=rng.randint(0, 30)) + w
        docs.append((d, " ".join(own)))
    got = sorted((r["doc_id"] or -1, r["labels"], round(r["score"], 9)) for r in licenses.scan(table(docs)).collect())
    assert got == sorted((d or -1, *brute_labels(t)) for d, t in docs)
    assert ("proprietary", 1.0) == got[1][1:] and ("", 0.0) == got[2][1:]
