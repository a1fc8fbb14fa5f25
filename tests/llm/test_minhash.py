"""Operator 2 against all pairs."""

import re

from quern.llm import minhash


def sets(docs, k):
    out = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(docs, k, percent):
    s = sets(docs, k)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in s if s[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def corpus(rng, groups=12, size=14):
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(table, rng):
    docs = corpus(rng) + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "one two"), (905, " \n\t ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(docs), 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_one_large_group_of_near_copies(table, rng):
    base = [f"v{i}" for i in range(150)]
    docs = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6])):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(docs), 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_repeated_and_null_ids(table):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (None, "a b c d e f"), (None, "only here without id")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(table(docs), 3, 85).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (-1, 1, False), (-1, -1, True)])


def test_keep_one_and_empty_table(table):
    docs = table([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m")])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert minhash.near_duplicates(table([]), 3, 85).count() == 0


def test_threshold_of_matches():
    assert minhash.least_matches(85) == 20 and minhash.least_matches(80) == 17


def test_keep_one_with_repeated_rows_null_ids_and_odd_names(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text + " "), (None, text), (3, "alone in the world it is"), (None, "no id and no twin here at all"), (None, "no id and no twin here at all"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS dk", "2 AS label", "3 AS __dropped_id", "4 AS DK", "5 AS c0")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r[0] or -1, r[1] or "") for r in kept.collect())
    assert got == [(-1, "no id and no twin here at all"), (1, text), (3, "alone in the world it is"), (4, ""), (4, ""), (5, "")]


def test_hubs_and_regrouping_lose_no_link(table, rng, monkeypatch):
    """With no pairs allowed before the last step, all goes by differences from hubs; sizes differ too."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "LEVELS", 3)
    docs = [t for _, t in corpus(rng, groups=5, size=20)]
    base = [f"v{i}" for i in range(120)]
    for _ in range(70):
        w = list(base[: rng.randint(95, 120)])
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(4)}"
        docs.append(" ".join(w + [f"own{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 3, 9]))]))
    docs = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(docs), 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_groups_of_unlinked_texts_are_not_regrouped_many_times(table, rng, monkeypatch):
    made = []
    written = minhash.C.written

    def counted(df, tag):
        out = written(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(minhash.C, "written", counted)
    docs = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(160)]
        for _ in range(24):
            w = list(base)
            for at in rng.sample(range(160), 9):
                w[at] = f"x{rng.randrange(2)}"
            docs.append(" ".join(w))
    docs = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(docs), 3, 85).collect()}
    assert got == brute(docs, 3, 85)
    assert sum(n for tag, n in made if tag == "items") <= 16 * len(docs)


def test_many_copies_with_edits_in_common_are_not_regrouped(table, rng, monkeypatch):
    """All shingles are shared, few texts are linked, and each has another difference from every hub."""
    made = []
    written = minhash.C.written

    def counted(df, tag):
        out = written(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(minhash.C, "written", counted)
    monkeypatch.setattr(minhash, "FEW", 4)
    base = [f"v{i}" for i in range(150)]
    docs = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(w) - 1)
            if rng.random() < 0.6:
                del w[at]
            else:
                w[at], w[at + 1] = w[at + 1], w[at]
        docs.append(" ".join(w))
    docs = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(docs), 5, 80).collect()}
    assert got == brute(docs, 5, 80)
    assert any(tag == "bands" for tag, _ in made)
    assert sum(n for tag, n in made if tag == "items") <= 16 * len(docs)


def test_bands_miss_a_link_at_the_bound_with_small_probability():
    for percent in (80, 85):
        miss = (1 - (percent / 100) ** minhash.ROWS) ** minhash.band_count(percent)
        assert miss < minhash.MISS_BANDS <= 1e-9
