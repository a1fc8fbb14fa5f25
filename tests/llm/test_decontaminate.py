"""Operator 8 against the edit distance of every item to every text."""

from quern.llm import decontaminate as D


def plain_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance(rng):
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        assert D.best_distance(a, b) == plain_distance(a, b)


def test_recall_and_precision(spark, table, rng):
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(600)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 50)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    docs, planted = [], set()
    for d in range(200):
        w = rng.choices(vocab, k=rng.randint(0, 150))
        if d % 2:
            i, t = items[rng.randrange(40)]
            own = t.split()
            for _ in range(rng.choice([0, 0, 1, 2]) if len(own) > 15 else 0):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
            planted.add((d, i))
        docs.append((d, " ".join(w).capitalize()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1]), (502, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS place")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(table(docs), bench).collect()}
    truth = planted | {(None, 0), (502, 1)}
    assert len(got & truth) >= 0.98 * len(truth)
    for d, i in got - truth:
        text = next(t for k, t in docs if k == d).lower()
        assert plain_distance(dict(items)[i], text) <= 0.2 * len(dict(items)[i])


def test_filter_and_empty(spark, table):
    bench = spark.createDataFrame([(1, "some words that belong to the test set only")], "item_id long, text string")
    docs = table([(1, "x y some words that belong to the test set only z"), (2, "other words"), (3, None)])
    kept = D.filter_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert D.filter_contaminated(docs, bench.limit(0)).count() == 3
    assert D.contaminated(table([]), bench).count() == 0


def held(spark, table, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contaminated(table(docs), bench).collect()}


def test_edits_anywhere_against_brute_force(spark, table, rng):
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(600)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(6, 25)))) for i in range(30)]
    docs = []
    for d in range(150):
        own = list(items[d % 30][1])
        for _ in range(rng.randint(0, len(own) // 5)):  # up to the limit, at any place
            i, kind = rng.randrange(len(own)), rng.randrange(3)
            own[i : i + (kind > 0)] = "" if kind == 1 else rng.choice("abcdefghij")
        docs.append((d, " ".join([*rng.choices(vocab, k=5), "".join(own), *rng.choices(vocab, k=5)])))
    got = held(spark, table, items, docs)
    near = {(d, i): plain_distance(t, " ".join(x.split())) for d, x in docs for i, t in items if i == d % 30 or (d, i) in got}
    truth = {k: v for k, v in near.items() if v <= 0.2 * len(items[k[1]][1])}
    assert set(got) <= set(truth) and all(truth[k] == v for k, v in got.items())
    assert len(truth) >= 140 and len(got) >= 0.98 * len(truth)


def test_typos_in_opening_words_lost_openings_and_short_items(spark, table, rng):
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(80)]
    typos = [w[:3] + "z" + w[4:] if i in (2, 5, 8, 11) else w for i, w in enumerate(words[:20])]
    items = [(1, " ".join(words[:20])), (2, " ".join(words)), (3, "zebra crossing"), (4, "q")]
    docs = [(1, " ".join(typos)), (2, "x y " + " ".join(words[12:])), (3, "the Zebra\n crosing ahead"), (4, "a q"), (5, "nothing of it")]
    got = held(spark, table, items, docs)
    assert sorted(got) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    texts = {d: " ".join(x.lower().split()) for d, x in docs}
    assert all(plain_distance(dict(items)[i], texts[d]) == n for (d, i), n in got.items())


def test_other_columns_and_benchmark_in_parts(spark, table, rng, monkeypatch):
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 10])) for i in range(6)], "item_id long, text string")
    docs = table([(i, "x " + " ".join(words[10 * i : 10 * i + 10])) for i in range(5)] + [(9, "clean text of its own")]).selectExpr("*", "1 AS __dk", "2 AS __bad", "3 AS DK")
    monkeypatch.setattr(D, "PART_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()} == {(i, i) for i in range(5)}
    kept = D.filter_contaminated(docs, bench)
    assert kept.columns == docs.columns and [(r["doc_id"], r["__dk"], r["__bad"]) for r in kept.collect()] == [(9, 1, 2)]


def test_distances_end_where_no_item_can_be_held(rng, monkeypatch):
    """Unrelated stretches are not read to their end, and those that hold an item have its distance."""
    letters = "abcdefghijklmnopqrst"
    item = "".join(rng.choices(letters, k=200))
    held = list(item)
    for at in rng.sample(range(200), 30):
        held[at] = "z"
    text = lambda n: "".join(rng.choices(letters, k=n))
    items = D.Items([(0, item)], 0.2)
    steps, plain = [0], D.np.invert

    def invert(*x, **named):
        steps[0] += len(x[0])
        return plain(*x, **named)

    for row, whole in ((text(120) + item[:20] + text(400), False), (text(40) + "".join(held) + text(300), True)):
        c, start = D.characters(row + "\n"), D.np.array([0, len(row) + 1])
        place = D.np.array([120 if not whole else 40])
        steps[0] = 0
        monkeypatch.setattr(D.np, "invert", invert)
        d = items.distances(c, start, D.np.array([0]), D.np.array([0]), place)[0]
        monkeypatch.setattr(D.np, "invert", plain)
        assert d == D.best_distance(item, row[: int(place[0]) + 280]) if whole else d > 40
        if not whole:
            assert steps[0] < 0.9 * 2 * 4 * 320  # two inversions for each of 4 words and 320 characters
