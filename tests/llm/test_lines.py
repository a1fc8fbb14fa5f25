"""Operator 4 against all pairs of lines."""

from collections import defaultdict

from quern.llm import lines


def within(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    spots = [((-1 if d is None else d, i), x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= 16 and x.strip(" \t\r\f\v")]
    gone = defaultdict(set)
    for k, x in spots:
        if any(o < k and within(x, y) for o, y in spots):
            gone[k[0]].add(k[1])
    key = lambda d: -1 if d is None else d
    return {key(d): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[key(d)]) for d, t in docs}


def test_equals_brute_force(table, rng):
    def mutate(s):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, k = rng.randrange(len(s) + 1), rng.randrange(3)
            s = s[:i] + rng.choice("abéç漢") + s[i:] if k == 0 else s[:i] + s[i + 1 :] if k == 1 else s[:i] + rng.choice("abxyé") + s[i + 1 :]
        return s

    base = ["".join(rng.choices("abcdé fgh", k=rng.randint(14, 40))) for _ in range(30)]
    docs = [(d, "\n".join(mutate(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for d in range(110)]
    docs += [(200, ""), (201, None), (202, "short\nshort"), (203, "\n\n\n"), (204, " " * 30), (205, " " * 30), (None, docs[0][1]), (206, "long line of words " * 3000)]
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r["rest"] for r in lines._without(table(docs).select("doc_id", "text"), least_chars=16).collect()}
    assert got == brute(docs)


def test_filter_keeps_columns_and_counts(table):
    docs = table([(1, "the first line here\nown line of one doc"), (2, "the first line here"), (3, "the first line hers\nkept line of three"), (4, None), (5, "")])
    out = {r["doc_id"]: r for r in lines.filter_lines(docs).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[3]["text"] == "kept line of three" and out[3]["n_chars"] == 18
    assert lines.filter_lines(docs).columns == docs.columns
    assert lines.filter_lines(table([])).count() == 0


def test_short_lines_against_brute_force(table, rng, tmp_path, spark):
    docs = [(d, "\n".join("".join(rng.choices("abcé ", k=rng.randint(0, 18))) for _ in range(rng.randint(1, 5)))) for d in range(80)]
    docs += [(200, "short\nshort\nshore"), (201, "{"), (202, "}"), (203, "0123456789abcdef\n0123456789abcde"), (204, ""), (205, None)]
    spots = [((d, i), x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
    gone = {k for k, x in spots if any(o < k and within(x, y) for o, y in spots)}
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}
    table(docs).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["text"] for r in lines.op4_line_dedup(spark, str(tmp_path)).collect()} == want
    left = {r["doc_id"]: r["text"] for r in lines.filter_lines(table(docs)).collect()}
    assert left == {d: t for d, t in want.items() if t or (d, 0) not in gone}


def test_names_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "a line of words\nown", 7, 8, 9), (2, "a line of words", 7, 8, 9)], "doc_id long, text string, nos int, lines int, dk int")
    docs = docs.select("*", docs["text"].alias("rest"), docs["nos"].alias("__dk"), docs["nos"].alias("NOS"))
    out = lines.filter_lines(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [tuple(docs.first())]
