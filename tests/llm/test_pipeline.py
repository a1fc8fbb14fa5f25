"""The pipeline's stages in a row: on the smallest tables, on none, and against plain Python."""

import re
from collections import Counter

from quern.llm import decontaminate
from tests.conftest import DATA
from tests.llm import test_lines, test_minhash, test_quality
from tests.llm.test_bpe import known  # noqa: F401


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now, sizes = docs.columns, docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        if name != "byte_bpe":
            assert now.columns == columns
        now = spark.createDataFrame(now.collect(), now.schema)
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0] and sizes[-1] == sizes[-2]
    assert {r["text"] for r in now.collect()} and corpus_pipeline.run(spark, DATA).count() == sizes[-1]


def test_empty_documents(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert now.count() == 0
        now = spark.createDataFrame([], now.schema)


def good(t):
    n, chars, symbols, dup, _, failed = test_quality.brute(t)
    lines = [x for x in t.split("\n") if x.strip(" \t\r\f\v")]
    top = max(Counter(re.findall("[^\x20\x09-\x0d]+", t)).values(), default=0)
    return not (failed or 10 * symbols > 3 * n or 2 * chars < 3 * n or chars > 25 * n or 2 * dup > len(lines) or 10 * top > 6 * n)


def plain(rows, items):
    rows = [(d, t) for d, t in rows if good(t or "")]
    order = lambda d: -1 if d is None else d
    spots = [((order(d), t, i), x) for d, t in set(rows) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
    gone = {k for k, x in spots if any((o[0], o[2]) < (k[0], k[2]) and test_lines.within(x, y) for o, y in spots)}
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (order(d), t, i) not in gone), all((order(d), t, i) in gone for i in range(t.count("\n") + 1))) for d, t in rows]
    rows = list({(d, t) for d, t, empty in rows if not empty})
    group = test_minhash.brute(rows, 5, 80)
    rows = [(d, t) for d, t in rows if group[d][1] == d]
    normal = lambda t: " ".join(re.findall("[^\x20\x09-\x0d]+", t.lower()))
    return sorted((d, t) for d, t in rows if not any(i and decontaminate.best_distance(normal(i), normal(t)) <= int(0.2 * len(normal(i))) for i in items))


def test_run_against_plain_python(spark, rng, tmp_path, known):  # noqa: F811
    import corpus_pipeline

    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(900)]
    text = lambda n: "\n".join(" ".join(rng.choices(vocab, k=rng.randint(6, 14))) for _ in range(n))
    items = [" ".join(rng.choices(vocab, k=12)) for _ in range(4)] + ["", None]
    rows, bases = [], [text(rng.randint(2, 6)) for _ in range(12)]
    for d in range(70):
        w = list(rng.choice(bases)) if d % 3 == 0 else list(text(rng.randint(1, 6)))
        for _ in range(rng.choice([0, 1, 4])):
            w[rng.randrange(len(w))] = rng.choice("xyz ")
        rows.append((d, "".join(w)))
    rows += [(100 + k, text(2) + "\n" + items[k % 4].replace("a", "o", k) + "\n" + text(1)) for k in range(8)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "$ # $ #\n" * 9), (204, "é " * 12 + text(1)), (5, rows[5][1]), (205, rows[4][1]), (206, text(3) + "\nshared line of a few words"), (207, text(3) + "\nshared line of a few words")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_tokens"], list(r["token_ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain(rows, items)
    assert [g[:2] for g in got] == want and 30 < len(want) < 75
    for _, t, n, ids in got:
        assert ids == known.encode_ordinary(t) and n == len(ids)
