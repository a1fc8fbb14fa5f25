"""Hand-made cases of the operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import tokens as T
from quern.operators import windows as W
from quern.sources.tokshard import encode_shard, read_shards, shard_tokens, write_shards


def test_packing_straddles_shards(spark):
    docs = spark.createDataFrame([(0, ""), (1, "a" * 9), (2, "b" * 10), (3, "c" * 25)], "doc_id long, text string")
    for num_val in (0, 1):
        parts = T.pack(T.document_offsets(docs, num_val), 10)
        sizes = {(r["split"], r["shard_id"]): r["tokens"] for r in T.shard_stats(parts).collect()}
        assert sum(sizes.values()) == 9 + 10 + 25 + 4
        train = [v for (s, k), v in sorted(sizes.items()) if s == "train"]
        assert all(v == 10 for v in train[:-1]) and 0 < train[-1] <= 10


def test_prefix_sum_in_buckets(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "'train' AS split", "id % 7 AS n")
    got = {r["doc_id"]: r["offset"] for r in T.offsets(rows, bucket=64).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_trainer_text_drops_blank(spark):
    docs = spark.createDataFrame([(0, ""), (1, "   "), (2, "a\0b"), (3, " "), (4, " \U0001f600 ")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in T.trainer_text(docs).collect()} == {2: "a b", 4: "\U0001f600"}
    assert {r["doc_id"] for r in T.trainer_text(docs, max_docs=3).collect()} == {2}


def test_byte_tokens_of_null_and_empty(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "é")], "doc_id long, text string")
    assert {r[0]: r[1] for r in T.byte_tokens(docs).collect()} == {0: [1], 1: [1], 2: [1, 0xC3 + 4, 0xA9 + 4]}


@pytest.mark.parametrize("bos", [True, False])
def test_byte_tokens_of_few_texts_at_once(bos):
    texts = [None, "", "é"] + ["a" * 3000, "bc" * 700] * 1000 + ["x" * 1_500_000, "", "end"]
    steps = []

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            steps.append(run)

    T.byte_tokens(Docs(), bos)
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(-1, len(texts))), "text": ["before"] + texts}).slice(1)
    out = list(steps[0](iter([whole.slice(0, 0), whole])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    for b in out:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            assert t.values.to_numpy().tolist() == [T.BOS] * bos + [x + 4 for x in (texts[i] or "").encode()]
    sizes = sorted(len(b.column(1).flatten()) for b in out)
    assert sizes[-1] == 1_500_000 + bos and sizes[-2] <= (1 << 20) + 2003


def test_byte_tokens_of_a_long_text_take_little_more_than_the_tokens():
    steps = []

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            steps.append(run)

    T.byte_tokens(Docs())
    n = 20_000_000
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2, 3], "text": ["", "ab" * (n // 2), None, "é"]})
    tracemalloc.start()
    try:
        out = list(steps[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [i for b in out for i in b.column(0).to_pylist()] == [0, 1, 2, 3]
    tokens = [t.values.to_numpy() for b in out for t in b.column(1)]
    assert [len(t) for t in tokens] == [1, n + 1, 1, 3] and all(t[0] == T.BOS for t in tokens)
    assert (tokens[1][1::2] == 97 + 4).all() and (tokens[1][2::2] == 98 + 4).all() and tokens[3].tolist() == [T.BOS, 0xC3 + 4, 0xA9 + 4]
    assert peak < 6 * n  # the tokens are 4 n; 8 n when they were copied to put in the marks


@pytest.mark.parametrize("n,length,stride", [(10, 4, 2), (16, 4, 2), (4096, 1024, 64)])
def test_window_modes_differ(spark, n, length, stride):
    times = {m: {r["times"]: r["positions"] for r in W.coverage(W.sliding(spark, n, length, stride, m), n).collect()} for m in W.MODES}
    assert times["V2"] == {1: n}
    assert times["V1"] == {1: n - stride, length // stride: stride}
    assert times["V3"] == {1: n - stride, 0: stride}
    assert times["V4"].get(0) == length - stride and times["V6"].get(0) == length - stride
    assert times["V5"] == {1: n}


def test_rank_slices_partition(spark):
    for total in (1, 7, 59):
        got = {r["id"]: r["rank"] for r in spark.range(total).withColumn("rank", W.rank_of("id", total, 8)).collect()}
        for r in range(8):
            assert [i for i in sorted(got) if got[i] == r] == list(range(total * r // 8, total * (r + 1) // 8))


def test_coprime_order_visits_all(spark):
    stride = W.coprime_stride(360, 100)
    assert sorted(r["block"] for r in W.coprime_order(spark, 360, 5, stride).collect()) == list(range(360))


def test_micro_batches():
    assert W.micro_batches(5000, 1024, 2048) == [2048, 2048]
    assert W.micro_batches(7000, 1024, 2500) == [2048, 2048, 2048]
    with pytest.raises(ValueError):
        W.micro_batches(10, 1024, 4096)


def test_shard_format(spark, tmp_path):
    data = encode_shard(np.array([0, 65535, 7]))
    assert shard_tokens(data).tolist() == [0, 65535, 7] and shard_tokens(data, header_only=True) == 3
    for broken in (data[:-1], b"\0" * len(data), data + b"x"):
        with pytest.raises(ValueError):
            shard_tokens(broken)
    with pytest.raises(ValueError):
        encode_shard(np.array([65536]))
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("train", 0, [1, 2]), ("train", 1, [3])], "split string, shard_id int, tokens array<int>")
    write_shards(first, path)
    write_shards(first.where("shard_id = 0"), path)  # the second export leaves no stale shard
    assert [(r["n"], r["tokens"]) for r in read_shards(spark, path).collect()] == [(2, [1, 2])]


def test_shards_of_byte_pieces(spark, tmp_path):
    texts = {0: None, 1: "", 2: "é" * 11, 3: "ab", 4: "\u20ac" * 30, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    parts = T.pack(T.document_offsets(docs, 2), 7).join(docs, "doc_id")
    pieces = T.byte_pieces(parts)
    assert pieces.schema["tokens"].dataType.simpleString() == "binary"
    path = str(tmp_path / "out")
    write_shards(pieces, path, order="doc_id")
    want = {"val": [1, 1], "train": [t for i in range(2, 6) for t in [1] + [x + 4 for x in texts[i].encode()]]}
    got = {r["path"].split("/")[-1]: r["tokens"] for r in read_shards(spark, path).collect()}
    assert got == {f"{s}_{k // 7:06d}.bin": t[k : k + 7] for s, t in want.items() for k in range(0, len(t), 7)}
    odd = spark.createDataFrame([("train", 0, b"abc")], "split string, shard_id int, tokens binary")
    with pytest.raises(Exception, match="odd length"):
        write_shards(odd, str(tmp_path / "odd"))


def test_plans_push_down(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = T.document_offsets(docs.where("doc_id < 10"), 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_nearest_plane_against_plain_recursion():
    from quern.operators.quant import Plane

    r = np.random.default_rng(5)
    x, w = r.standard_normal((40, 6)) * [3, 1, 0.2, 1, 0, 2], r.standard_normal((9, 6))
    g, s = x.T @ x, np.full(9, 0.3)
    plane = Plane(g)
    got = plane.codes(w, s, 4)
    diag = np.where(np.diag(g) == 0, 1.0, np.diag(g))
    full = g + np.diag(diag - np.diag(g)) + 0.01 * diag.mean() * np.eye(6)
    for row, q in zip(w, got):
        left, done = list(np.argsort(-diag, kind="stable")), []
        while left:  # the heaviest first; the others then take their best real values
            k = left.pop(0)
            if left:  # what the coordinates still free can make good does not count
                rest = np.linalg.inv(full[np.ix_(left, left)])
                eff = full - full[:, left] @ rest @ full[left, :]
            else:
                eff = full
            aim = row[k] + sum(eff[k, j] / eff[k, k] * (row[j] - 0.3 * q[j]) for j in done)
            assert q[k] == np.clip(np.rint(aim / 0.3), -4, 4)
            done.append(k)
    err = lambda q: np.einsum("ri,ij,rj->", w - 0.3 * q, g, w - 0.3 * q)
    assert err(got) <= err(np.clip(np.rint(w / 0.3), -4, 4))


def test_exact_quantile_narrows_down(spark):
    from pyspark.sql import functions as F

    from quern.operators.quant import exact_quantile

    r = np.random.default_rng(3)
    rows = [(k, float(x)) for k, vs in ((1, r.standard_normal(4000)), (2, r.integers(0, 3, 3000)), (3, [7.0]), (4, r.exponential(size=2500) ** 4)) for x in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.0, 0.03, 0.5, 0.999, 1.0):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, "g", F.col("v"), q, most=50).collect()}
        for g in (1, 2, 3, 4):
            assert abs(got[g] - np.quantile([v for k, v in rows if k == g], q)) < 1e-9


def test_pruning_ranks_rows_not_codes(spark, tmp_path):
    from quern.plans import quantization

    r = np.random.default_rng(8)
    x = (r.choice([0, 1, -1, 5, 127], (400, 12)) * r.uniform(0.01, 0.1, (400, 1))).astype(np.float32)
    x[::3] = x[0]  # equal scales
    x[1::9] = 0  # no unit codes
    rows = [(int(i), v.tolist(), int(i % 2) if i % 50 else None) for i, v in zip(r.permutation(400), x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    units = {}
    for i, v, label in rows:
        v = np.array(v, np.float32).astype(float) * 40
        clip = np.quantile(np.abs(v), 0.9999984)
        scale = max(clip / 127, 1 / 127)
        q = np.rint(np.clip(v, -clip, clip) / scale)
        units.setdefault(label, []).extend((scale * scale, i, k) for k in np.flatnonzero(np.abs(q) == 1))
    want = {}
    for cells in units.values():
        for _, i, _ in sorted(cells)[:100]:
            want[i] = want.get(i, 0) + 1
    got = quantization.t4(spark, str(tmp_path))
    assert {w["vec_id"]: w["pruned"] for w in got.collect()} == want and min(map(len, units.values())) < 100 < max(map(len, units.values()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_clip_is_taken_once_a_row(spark):
    from pyspark.sql import functions as F

    from quern.operators.quant import int8_rows

    x = np.random.default_rng(4).standard_normal((6, 300))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    plan = int8_rows(df).select("i", F.explode("q").alias("q")).where("abs(q) = 1")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and all(line.count("sort") <= 4 for line in filters)  # twice for each of two conditions: in the clipped values and in the scale
