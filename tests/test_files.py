"""Queries that read files of installed packages."""

import sys

import pyarrow as pa
import pytest

from quern.plans import files


def test_missing_tokenizers_are_an_error(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    with pytest.raises(ImportError):
        files.p2(spark, "/root/testdata/sf0.001")


def test_pieces_are_made_of_few_texts_at_once(spark, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    texts = [None, "", "é" * 3] + ["some words of a text " * 100] * 1500 + ["x" * 1_500_000, "end"]
    steps, sizes = [], []

    class Docs:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            steps.append(lambda b: [x.itertuples(index=False) for x in run(iter([b.to_pandas()]))])

        def mapInArrow(self, run, schema):
            steps.append(lambda b: [(tuple(r.values()) for r in x.to_pylist()) for x in run(iter([b]))])

    class Pieces(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **more):
            sizes.append(sum(map(len, texts)))
            return super().encode(texts, **more)

    monkeypatch.setattr(files, "docs", lambda spark, d: Docs())
    files.p2(spark, "")
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Pieces)
    got = [tuple(r) for part in steps[0](pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})) for r in part]
    assert [r[0] for r in got] == list(range(len(texts))) and [r[1] for r in got[:2]] == [0, 0]
    assert len({r[1:] for r in got[3:1503]}) == 1 and got[3][1] > 400
    assert max(sizes) == 1_500_000 and sorted(sizes)[-2] <= 1 << 20


def test_readers_of_text_formats(spark, tmp_path):
    from quern.sources import files

    (tmp_path / "docs.jsonl").write_text('{"text": "a\\nb", "id": 3}\n{"text": ""}\n')
    assert [r["text"] for r in files.jsonl_documents(spark, str(tmp_path / "docs.jsonl")).collect()] == ["a\nb", ""]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{"other": 1}\n')
    with pytest.raises(Exception, match="without text"):
        files.jsonl_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "side.json").write_text('{\n "num_docs": 7,\n "docs_sha256": "ff"\n}')
    assert tuple(files.sidecar(spark, str(tmp_path / "side.json")).first()) == (7, None, "ff", None)
    (tmp_path / "own.vocab").write_text("<unk>\t0\n\u2581the\t-1.5\n")
    assert [tuple(r) for r in files.vocabulary(spark, str(tmp_path / "own.vocab")).collect()] == [(0, "<unk>", 0.0), (1, "\u2581the", -1.5)]
    (tmp_path / "results.tsv").write_text("val_bpb\tartifact_bytes\tmemory_mb\tnotes\n1.25\t100\t7\tfirst run\n")
    assert tuple(files.results(spark, str(tmp_path / "results.tsv")).first()) == (1.25, 100, 7, "first run")
    (tmp_path / "subs").mkdir()
    for k in range(2):
        (tmp_path / "subs" / f"{k}.json").write_text('{\n "val_bpb": %d\n}' % k)
    got = files.submissions(spark, str(tmp_path / "subs")).selectExpr("get_json_object(json, '$.val_bpb') AS v").collect()
    assert sorted(r["v"] for r in got) == ["0", "1"]


def test_manifest_errors(spark, tmp_path):
    from quern.sources import manifest as M

    path = str(tmp_path / "m")
    stats = "named_struct('files_val', 1L, 'files_train', 2L)"
    M.write_json(spark.sql(f"SELECT array(named_struct('name', 't', 'vocab_size', 9L, 'path', 'p')) AS tokenizers, array(named_struct('name', 'd', 'tokenizer_name', 't', 'stats', {stats}), named_struct('name', 'e', 'tokenizer_name', 'x', 'stats', {stats})) AS datasets"), path)
    m = M.read_manifest(spark, path)
    assert tuple(M.tokenizer_of(m, "d").first()) == ("t", 9, "p")
    assert sorted(map(tuple, M.shard_prefix(m, "d", 2).collect())) == [("train", 0), ("train", 1), ("val", 0)]
    for broken in (lambda: M.dataset(m, "none"), lambda: M.tokenizer_of(m, "e"), lambda: M.shard_prefix(m, "d", 3)):
        with pytest.raises(Exception, match="no dataset|no such tokenizer|fewer than"):
            broken().collect()
