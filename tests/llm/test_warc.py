"""Operator 6: what is written is read back, and the history is in order."""

import hashlib

from quern.llm import warc


def test_archive_round_trip(spark, rng):
    bodies = ["<p>" + "x" * 1200, "<p>" + "é" * 600, "short", "", None, "a\r\n\r\nWARC/1.1\r\n" + "y" * 1000]
    pages = [(i, f"http://h{i % 3}.example.com/p{i % 4}#{i}", bodies[i % 6]) for i in range(60)] + [(61, None, "<p>" + "x" * 1200), (62, "http://bad[/x", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS range")
    out = warc.merge_index(warc.C.written(_captures(df), "c"), 3).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i, last.get(h or "", -1))
    assert len(out) == len(pages)
    for r in out:
        h = next(h for i, _, h in pages if i == r["page_id"]) or ""
        raw = h.encode()
        again = len(raw) >= 1000 and last[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[h]) if again else ("response", None))
    keys = [(r["range"], r["urlkey"], r["ts"], r["page_id"]) for r in out]
    by_range = sorted(keys)
    assert [k[1:] for k in by_range] == sorted(k[1:] for k in keys)  # ranges in order hold the order of all


def _captures(df):
    import uuid

    path = f"{warc.C.scratch_dir(df.sparkSession)}/w-{uuid.uuid4().hex}"
    warc.write_archives(df, path)
    return warc.read_archives(df.sparkSession, path)


def test_loser_tree_merges(rng):
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
