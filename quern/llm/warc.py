"""WARC archives, revisit records and a globally ordered capture index (operator 6).

Writing: each page becomes one WARC/1.1 record.  Of pages with equal payloads of
at least MIN_REVISIT bytes, that with the largest page_id is a response and the others are
revisits of it.  Spark's text writer makes the files (a record's closing CRLF
CRLF is its line separator), so archives can lie in any store that Spark writes.

Reading: archives are read whole as binary files and parsed record by record by
their Content-Length; payload digests are computed anew and compared.

Index: the captures of each archive are sorted by URL key and timestamp, a run.
An external merge brings the runs together: range boundaries from a sample cut
all runs alike, into ranges of RANGE_ROWS captures on average, and a task merges
one range after the other by a k-way loser tree, with no more than that range in
memory.  The ranges in order, each in order, are the capture history.  A page's place among
the captures of one second is its page_id, so even one hot URL is cut into
ranges.

Defined cases: a null html is an empty payload; a null url has the key ''; page
ids should be set and distinct: repeated rows give a record each, of which the
revisits refer to the same id; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_REVISIT = 1000
#: Records in one archive file, bytes of html in one task.
FILE_RECORDS = 2000
#: Capture times: page_id seconds after this.
EPOCH = "2024-01-01T00:00:00Z"
#: Captures of a range on average; sampled captures for each range.
RANGE_ROWS, SAMPLE = 50_000, 50
CRLF = "\r\n"


def decide(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, payload_bytes, record_type, refers_to``."""
    rows = C.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("payload_bytes") >= MIN_REVISIT)
    heads = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
    out = rows.join(heads, ["digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("head"), F.lit(False))
    return out.select("page_id", "url", "html", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to"))


def _record() -> F.Column:
    """The text of one record without its closing CRLF CRLF."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("html"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH[:19]), "yyyy-MM-dd'T'HH:mm:ss") + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [
        (True, "WARC-Type", F.col("record_type")),
        (True, "WARC-Record-ID", F.format_string("<urn:page:%s>", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        (True, "WARC-Date", when),
        (True, "WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        (True, "WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        (F.col("record_type") == "revisit", "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        (F.col("record_type") == "revisit", "WARC-Refers-To", F.format_string("<urn:page:%s>", F.col("refers_to").cast("string"))),
        (F.col("record_type") == "revisit", "X-Payload-Length", F.col("payload_bytes").cast("string")),
        (True, "Content-Type", F.lit("application/http; msgtype=response")),
        (True, "Content-Length", (F.octet_length(body) + F.octet_length(http)).cast("string")),
    ]
    parts = [F.lit(f"WARC/1.1{CRLF}")]
    for use, name, value in head:
        line = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        parts.append(line if use is True else F.when(use, line).otherwise(""))
    return F.concat(*parts, F.lit(CRLF), http, body)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write gzip-compressed archives of at most FILE_RECORDS records each."""
    decide(pages).select(_record().alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, memoryview]]:
    """Headers, offset and block of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, at, view[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def url_key(url: str) -> str:
    """A sort-friendly key: host labels reversed, then port, path and query; no scheme, no fragment."""
    try:
        x = urlsplit(url)
        host = ",".join(reversed((x.hostname or "").removeprefix("www.").split(".")))
        port = f":{x.port}" if x.port else ""
    except ValueError:
        return url
    return f"{host}{port}){(x.path or '/').lower()}{'?' + x.query if x.query else ''}"


CAPTURE = "urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_offset long"


def _page(text: str | None) -> int | None:
    body = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives; those of one archive are sorted, a run (``file``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for k in range(batch.num_rows):
                name, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                rows = []
                for head, at, block in records(gzip.decompress(raw)):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "revisit":
                        size = int(head["X-Payload-Length"])
                    else:
                        start = bytes(block[:4096]).index(b"\r\n\r\n") + 4
                        size = len(block) - start
                        if hashlib.sha1(block[start:]).hexdigest() != digest:
                            raise ValueError(f"{name}: payload at {at} does not have its digest")
                    rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), name, at))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[8]))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows[i : i + 10_000]], SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURE.split(", ")])


class LoserTree:
    """K-way merge of sorted runs; each step replays one path of the tournament."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k  # losers; place 0 holds the winner
        winner = [0] * (2 * self.k)
        for i in range(self.k):
            winner[self.k + i] = i
        for i in range(self.k - 1, 0, -1):
            a, b = winner[2 * i], winner[2 * i + 1]
            w, lost = (a, b) if self._before(a, b) else (b, a)
            winner[i], self.tree[i] = w, lost
        self.tree[0] = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        while True:
            w = self.tree[0]
            if self.head[w] is None:
                return
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            i = (w + self.k) // 2
            while i:
                if self._before(self.tree[i], w):
                    self.tree[i], w = w, self.tree[i]
                i //= 2
            self.tree[0] = w


def merge_index(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order of (urlkey, ts, page_id), with their ``range``."""
    spark = captures.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = captures.count()
    n = ranges or max(tasks, -(-count // RANGE_ROWS))
    order = [F.col("urlkey"), F.col("ts"), F.coalesce("page_id", F.lit(-1))]
    sample = captures.select(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.xxhash64("page_id", "file", "record_offset").alias("h"))
    picked = sorted(tuple(r)[:3] for r in sample.where(F.pmod("h", F.lit(max(1, count // (SAMPLE * n)))) == 0).collect())
    cuts = [picked[len(picked) * i // n] for i in range(1, n)] if len(picked) >= n else picked
    cuts = sorted(set(cuts))
    held = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (-1 if p is None else p for p in batch.column(2).to_pylist()))
            at = [bisect.bisect_right(held.value, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *NAMES])

    fields = SCHEMA.insert(0, pa.field("range", pa.int32()))
    key = lambda row: (row[1], row[2], -1 if row[3] is None else row[3], row[8], row[9])

    def merged(runs: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        tree = iter(LoserTree([((key(row), row) for row in rows) for rows in runs]))
        while out := [row for _, row in islice(tree, 10_000)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        last = None
        for batch in batches:  # sorted by range and run, and each run in its order
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if runs and row[0] != last[0]:
                    yield from merged(runs)
                    runs = []
                if not runs or row[8] != last[8]:
                    runs.append([])
                runs[-1].append(row)
                last = row
        if runs:
            yield from merged(runs)

    placed = captures.mapInArrow(place, "range int, " + CAPTURE)
    return placed.repartition(min(n, tasks), "range").sortWithinPartitions("range", "file", "urlkey", "ts", "page_id", "record_offset").mapInArrow(merge, "range int, " + CAPTURE)


def archive(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    path = f"{C.scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merge_index(C.written(read_archives(spark, path), "captures"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS g FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY g) AS head FROM d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, g AS payload_digest,
  CASE WHEN b >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id < head THEN head END AS refers_to
FROM m
"""
