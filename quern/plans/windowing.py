"""Queries of the window plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..operators import windows as W
from .corpus import TOKENS, docs
from .registry import register

L, S, CHUNK, UPDATE = 1024, 64, 256, 32_768
TOTAL = "tt AS (SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS total FROM documents)"
NN = f"{TOTAL}, nn AS (SELECT (total - 1) // {L} * {L} AS n FROM tt)"
#: For each mode: end of the range of starts, filter, first scored place.
RULES = {
    "V1": ("n", "true", f"CASE WHEN ws = 0 THEN 0 ELSE greatest(wlen - {S}, 0) END"),
    "V2": (f"n - {L - S}", "true", f"CASE WHEN ws = 0 THEN 0 ELSE {L - S} END"),
    "V3": (f"n - {L}", "true", f"CASE WHEN ws = 0 THEN 0 ELSE greatest(wlen - {S}, 0) END"),
    "V4": (f"(n - {L}) // {S} * {S} + 1", "true", f"greatest(wlen - {S}, 0)"),
    "V5": (f"n - {L} + 1", "true", f"CASE WHEN ws = 0 THEN 0 ELSE greatest(wlen - {S}, 0) END"),
    "V6": (f"n + 1 - {L}", "true", f"greatest(wlen - {S}, 0)"),
    "V7": ("n", f"(wlen >= {S} OR ws = 0)", f"CASE WHEN ws = 0 THEN 0 ELSE greatest(wlen - {S}, 0) END"),
}


def total_tokens(spark: SparkSession, d: str) -> int:
    return docs(spark, d).agg(F.sum(T.token_count(F.coalesce("text", F.lit(""))))).first()[0] or 0


def win_sql(mode: str) -> str:
    stop, keep, tail = RULES[mode]
    return f"""{NN}, w0 AS (SELECT unnest(range(0, {stop}, {S})) AS ws, n FROM nn), w1 AS (SELECT ws, least(ws + {L}, n) - ws AS wlen, n FROM w0),
w AS (SELECT ws, wlen, CAST({tail} AS BIGINT) AS score_from, n FROM w1 WHERE {keep})"""


def sliding(spark: SparkSession, d: str, mode: str) -> tuple[DataFrame, int]:
    n = W.usable(total_tokens(spark, d), L)
    return W.sliding(spark, n, L, S, mode), n


@register("w5_sliding_windows", f"WITH {win_sql('V2')} SELECT ws, wlen, score_from FROM w")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return sliding(spark, d, "V2")[0]


def _coverage(mode: str) -> None:
    sql = f"""WITH {win_sql(mode)}, p AS (SELECT unnest(range(ws + score_from, ws + wlen)) AS pos FROM w), c AS (SELECT pos, count(*) AS times FROM p GROUP BY pos),
h AS (SELECT times, count(*) AS positions FROM c GROUP BY times), z AS (SELECT (SELECT n FROM nn) - CAST(coalesce(sum(positions), 0) AS BIGINT) AS positions FROM h)
SELECT times, positions FROM h UNION ALL SELECT 0, positions FROM z WHERE positions > 0"""

    @register(f"w5_coverage_{mode.lower()}", sql)
    def query(spark: SparkSession, d: str) -> DataFrame:
        return W.coverage(*sliding(spark, d, mode))


for _mode in W.MODES:
    _coverage(_mode)

ONE = """pl AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents),
sp AS (SELECT doc_id, "offset" AS start, n + CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) THEN 1 ELSE 0 END AS len FROM pl)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    return W.document_spans(T.document_offsets(docs(spark, d), 0))


@register("w3_document_spans", f"WITH {ONE} SELECT doc_id, start, len FROM sp")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d)


@register("w4_sequence_framing", f"WITH {NN} SELECT i AS seq, i * {L} AS x_start, (i + 1) * {L} AS x_end, i * {L} + 1 AS y_start, (i + 1) * {L} + 1 AS y_end FROM (SELECT unnest(range(0, n // {L})) AS i FROM nn)")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return W.frames(spark, total_tokens(spark, d), L)


@register("w6_document_chunks", f"""WITH {ONE}, q AS (SELECT doc_id, len - 1 AS pred, (len - 1 + {CHUNK - 1}) // {CHUNK} AS chunks FROM sp WHERE len > 1), c AS (SELECT *, unnest(range(0, chunks)) AS ci FROM q),
e AS (SELECT doc_id, ci, ci * {CHUNK} AS b, CASE WHEN ci = chunks - 1 THEN pred ELSE (ci + 1) * {CHUNK} END AS e FROM c)
SELECT doc_id, ci, greatest(0, e - {L}) AS win_start, e - greatest(0, e - {L}) AS win_len, b - greatest(0, e - {L}) AS chunk_offset, e - b AS chunk_len FROM e""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return W.document_chunks(spans(spark, d), CHUNK, L)


@register("w7_update_chunks", f"WITH {win_sql('V7')} SELECT least((ws + score_from) // {UPDATE}, (n + {UPDATE - 1}) // {UPDATE} - 1) AS ci, count(*) AS windows, min(ws) AS first_ws FROM w GROUP BY 1")
def w7(spark: SparkSession, d: str) -> DataFrame:
    w, n = sliding(spark, d, "V7")
    return W.update_chunks(w, n, UPDATE).groupBy("ci").agg(F.count("*").alias("windows"), F.min("ws").alias("first_ws"))


@register("w8_rank_slices", f"WITH {NN}, i AS (SELECT unnest(range(0, n // {L})) AS i, n // {L} AS t FROM nn) SELECT r AS rank, t * r // 8 AS lo, t * (r + 1) // 8 AS hi FROM (SELECT DISTINCT t FROM i), (SELECT unnest(range(0, 8)) AS r)")
def w8(spark: SparkSession, d: str) -> DataFrame:
    total = W.usable(total_tokens(spark, d), L) // L
    got = spark.range(total).groupBy(W.rank_of("id", total, 8).alias("rank")).agg(F.min("id").alias("lo"), (F.max("id") + 1).alias("hi"))
    return got.select("rank", "lo", "hi")


@register("w9_interleaved_ranks", f"WITH {win_sql('V2')} SELECT (ws // {S}) % 8 AS rank, count(*) AS windows, CAST(sum(ws) AS BIGINT) AS starts FROM w GROUP BY 1")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return sliding(spark, d, "V2")[0].groupBy(F.expr(f"(ws div {S}) % 8").alias("rank")).agg(F.count("*").alias("windows"), F.sum("ws").alias("starts"))


SPANS = "sx AS (SELECT step, rank, step * 8 * 4097 + rank * 4097 AS start, step * 8 * 4097 + rank * 4097 + 4097 AS \"end\" FROM (SELECT unnest(range(0, 200)) AS step), (SELECT unnest(range(0, 8)) AS rank))"


@register("w10_batch_spans", f"WITH {SPANS} SELECT * FROM sx")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return W.batch_spans(spark, 200, 8, 4096)


@register("w11_length_buckets", f"WITH {ONE} SELECT doc_id, (len - 2) // {CHUNK} AS bucket, row_number() OVER (PARTITION BY (len - 2) // {CHUNK} ORDER BY doc_id) AS place FROM sp")
def w11(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d).select("doc_id", F.expr(f"(len - 2) div {CHUNK}").alias("bucket"), F.lit(1).cast("long").alias("one"))
    return T.offsets(rows, size="one", group="bucket").select("doc_id", "bucket", (F.col("offset") + 1).alias("place"))


P9 = f"""WITH {TOKENS}, l AS (SELECT max(doc_id) AS last_doc FROM documents), st AS (SELECT CASE WHEN doc_id = last_doc THEN tokens ELSE list_append(tokens, 1) END AS tokens FROM tk, l),
x AS (SELECT unnest(tokens[:-2]) AS x, unnest(tokens[2:]) AS y FROM st) SELECT x, y, count(*) AS n FROM x GROUP BY x, y"""


@register("p9_shifted_pairs", P9)
def p9(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbours in the whole stream: a document's last token is followed by the next one's begin mark."""
    t = T.byte_tokens(docs(spark, d))
    last = docs(spark, d).agg(F.max("doc_id").alias("last_doc"))
    follow = F.concat(F.expr("slice(tokens, 2, size(tokens))"), F.when(F.col("doc_id") < F.col("last_doc"), F.array(F.lit(T.BOS))).otherwise(F.array().cast("array<int>")))
    pairs = t.join(F.broadcast(last)).select(F.explode(F.arrays_zip(F.col("tokens").alias("x"), follow.alias("y"))).alias("p"))
    return pairs.select("p.x", "p.y").where("y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("n"))


@register("j7_window_tokens", f"""WITH {win_sql('V2')}, {ONE} SELECT ws // {UPDATE} AS block, count(*) AS overlaps FROM w JOIN pl ON ws < pl."offset" + pl.n AND ws + wlen > pl."offset" GROUP BY 1""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Windows and the documents they touch: a range join, by equal cells of the window length."""
    w = sliding(spark, d, "V2")[0]
    pl = T.document_offsets(docs(spark, d), 0)
    a = w.withColumn("cell", F.explode(F.sequence(F.expr(f"ws div {L}"), F.expr(f"(ws + wlen - 1) div {L}"))))
    b = pl.select("doc_id", "offset", "n", F.explode(F.sequence(F.expr(f"offset div {L}"), F.expr(f"(offset + n - 1) div {L}"))).alias("cell"))
    first = F.greatest(F.expr(f"ws div {L}"), F.expr(f"offset div {L}"))  # a pair counts in its first common cell
    hits = a.join(b, "cell").where("ws < offset + n AND ws + wlen > offset").where(F.col("cell") == first)
    return hits.groupBy(F.expr(f"ws div {UPDATE}").alias("block")).agg(F.count("*").alias("overlaps"))


@register("r1_endless_stream", f"WITH {TOTAL}, {SPANS} SELECT step, rank, start // total + 1 AS epoch, start % total AS place FROM sx, tt")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return W.stream_places(W.batch_spans(spark, 200, 8, 4096), total_tokens(spark, d)).select("step", "rank", "epoch", "place")


@register("r2_epoch_wraps", f"WITH {TOTAL}, {SPANS} SELECT start // total + 1 AS epoch, count(*) AS spans, count(*) FILTER ((\"end\" - 1) // total <> start // total) AS wraps FROM sx, tt GROUP BY 1")
def r2(spark: SparkSession, d: str) -> DataFrame:
    total = total_tokens(spark, d)
    rows = W.stream_places(W.batch_spans(spark, 200, 8, 4096), total)
    return rows.groupBy("epoch").agg(F.count("*").alias("spans"), F.sum((F.expr(f"(end - 1) div {total}") + 1 != F.col("epoch")).cast("long")).alias("wraps"))


@register("r3_take_across_shards", f"WITH {TOTAL}, t AS (SELECT i AS take, i * 70001 AS lo, least((i + 1) * 70001, total) AS hi FROM (SELECT unnest(range(0, (total + 70000) // 70001)) AS i, total FROM tt)) SELECT take, lo // 100000 AS first_shard, (hi - 1) // 100000 AS last_shard, hi - lo AS n FROM t")
def r3(spark: SparkSession, d: str) -> DataFrame:
    total = total_tokens(spark, d)
    t = spark.range((total + 70000) // 70001).selectExpr("id AS take", "id * 70001 AS lo", f"least((id + 1) * 70001, {total}) AS hi")
    return t.selectExpr("take", "lo div 100000 AS first_shard", "(hi - 1) div 100000 AS last_shard", "hi - lo AS n")


@register("r4_micro_batches", "WITH s AS (SELECT n AS total, n // 1024 * 1024 AS usable FROM (VALUES (5000), (65536), (100000), (1024)) AS v(n)), c AS (SELECT total, usable, unnest(range(0, (usable + 8191) // 8192)) AS i FROM s) SELECT total, i, least(8192, usable - i * 8192) AS chunk FROM c")
def r4(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, i, c) for t in (5000, 65536, 100000, 1024) for i, c in enumerate(W.micro_batches(t, 1024, 9000))]
    return spark.createDataFrame(rows, "total int, i long, chunk long")


@register("r5_batch_rounding", "SELECT n, n // 1024 * 1024 AS usable, n // 1024 * 1024 + 1 AS taken, n // 1024 = 0 AS error FROM (VALUES (5000), (1024), (1000), (4097)) AS v(n)")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT n, n div 1024 * 1024 AS usable, n div 1024 * 1024 + 1 AS taken, n div 1024 = 0 AS error FROM VALUES (5000), (1024), (1000), (4097) AS v(n)")


R6 = f"""WITH {win_sql('V7')}, c AS (SELECT least((ws + score_from) // {UPDATE}, (n + {UPDATE - 1}) // {UPDATE} - 1) AS ci, min(ws + score_from) AS first_scored, any_value(n) AS n FROM w GROUP BY 1)
SELECT ci, first_scored, first_scored >= coalesce((SELECT max(least((b.ci + 1) * {UPDATE}, b.n)) FROM c b WHERE b.ci < a.ci), 0) AS ok FROM c a"""


@register("r6_score_before_update", R6)
def r6(spark: SparkSession, d: str) -> DataFrame:
    """A chunk is scored, then trained on: its first scored target lies behind all targets of the chunks before."""
    from pyspark.sql import Window

    w, n = sliding(spark, d, "V7")
    c = W.update_chunks(w, n, UPDATE).groupBy("ci").agg(F.min(F.col("ws") + F.col("score_from")).alias("first_scored"))
    trained = F.lag(F.least((F.col("ci") + 1) * UPDATE, F.lit(n))).over(Window.orderBy("ci"))  # a row for each chunk
    return c.select("ci", "first_scored", (F.col("first_scored") >= F.coalesce(trained, F.lit(0))).alias("ok"))


@register("t10_shuffled_sampler", f"WITH {NN} SELECT i // 97 AS shard_id, count(*) AS drawn, count(*) AS largest_draw FROM (SELECT unnest(range(0, n // {L})) AS i FROM nn) GROUP BY 1")
def t10(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the draw: each sequence of a shard once."""
    seqs = W.frames(spark, total_tokens(spark, d), L).select("seq", F.expr("seq div 97").alias("shard_id"))
    return W.shuffled_order(seqs, 1337).groupBy("shard_id").agg(F.count_distinct("seq").alias("drawn"), F.max("draw").alias("largest_draw"))


@register("t11_coprime_sampler", "SELECT i AS j, (17 + i * 619) % 1000 AS block FROM (SELECT unnest(range(0, 1000)) AS i)")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return W.coprime_order(spark, 1000, 17, W.coprime_stride(1000, 618))


@register("t1_file_sort", "SELECT printf('%06d', i) AS name, i AS place FROM (SELECT unnest(range(0, 300)) AS i)")
def t1(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = spark.range(300).select(F.format_string("%06d", "id").alias("name"), "id")
    return names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("place"))  # file names, not rows of data
