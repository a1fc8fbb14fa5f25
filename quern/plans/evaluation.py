"""Queries of the evaluation plane. Losses here are a formula of the token ids: synthetic, no model's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import tokens as T
from .corpus import TOKENS, docs
from .registry import register

# vocabulary of the words of part names: 4 specials, 256 byte pieces, words with a space mark
VOCAB_SQL = """vo AS (SELECT i AS token_id, ['<pad>', '<s>', '</s>', '<unk>'][CAST(i AS INTEGER) + 1] AS piece FROM (SELECT unnest(range(0, 4)) AS i)
  UNION ALL SELECT i + 4, '<0x' || printf('%02X', i) || '>' FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT 259 + row_number() OVER (ORDER BY w), '▁' || w FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)),
lu AS (SELECT token_id, CAST(CASE WHEN token_id < 4 THEN 0 WHEN regexp_matches(piece, '^<0x[0-9A-F]{2}>$') THEN 1 ELSE octet_length(encode(regexp_replace(piece, '^▁', ''))) END AS BIGINT) AS base_bytes,
  token_id >= 260 AS has_leading_space, token_id < 4 AS is_boundary FROM vo)"""
PAIRS_SQL = f"""{VOCAB_SQL}, wd AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
id AS (SELECT p_partkey, i, token_id AS tgt FROM wd JOIN vo ON piece = '▁' || w), pr AS (SELECT p_partkey, i, tgt, coalesce(lag(tgt) OVER (PARTITION BY p_partkey ORDER BY i), 1) AS prev FROM id),
sc AS (SELECT p_partkey, i, pr.tgt, pr.prev, a.base_bytes + CASE WHEN a.has_leading_space AND NOT b.is_boundary THEN 1 ELSE 0 END AS bytes, 0.5 + ((pr.tgt * 31 + pr.prev * 17) % 97) / 32.0 AS nll FROM pr JOIN lu a ON pr.tgt = a.token_id JOIN lu b ON pr.prev = b.token_id)"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    names = ["<pad>", "<s>", "</s>", "<unk>"] + [f"<0x{i:02X}>" for i in range(256)]
    fixed = spark.createDataFrame(list(enumerate(names)), "token_id long, piece string")
    words = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    rank = F.row_number().over(Window.orderBy("w")) + 259  # a vocabulary: at most LUT_ROWS rows
    return fixed.unionByName(words.select(rank.cast("long").alias("token_id"), F.concat(F.lit("▁"), "w").alias("piece")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    vo = vocabulary(spark, d)
    words = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    ids = words.join(vo.select(F.expr("substring(piece, 2)").alias("w"), F.col("token_id").alias("tgt")).where("tgt >= 260"), "w")
    prev = F.coalesce(F.lag("tgt").over(Window.partitionBy("p_partkey").orderBy("i")), F.lit(1).cast("long"))
    rows = ids.select("p_partkey", "i", "tgt", prev.alias("prev"))
    return M.target_bytes(rows, M.byte_lut(vo)).withColumn("nll", 0.5 + ((F.col("tgt") * 31 + F.col("prev") * 17) % 97) / 32.0)


@register("p17_byte_lut", f"WITH {VOCAB_SQL} SELECT token_id, base_bytes, has_leading_space, is_boundary FROM lu")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return M.byte_lut(vocabulary(spark, d))


@register("p10_target_bytes", f"WITH {PAIRS_SQL} SELECT p_partkey, count(*) AS tokens, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sc GROUP BY 1")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("p_partkey").agg(F.count("*").alias("tokens"), F.sum("bytes").alias("n_bytes"))


SCORES = "count(*) AS tokens, CAST(sum(bytes) AS BIGINT) AS n_bytes, round(sum(nll) / count(*), 6) AS val_loss, round(sum(nll) / ln(2.0) / sum(bytes), 6) AS val_bpb"


@register("a4_val_bpb", f"WITH {PAIRS_SQL} SELECT {SCORES} FROM sc")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return M.loss_metrics(pairs(spark, d))


@register("a4b_document_bpb", f"WITH {PAIRS_SQL} SELECT p_partkey, {SCORES} FROM sc GROUP BY 1")
def a4b(spark: SparkSession, d: str) -> DataFrame:
    return M.loss_metrics(pairs(spark, d), "p_partkey")


@register("a3_rank_sums", f"WITH {PAIRS_SQL}, r AS (SELECT p_partkey % 8 AS rank, round(sum(nll), 5) AS loss_sum, count(*) AS tokens, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sc GROUP BY 1) SELECT * FROM r")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy(F.expr("p_partkey % 8").alias("rank")).agg(F.round(F.sum("nll"), 5).alias("loss_sum"), F.count("*").alias("tokens"), F.sum("bytes").alias("n_bytes"))


@register("a5_weighted_mean", f"WITH {PAIRS_SQL}, b AS (SELECT p_partkey // 37 AS batch, avg(nll) AS m, count(*) AS n FROM sc GROUP BY 1) SELECT round(sum(m * n) / sum(n), 6) AS val_loss, round(avg(m), 6) AS unweighted FROM b")
def a5(spark: SparkSession, d: str) -> DataFrame:
    b = pairs(spark, d).groupBy(F.expr("p_partkey div 37")).agg(F.avg("nll").alias("m"), F.count("*").alias("n"))
    return b.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("val_loss"), F.round(F.avg("m"), 6).alias("unweighted"))


@register("a6_progress", f"WITH {PAIRS_SQL}, b AS (SELECT p_partkey // 100 AS batch, sum(nll) AS s, sum(bytes) AS b FROM sc GROUP BY 1) SELECT batch, round(sum(s) OVER w / ln(2.0) / sum(b) OVER w, 6) AS running_bpb FROM b WINDOW w AS (ORDER BY batch)")
def a6(spark: SparkSession, d: str) -> DataFrame:
    b = pairs(spark, d).groupBy(F.expr("p_partkey div 100").alias("batch")).agg(F.sum("nll").alias("s"), F.sum("bytes").alias("b"))
    w = Window.orderBy("batch")  # one row for each progress line
    return b.select("batch", F.round(M.bits_per_byte(F.sum("s").over(w), F.sum("b").over(w)), 6).alias("running_bpb"))


TEMPS = "(0, 0.9), (1, 0.95), (2, 1.0), (3, 1.05), (4, 1.1)"


@register("t7_argmin_temperature", f"WITH {PAIRS_SQL}, t AS (SELECT ord, CAST(t AS DOUBLE) AS t, round(avg(nll * t + 0.4 / t), 9) AS loss FROM sc, (VALUES {TEMPS}) AS v(ord, t) GROUP BY 1, 2) SELECT t, round(loss, 6) AS loss FROM t ORDER BY t.loss, ord LIMIT 1")
def t7(spark: SparkSession, d: str) -> DataFrame:
    temps = spark.sql(f"SELECT ord, CAST(t AS DOUBLE) AS t FROM VALUES {TEMPS} AS v(ord, t)")
    losses = pairs(spark, d).select("nll").join(F.broadcast(temps)).groupBy("ord", "t").agg(F.round(F.avg(F.col("nll") * F.col("t") + 0.4 / F.col("t")), 9).alias("loss"))
    return losses.agg(F.min_by("t", F.struct("loss", "ord")).alias("t"), F.round(F.min("loss"), 6).alias("loss"))


NGRAM = f"""WITH {TOKENS}, x AS (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM tk), y AS (SELECT doc_id, i, CAST(t AS BIGINT) AS t, CAST(lag(t, 1) OVER w AS BIGINT) AS a, CAST(lag(t, 2) OVER w AS BIGINT) AS b FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def _grams(spark: SparkSession, d: str) -> DataFrame:
    """Each document's tokens with the one and two before: by array shifts, without a shuffle."""
    t = T.byte_tokens(docs(spark, d)).select("doc_id", F.transform("tokens", lambda x: x.cast("long")).alias("t"))
    one = F.concat(F.array(F.lit(None).cast("long")), "t")
    two = F.concat(F.array(F.lit(None).cast("long"), F.lit(None).cast("long")), "t")
    z = F.arrays_zip(F.col("t").alias("t"), F.slice(one, 1, F.size("t")).alias("a"), F.slice(two, 1, F.size("t")).alias("b"))
    return t.select("doc_id", F.explode(z).alias("z")).select("doc_id", "z.*")


@register("w14_bigram_hash", f"{NGRAM} SELECT h, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 3071 ELSE xor(36313 * t, 27191 * a) % 3071 END AS h FROM y) GROUP BY h")
def w14(spark: SparkSession, d: str) -> DataFrame:
    h = F.when(F.col("a").isNull(), F.lit(3071)).otherwise(F.pmod((36313 * F.col("t")).bitwiseXOR(27191 * F.col("a")), F.lit(3071)))
    return _grams(spark, d).groupBy(h.cast("long").alias("h")).agg(F.count("*").alias("n"))


@register("w15_trigram_hash", f"{NGRAM} SELECT h, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 4095 ELSE xor(xor(36313 * t, 27191 * a), 51497 * b) % 4095 END AS h FROM y) GROUP BY h")
def w15(spark: SparkSession, d: str) -> DataFrame:
    x = (36313 * F.col("t")).bitwiseXOR(27191 * F.col("a")).bitwiseXOR(51497 * F.col("b"))
    h = F.when(F.col("b").isNull(), F.lit(4095)).otherwise(F.pmod(x, F.lit(4095)))
    return _grams(spark, d).groupBy(h.cast("long").alias("h")).agg(F.count("*").alias("n"))


@register("w16_polynomial_hash", f"{NGRAM} SELECT h, count(*) AS n FROM (SELECT (coalesce(a, 0) * 92821 + t) % 4096 AS h FROM y) GROUP BY h")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return _grams(spark, d).groupBy(((F.coalesce("a", F.lit(0)) * 92821 + F.col("t")) % 4096).alias("h")).agg(F.count("*").alias("n"))


@register("w18_previous_blend", "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, i, round(0.75 * x + 0.25 * coalesce(lag(x) OVER (PARTITION BY i ORDER BY vec_id), 0), 5) + 0.0 AS blended FROM x")
def w18(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with a part of the one before: buckets of ids on their own, and the last vector of the bucket before."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("bucket", F.expr(f"vec_id div {T.bucket_width(x, 'vec_id')}"))
    ends = x.groupBy("bucket").agg(F.max_by("x", "vec_id").alias("end"))
    before = ends.select("bucket", F.lag("end").over(Window.orderBy("bucket")).alias("end"))  # a row for each bucket
    prev = F.coalesce(F.lag("x").over(Window.partitionBy("bucket").orderBy("vec_id")), F.col("end"))
    both = x.join(before, "bucket").select("vec_id", "x", prev.alias("p"))
    each = both.select("vec_id", "p", F.posexplode("x").alias("k", "v"))
    blend = 0.75 * F.col("v") + 0.25 * F.coalesce(F.get("p", F.col("k")), F.lit(0.0))
    return each.select("vec_id", (F.col("k") + 1).cast("long").alias("i"), (F.round(blend, 5) + F.lit(0.0)).alias("blended"))
