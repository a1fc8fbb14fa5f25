"""Queries of the smaller operators: loads with caps, path maps, lookups with fallback, mixes, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quant as Q
from ..operators import tokens as T
from ..sources import manifest as M
from ..sources.files import sidecar
from . import quantization as N
from .corpus import docs
from .evaluation import PAIRS_SQL, pairs
from .registry import register, shared_folder
from .windowing import TOTAL, total_tokens


@register("s3_batched_scan", "SELECT doc_id // 128 AS batch, count(*) AS docs FROM documents GROUP BY 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.expr("doc_id div 128").alias("batch")).agg(F.count("*").alias("docs"))


@register("s8_validation_load", f"WITH {TOTAL} SELECT total, (total - 1) // 1024 * 1024 + 1 AS used, (least(total, 500000) - 1) // 1024 * 1024 + 1 AS used_capped FROM tt")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Tokens left after cutting to whole sequences, without and with the cap of 500,000."""
    t = docs(spark, d).agg(F.sum(T.token_count(F.col("text"))).alias("total"))
    return t.selectExpr("total", "(total - 1) div 1024 * 1024 + 1 AS used", "(least(total, 500000) - 1) div 1024 * 1024 + 1 AS used_capped")


PATHS = "('/out/root/datasets/a.bin'), ('/out/root'), ('relative/x'), ('/elsewhere/y'), ('/out/rootless/z')"
REL = "CASE WHEN p = '/out/root' THEN '.' WHEN p LIKE '/out/root/%' THEN substring(p, 11) ELSE p END"


@register("s12_relative_paths", f"SELECT p, {REL} AS relative FROM (VALUES {PATHS}) AS t(p)")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT p FROM VALUES {PATHS} AS t(p)").select("p", M.relative_path("p", "/out/root").alias("relative"))


@register("s14_byte_descriptor", "SELECT 'pure_byte_260' AS name, 'byte260' AS suffix, CAST(260 AS BIGINT) AS vocab_size, CAST(0 AS BIGINT) AS pad_id, CAST(1 AS BIGINT) AS bos_id, CAST(2 AS BIGINT) AS eos_id, CAST(3 AS BIGINT) AS unk_id, CAST(4 AS BIGINT) AS byte_offset, CAST(256 AS BIGINT) AS byte_count")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """The byte tokenizer's descriptor (P19), written as JSON and read back (S13, S14)."""
    path = shared_folder(spark, "tokenizer")
    M.write_json(M.byte_descriptor(spark), path)
    return spark.read.schema("name string, suffix string, vocab_size long, pad_id long, bos_id long, eos_id long, unk_id long, byte_offset long, byte_count long").json(path, multiLine=True)


SIDECARS = ['{"num_docs": 9}', '{"docs_val": 4}', "{}"]
S22 = ", ".join(f"({i}, '{x}')" for i, x in enumerate(SIDECARS))


@register("s22_sidecar_defaults", f"SELECT id, CAST(json_extract_string(j, '$.num_docs') AS BIGINT) AS num_docs, CAST(coalesce(CAST(json_extract_string(j, '$.docs_val') AS BIGINT), 50000) AS BIGINT) AS docs_val FROM (VALUES {S22}) AS t(id, j)")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar files, read one by one."""
    out = None
    for i, text in enumerate(SIDECARS):
        path = shared_folder(spark, "sidecar")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        one = sidecar(spark, path).select(F.lit(i).alias("id"), "num_docs", F.coalesce("docs_val", F.lit(50000)).alias("docs_val"))
        out = one if out is None else out.unionByName(one)
    return out


@register("p20_tensor_bytes", "SELECT label, CAST(count(*) * 64 * 4 AS BIGINT) AS float32_bytes, CAST(count(*) * 64 * 2 AS BIGINT) AS half_bytes, CAST(count(*) * 64 AS BIGINT) AS int8_bytes FROM embeddings GROUP BY 1")
def p20(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.sum(F.size("embedding").cast("long")).alias("n"))
    return n.select("label", (F.col("n") * 4).alias("float32_bytes"), (F.col("n") * 2).alias("half_bytes"), F.col("n").alias("int8_bytes"))


@register("j1_lookup_gather", f"WITH {PAIRS_SQL} SELECT tgt, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM sc GROUP BY 1")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("tgt").agg(F.count("*").alias("n"), F.sum("bytes").alias("n_bytes"))


SPEC = "(1, 1024), (2, 8192), (3, NULL), (4, 4096)"
REUSE = "(1024, 'a.model'), (4096, 'b.model')"


@register("j3_reused_models", f"SELECT id, coalesce(m, 'train') AS model FROM (VALUES {SPEC}) AS s(id, v) LEFT JOIN (VALUES {REUSE}) AS r(v, m) ON s.v = r.v")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT id, coalesce(m, 'train') AS model FROM VALUES {SPEC} AS s(id, v) LEFT JOIN (SELECT * FROM VALUES {REUSE} AS r(v, m)) r ON s.v = r.v")


@register("j4_state_match", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one table whose key the other has; the rest is skipped."""
    keys = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("vec_id"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id").join(keys, "vec_id", "left_semi")


@register("j5_hessian_fallback", "SELECT e.vec_id, CASE WHEN l.doc_id IS NULL THEN 'percentile' ELSE 'gptq' END AS strategy FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def j5(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("has"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id").join(keys, "vec_id", "left")
    return e.select("vec_id", F.when(F.col("has"), "gptq").otherwise("percentile").alias("strategy"))


@register("j9_bank_rebuild", "WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, count(DISTINCT vec_id) AS rows, round(sum(CAST(x AS DOUBLE) * i), 3) AS checksum FROM v GROUP BY 1")
def j9(spark: SparkSession, d: str) -> DataFrame:
    """A bank is split into cells and put together again in order."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    cells = e.select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    back = cells.groupBy("label", "vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    s = F.aggregate("r", F.lit(0.0), lambda a, c: a + c["x"].cast("double") * (c["i"] + 1))
    return back.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.sum(s), 3).alias("checksum"))


@register("a16_mean_squared_error", f"WITH {N.int8_sql(Q.CLIP_Q, 127)} SELECT label, round(avg((v - q * scale) * (v - q * scale)), 6) AS mse FROM q GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    b = Q.dequantize(Q.int8_rows(N.rows(spark, d)))
    return b.groupBy("label").agg(F.round(F.avg(Q.mean_square(F.col("x"), F.col("back"))), 6).alias("mse"))


@register("q9_mixed_precision", f"WITH {N.X}, v AS (SELECT vec_id, label, unnest(x) AS v FROM x), s AS (SELECT vec_id, greatest(max(abs(v)) / CASE WHEN any_value(label) % 2 = 0 THEN 31 ELSE 15 END, 1e-12) AS scale FROM v GROUP BY 1) SELECT label % 2 AS odd, CAST(sum(abs(greatest(CASE WHEN label % 2 = 0 THEN -32.0 ELSE -16.0 END::DOUBLE, least(CASE WHEN label % 2 = 0 THEN 31.0 ELSE 15.0 END::DOUBLE, round_even(v / scale, 0))))) AS BIGINT) AS mass FROM v JOIN s USING (vec_id) GROUP BY 1")
def q9(spark: SparkSession, d: str) -> DataFrame:
    """Six bits for matrices of even label, five for odd ones."""
    r = N.rows(spark, d)
    both = Q.amax_rows(r.where("label % 2 = 0"), 31).unionByName(Q.amax_rows(r.where("label % 2 <> 0"), 15))
    return both.groupBy(F.expr("label % 2").alias("odd")).agg(F.sum(Q.total(Q.absolute(F.col("q")))).cast("long").alias("mass"))


@register("q18_fake_quantization", f"WITH {N.LONG}, s AS (SELECT vec_id, greatest(max(abs(v)) / 31, CAST(1 AS DOUBLE) / 127) AS scale FROM v GROUP BY 1) SELECT vec_id, round(sum(scale * greatest(-32.0::DOUBLE, least(31.0::DOUBLE, round_even(v / scale, 0)))), 4) + 0.0 AS total FROM v JOIN s USING (vec_id) GROUP BY 1")
def q18(spark: SparkSession, d: str) -> DataFrame:
    b = Q.dequantize(Q.amax_rows(N.rows(spark, d), 31, floor=1 / 127))
    return b.select("vec_id", (F.round(Q.total(F.col("back")), 4) + F.lit(0.0)).alias("total"))


@register("t12_weighted_mix", "WITH w AS (SELECT source, count(*) AS left_, pow(count(*), 0.9) AS early, pow(count(*), 0.5) AS late FROM documents GROUP BY 1) SELECT source, round(early / sum(early) OVER (), 6) AS early, round(late / sum(late) OVER (), 6) AS late FROM w")
def t12(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix that weighs each source by its remaining size to a power, at the first and the last batch."""
    w = docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", F.pow("n", F.lit(0.9)).alias("e"), F.pow("n", F.lit(0.5)).alias("l"))
    total = w.agg(F.sum("e").alias("te"), F.sum("l").alias("tl"))
    return w.join(F.broadcast(total)).select("source", F.round(F.col("e") / F.col("te"), 6).alias("early"), F.round(F.col("l") / F.col("tl"), 6).alias("late"))


@register("r0_stream_population", f"WITH {TOTAL} SELECT total, total // 2048 AS sequences, total % 2048 AS rest FROM tt")
def r0(spark: SparkSession, d: str) -> DataFrame:
    """The population that a score covers, to be reported with it."""
    n = total_tokens(spark, d)
    return spark.range(1).select(F.lit(n).cast("long").alias("total"), F.lit(n // 2048).cast("long").alias("sequences"), F.lit(n % 2048).cast("long").alias("rest"))
