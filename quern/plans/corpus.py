"""Queries of the corpus plane: scans, tokens, splits, packing, counters, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..sources import manifest as M
from .registry import register, shared_folder

NUM_VAL, SHARD = 50, 100_000
#: Tokens of each document as a DuckDB list.
TOKENS = "tk AS (SELECT doc_id, list_prepend(1, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER) + 4)) AS tokens FROM documents)"
PLACED = f"""pl AS (SELECT doc_id, split, n, CAST(coalesce(sum(n) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM (SELECT doc_id, CASE WHEN doc_id < {NUM_VAL} THEN 'val' ELSE 'train' END AS split, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n FROM documents))"""
PARTS = f"""pt AS (SELECT split, shard_id, doc_id, greatest("offset", shard_id * {SHARD}) - "offset" AS lo, least("offset" + n, (shard_id + 1) * {SHARD}) - "offset" AS hi
  FROM (SELECT *, unnest(range("offset" // {SHARD}, ("offset" + n - 1) // {SHARD} + 1)) AS shard_id FROM pl))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def placed(spark: SparkSession, d: str) -> DataFrame:
    return T.document_offsets(docs(spark, d), NUM_VAL)


@register("flagship_shard_stats", f"WITH {PLACED}, {PARTS} SELECT split, shard_id, CAST(sum(hi - lo) AS BIGINT) AS tokens, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) FILTER (lo = 0) AS docs_begun FROM pt GROUP BY split, shard_id")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return T.shard_stats(T.pack(placed(spark, d), SHARD))


@register("s1_document_scan", "SELECT doc_id, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"))


@register("s2_document_count", "SELECT count(*) AS docs FROM documents")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).agg(F.count("*").alias("docs"))


@register("s4_trainer_text", r"SELECT doc_id, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(replace(text, chr(0), ' '), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return T.trainer_text(docs(spark, d)).select("doc_id", F.length("text").cast("long").alias("n"))


@register("p1_byte_tokens", f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) - 1 AS BIGINT) AS n, CAST(list_sum(tokens) - 1 AS BIGINT) AS total, list_max(tokens) AS largest FROM tk")
def p1(spark: SparkSession, d: str) -> DataFrame:
    t = T.byte_tokens(docs(spark, d), bos=False)
    return t.select("doc_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("tokens").alias("largest"))


@register("p3_bos_framing", f"WITH {TOKENS} SELECT doc_id, tokens[1] AS first_token, tokens[2] AS second_token, CAST(len(tokens) AS BIGINT) AS n FROM tk")
def p3(spark: SparkSession, d: str) -> DataFrame:
    t = T.byte_tokens(docs(spark, d))
    return t.select("doc_id", F.col("tokens")[0].alias("first_token"), F.get("tokens", F.lit(1)).alias("second_token"), F.size("tokens").cast("long").alias("n"))


@register("p4_token_range", f"WITH {TOKENS} SELECT doc_id, list_filter(tokens, lambda t: t < 0 OR t >= 190)[1] AS first_bad FROM tk WHERE len(list_filter(tokens, lambda t: t < 0 OR t >= 190)) > 0")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return T.first_bad_token(T.byte_tokens(docs(spark, d)), 190)


@register("p5_split_assignment", f"SELECT CASE WHEN doc_id < {NUM_VAL} THEN 'val' ELSE 'train' END AS split, count(*) AS docs FROM documents GROUP BY 1")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(T.split_of(F.col("doc_id"), NUM_VAL).alias("split")).agg(F.count("*").alias("docs"))


RESOLVE = "(VALUES (1, 10, 20), (2, NULL, 20), (3, NULL, NULL)) AS v(case_id, cli, sidecar)"


@register("p6_val_count", f"SELECT case_id, coalesce(cli, sidecar, 50000) AS docs_val FROM {RESOLVE}")
def p6(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 10, 20), (2, None, 20), (3, None, None)], "case_id int, cli int, sidecar int")
    return rows.select("case_id", M.validation_docs("cli", "sidecar").alias("docs_val"))


SPECS = "(1,'byte','',NULL,NULL),(2,NULL,'x.y:build_pure_byte_tokenizer',NULL,NULL),(3,NULL,'build_sentencepiece_tokenizer',NULL,NULL),(4,NULL,NULL,'byte260',NULL),(5,NULL,NULL,NULL,1024),(6,'sentencepiece','','byte260',NULL),(7,NULL,NULL,NULL,NULL)"
KIND = """CASE WHEN kind IN ('byte', 'pure_byte') THEN 'byte' WHEN kind IN ('sentencepiece_bpe', 'sentencepiece') THEN 'sentencepiece_bpe'
  WHEN regexp_extract(coalesce(builder, ''), '([^:]*)$', 1) = 'build_pure_byte_tokenizer' THEN 'byte' WHEN regexp_extract(coalesce(builder, ''), '([^:]*)$', 1) = 'build_sentencepiece_tokenizer' THEN 'sentencepiece_bpe'
  WHEN suffix = 'byte260' THEN 'byte' WHEN vocab_size IS NOT NULL THEN 'sentencepiece_bpe' ELSE 'error' END"""


@register("p7_tokenizer_kind", f"SELECT spec, {KIND} AS resolved FROM (VALUES {SPECS}) AS v(spec, kind, builder, suffix, vocab_size)")
def p7(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {SPECS} AS v(spec, kind, builder, suffix, vocab_size)")
    return rows.select("spec", F.coalesce(M.tokenizer_kind("kind", "builder", "suffix", "vocab_size"), F.lit("error")).alias("resolved"))


@register("p8_bigram_size", "SELECT p_partkey AS vocab, ((p_partkey + 127) // 128) * 128 * 5 AS bigram_rows FROM part")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("vocab"), F.expr("((p_partkey + 127) div 128) * 128 * 5").alias("bigram_rows"))


@register("w1_global_offsets", f'WITH {PLACED} SELECT doc_id, split, n, "offset" FROM pl')
def w1(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d)


@register("w2_shard_packing", f"WITH {PLACED}, {PARTS} SELECT split, shard_id, doc_id, lo, hi FROM pt")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return T.pack(placed(spark, d), SHARD)


A1 = f"""WITH {PLACED}, b AS (SELECT split, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST((sum(n) + {SHARD - 1}) // {SHARD} AS BIGINT) AS files FROM pl GROUP BY split)
SELECT coalesce(split, 'total') AS split, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(files) AS BIGINT) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY ROLLUP (split)"""


@register("a1_export_counters", A1)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return T.export_counters(placed(spark, d), SHARD)


@register("a2_count_reconciliation", "SELECT count(*) AS expected, count(*) AS exported, true AS ok FROM documents")
def a2(spark: SparkSession, d: str) -> DataFrame:
    parts = T.pack(placed(spark, d), SHARD)
    exported = parts.agg(F.sum((F.col("lo") == 0).cast("long")).alias("exported"))
    return docs(spark, d).agg(F.count("*").alias("expected")).join(exported).withColumn("ok", F.col("expected") == F.col("exported"))


NAME = "documents_byte260"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the byte-token export, written as JSON and read back."""
    c = T.export_counters(placed(spark, d), SHARD)
    of = lambda what, split: F.coalesce(F.max(F.when(F.col("split") == split, F.col(what))), F.lit(0)).alias(f"{what}_{split}")
    stats = c.agg(*[of(w, s) for w in ("docs", "files", "tokens") for s in ("total", "val", "train")])
    tokenizer = F.struct(F.lit("pure_byte_260").alias("name"), F.lit("byte").alias("kind"), F.lit("byte260").alias("dataset_suffix"), F.lit(260).alias("vocab_size"), F.lit(T.BOS).alias("bos_id"), F.lit("tokenizers/byte260.json").alias("path"))
    data = F.struct(
        F.lit(NAME).alias("name"), F.lit("pure_byte_260").alias("tokenizer_name"), F.lit(260).alias("vocab_size"), F.lit(T.BOS).alias("bos_id"), F.lit(T.bigram_size(260)).alias("recommended_bigram_vocab_size"),
        F.lit(f"datasets/{NAME}").alias("path"), F.lit(f"datasets/{NAME}/train_*.bin").alias("train_glob"), F.lit(f"datasets/{NAME}/val_*.bin").alias("val_glob"), F.struct(*[f"{w}_{s}" for w in ("docs", "files", "tokens") for s in ("total", "val", "train")]).alias("stats"),
    )
    made = stats.select(
        F.lit("1").alias("version"), F.col("docs_total").alias("num_docs"), F.col("docs_val").alias("num_val_docs"), F.lit(SHARD).alias("shard_size"), F.lit(False).alias("append_eos"), F.lit("documents.jsonl").alias("docs_jsonl"),
        F.array(tokenizer).alias("tokenizers"), F.array(data).alias("datasets"),
    )
    path = shared_folder(spark, "manifest")
    M.write_json(made, path)
    return M.read_manifest(spark, path)


S11 = f"""WITH {PLACED}, b AS (SELECT split, count(*) AS docs, sum(n) AS tokens, (sum(n) + {SHARD - 1}) // {SHARD} AS files FROM pl GROUP BY split)
SELECT 'documents_byte260' AS dataset, 'pure_byte_260' AS tokenizer, CAST(260 AS BIGINT) AS vocab, CAST(1 AS BIGINT) AS bos_id, CAST(((260 + 127) // 128) * 128 * 5 AS BIGINT) AS bigram_rows, CAST(sum(docs) AS BIGINT) AS docs_total, CAST(sum(tokens) AS BIGINT) AS tokens_total,
 CAST(sum(docs) FILTER (split = 'val') AS BIGINT) AS docs_val, CAST(sum(docs) FILTER (split = 'train') AS BIGINT) AS docs_train, CAST(sum(files) AS BIGINT) AS files_total, CAST(sum(files) FILTER (split = 'val') AS BIGINT) AS files_val, CAST(sum(files) FILTER (split = 'train') AS BIGINT) AS files_train,
 CAST(sum(tokens) FILTER (split = 'val') AS BIGINT) AS tokens_val, CAST(sum(tokens) FILTER (split = 'train') AS BIGINT) AS tokens_train, CAST({SHARD} AS BIGINT) AS shard_size, 'tokenizers/byte260.json' AS artifact FROM b"""


@register("s11_manifest", S11)
def s11(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's dataset and its tokenizer (P15, J2), after a round trip through the file."""
    m = manifest(spark, d)
    data = M.dataset(m, NAME).select(F.col("name").alias("dataset"), F.col("tokenizer_name").alias("tokenizer"), F.col("vocab_size").alias("vocab"), "bos_id", F.col("recommended_bigram_vocab_size").alias("bigram_rows"), "stats.*")
    return data.join(F.broadcast(m.select("shard_size"))).join(F.broadcast(M.tokenizer_of(m, NAME).select("artifact")))


@register("s16_shard_prefix", f"WITH {PLACED}, {PARTS} SELECT split, shard_id, count(*) AS docs FROM pt WHERE split = 'val' OR shard_id < 2 GROUP BY split, shard_id")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """All validation shards and the first two of training, by the manifest, which must have so many."""
    chosen = M.shard_prefix(manifest(spark, d), NAME, 2)
    return T.pack(placed(spark, d), SHARD).join(F.broadcast(chosen), ["split", "shard_id"], "left_semi").groupBy("split", "shard_id").agg(F.count("*").alias("docs"))


VARIANTS = "('byte260'),('sp1024'),('sp8192'),('spx'),('sp'),('foo')"


@register("s17_variant_names", f"SELECT v, CASE WHEN v = 'byte260' THEN 'byte260' WHEN regexp_matches(v, '^sp[0-9]+$') THEN 'sp' ELSE 'error' END AS kind FROM (VALUES {VARIANTS}) AS t(v)")
def s17(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT v FROM VALUES {VARIANTS} AS t(v)")
    return rows.select("v", F.coalesce(M.variant_kind("v"), F.lit("error")).alias("kind"))


PATHS = "('root/datasets/a/x.bin'),('root/tokenizers/t.model'),('root/manifest.json'),('/abs/root/other')"
MAP = "CASE WHEN p LIKE 'root/datasets/%' THEN regexp_replace(p, '^root/datasets/', 'data/datasets/') WHEN p LIKE 'root/tokenizers/%' THEN regexp_replace(p, '^root/tokenizers/', 'data/tokenizers/') WHEN p LIKE 'root/%' THEN regexp_replace(p, '^root/', 'data/') ELSE p END"


@register("s18_path_map", f"SELECT p, {MAP} AS local FROM (VALUES {PATHS}) AS t(p)")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT p FROM VALUES {PATHS} AS t(p)").select("p", M.local_path("p", "root", "data").alias("local"))


ARTIFACTS = "(1,'m','v','p'),(2,NULL,'v','p'),(3,NULL,NULL,'p'),(4,NULL,NULL,NULL)"


@register("s19_artifact_path", f"SELECT id, coalesce(model_path, vocab_path, path, 'error') AS chosen FROM (VALUES {ARTIFACTS}) AS t(id, model_path, vocab_path, path)")
def s19(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {ARTIFACTS} AS t(id, model_path, vocab_path, path)")
    return rows.select("id", F.coalesce(M.artifact_path("model_path", "vocab_path", "path"), F.lit("error")).alias("chosen"))


@register("u1_ordered_union", f"WITH {PLACED}, {PARTS} SELECT row_number() OVER (ORDER BY split DESC, shard_id, doc_id) AS ordinal, split, shard_id, doc_id FROM pt")
def u1(spark: SparkSession, d: str) -> DataFrame:
    """The parts of all shards, one after the other."""
    return T.part_ordinals(placed(spark, d), SHARD)


@register("u2_duplicate_names", "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@register("u3_unconsumed_keys", "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one table that the other did not use."""
    return docs(spark, d).select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("key"))


@register("j2_dataset_tokenizer", "SELECT l.doc_id, coalesce(b.source, 'missing') AS source FROM labels l LEFT JOIN documents b ON l.doc_id = b.doc_id")
def j2(spark: SparkSession, d: str) -> DataFrame:
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id")
    return lab.join(docs(spark, d).select("doc_id", "source"), "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("missing")).alias("source"))
