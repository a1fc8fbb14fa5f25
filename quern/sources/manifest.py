"""Manifests and tokenizer descriptors: JSON files that describe an export, and what is chosen by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """version string, num_docs long, num_val_docs long, shuffle_seed long, shard_size long, append_eos boolean, docs_jsonl string,
tokenizers array<struct<name string, kind string, dataset_suffix string, vocab_size long, bos_id long, model_path string, vocab_path string, path string>>,
datasets array<struct<name string, tokenizer_name string, vocab_size long, bos_id long, recommended_bigram_vocab_size long, path string, train_glob string, val_glob string,
  stats struct<docs_total long, docs_val long, docs_train long, files_total long, files_val long, files_train long, tokens_total long, tokens_val long, tokens_train long>>>"""


def write_json(rows: DataFrame, path: str) -> None:
    """One file of JSON with an object for each row; meant for a manifest's single row."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def dataset(manifest: DataFrame, name: str) -> DataFrame:
    """The first dataset of that name; none is an error."""
    found = F.filter("datasets", lambda x: x["name"] == name)
    return manifest.select(F.when(F.size(found) > 0, found[0]).otherwise(F.raise_error(F.lit(f"no dataset {name}"))).alias("d")).select("d.*")


def tokenizer_of(manifest: DataFrame, name: str) -> DataFrame:
    """The tokenizer that a dataset names; one that the manifest lacks is an error."""
    wanted = dataset(manifest, name).select("tokenizer_name")
    rows = manifest.select(F.explode("tokenizers").alias("t")).select("t.*")
    both = wanted.join(F.broadcast(rows), F.col("tokenizer_name") == F.col("name"), "left")
    return both.select(F.coalesce("name", F.raise_error(F.lit("no such tokenizer")).cast("string")).alias("name"), "vocab_size", artifact_path("model_path", "vocab_path", "path").alias("artifact"))


def shard_prefix(manifest: DataFrame, name: str, train: int) -> DataFrame:
    """``split, shard_id`` of all validation shards and the first ``train`` training shards; more than there are is an error."""
    s = dataset(manifest, name).select("stats.files_val", "stats.files_train")
    asked = F.when(F.lit(train) <= F.col("files_train"), F.lit(train).cast("long")).otherwise(F.raise_error(F.lit(f"fewer than {train} training shards")).cast("long"))
    ids = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    each = s.select(F.explode(F.array(F.struct(F.lit("val").alias("split"), ids(F.col("files_val")).alias("k")), F.struct(F.lit("train").alias("split"), ids(asked).alias("k")))).alias("x"))
    return each.select("x.split", F.explode("x.k").alias("shard_id"))


def artifact_path(*names: str) -> Column:
    """The first path that is set; none is null."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def relative_path(path: str, root: str) -> Column:
    """An absolute path under the root, from there; any other path as it is."""
    p = F.col(path)
    return F.when(p == root, ".").when(p.startswith(root.rstrip("/") + "/"), F.substr(p, F.lit(len(root.rstrip("/")) + 2))).otherwise(p)


def variant_kind(name: str) -> Column:
    """``byte260``, or ``sp`` with digits; any other name is null."""
    return F.when(F.col(name) == "byte260", "byte260").when(F.col(name).rlike("^sp[0-9]+$"), "sp")


def local_path(path: str, remote: str, local: str) -> Column:
    """Where a remote path lies locally: datasets and tokenizers have folders of their own."""
    p, r = F.col(path), remote.rstrip("/") + "/"
    return F.when(p.startswith(r), F.concat(F.lit(local.rstrip("/") + "/"), F.substr(p, F.lit(len(r) + 1)))).otherwise(p)


def tokenizer_kind(kind: str, builder: str, suffix: str, vocab_size: str) -> Column:
    """By the kind, else by the builder's name, else by the suffix, else by the vocabulary; null if none tells."""
    name = F.element_at(F.split(F.coalesce(builder, F.lit("")), ":"), -1)
    sp, byte = F.lit("sentencepiece_bpe"), F.lit("byte")
    return (
        F.when(F.col(kind).isin("byte", "pure_byte"), byte).when(F.col(kind).isin("sentencepiece_bpe", "sentencepiece"), sp)
        .when(name == "build_pure_byte_tokenizer", byte).when(name == "build_sentencepiece_tokenizer", sp)
        .when(F.col(suffix) == "byte260", byte).when(F.col(vocab_size).isNotNull(), sp)
    )


def validation_docs(asked: str, sidecar: str, default: int = 50_000) -> Column:
    return F.coalesce(asked, sidecar, F.lit(default))


def byte_descriptor(spark: SparkSession, offset: int = 4, specials: tuple[str, ...] = ("pad", "bos", "eos", "unk")) -> DataFrame:
    """The descriptor of the pure byte tokenizer: special ids first, then a token for each byte."""
    n = offset + 256
    ids = [F.lit(i).alias(f"{s}_id") for i, s in enumerate(specials)]
    return spark.range(1).select(F.lit(f"pure_byte_{n}").alias("name"), F.lit(f"byte{n}").alias("suffix"), F.lit(n).alias("vocab_size"), *ids, F.lit(offset).alias("byte_offset"), F.lit(256).alias("byte_count"))
