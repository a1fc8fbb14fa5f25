"""Queries of run analytics: logs, submissions, leaderboards, seed statistics, rules, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import t_cdf
from ..sources import logs
from .registry import register, shared_folder

#: Lines in the two log grammars, the final lines, and the settings block.
LOG = [
    "step:100/20000 train_loss:3.2150 train_time:4354ms step_avg:43.54ms",
    "step:200/20000 val_loss:2.5000 val_bpb:1.4800 train_time:8708ms step_avg:43.54ms",
    "500/20000 train_loss: 3.3789 train_time: 0.9m tok/s: 7690000",
    "4000/20000 val_loss: 2.8779 val_bpb: 1.1141",
    "final_int8_zlib_roundtrip_exact val_loss:2.06724000 val_bpb:1.22436570",
    "quantized_ttt val_loss:2.79200000 val_bpb:1.08100000 eval_time:366525ms",
    "ttt_sliding:done val_loss=1.889000 val_bpb=1.119400",
    "  model_dim: 512",
    "  num_layers: 9",
    "Serialized model int8+zlib: 15815847 bytes",
    "peak memory allocated: 10184 MiB reserved: 10588 MiB",
    "stopping_early: wallclock_cap train_time:600038ms step:13780/20000",
    "something else",
]
LINES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LOG))


def _log(name: str, parse, sql: str) -> None:
    """The lines are written as a log file, read again, and parsed; SQL has them as VALUES."""

    @register(name, sql.format(src=f"(VALUES {LINES}) AS t(id, line)"))
    def query(spark: SparkSession, d: str) -> DataFrame:
        path = shared_folder(spark, "log") + "/train.log"
        spark.createDataFrame([("\n".join(LOG),)], "value string").coalesce(1).write.text(path)
        return parse(logs.read_log(spark, path))


def _x(pattern: str, kind: str = "DOUBLE", group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract(line, '{pattern}', {group}), '') AS {kind})"


_log("l1_step_lines", logs.step_lines, f"""SELECT id, {_x('^step:([0-9]+)/', 'BIGINT')} AS step, {_x('^step:[0-9]+/([0-9]+)', 'BIGINT')} AS steps, {_x('train_loss:([0-9.]+)')} AS train_loss, {_x('val_loss:([0-9.]+)')} AS val_loss, {_x('val_bpb:([0-9.]+)')} AS val_bpb,
 {_x('train_time:([0-9]+)ms', 'BIGINT')} AS time_ms, {_x('step_avg:([0-9.]+)ms')} AS step_avg FROM {{src}} WHERE regexp_matches(line, '^step:[0-9]+/[0-9]+ ')""")
_log("l2_slash_lines", logs.slash_lines, f"""SELECT id, {_x('^([0-9]+)/', 'BIGINT')} AS step, {_x('train_loss: ([0-9.]+)')} AS train_loss, {_x('val_loss: ([0-9.]+)')} AS val_loss, {_x('val_bpb: ([0-9.]+)')} AS val_bpb,
 CAST({_x('train_time: ([0-9.]+)m')} * 60000 AS BIGINT) AS time_ms, {_x('tok/s: ([0-9]+)', 'BIGINT')} AS tokens_per_s FROM {{src}} WHERE regexp_matches(line, '^[0-9]+/[0-9]+ ')""")
_log("l3_final_scores", logs.final_scores, f"""SELECT id, regexp_extract(line, '^([a-z0-9_]+)[ :]', 1) AS label, {_x('val_loss[:=]([0-9.]+)')} AS val_loss, {_x('val_bpb[:=]([0-9.]+)')} AS val_bpb, {_x('eval_time:([0-9]+)ms', 'BIGINT')} AS eval_ms
 FROM {{src}} WHERE regexp_matches(line, '^(final|quantized|ttt)')""")
_log("l4_settings", logs.settings, "SELECT id, regexp_extract(line, '^  ([a-z_]+): ', 1) AS name, regexp_extract(line, '^  [a-z_]+: (.*)$', 1) AS setting FROM {src} WHERE regexp_matches(line, '^  [a-z_]+: ')")
_log("l5_sizes", logs.sizes, f"SELECT id, {_x('([0-9]+) bytes', 'BIGINT')} AS bytes, {_x('allocated: ([0-9]+) MiB', 'BIGINT')} AS peak_mib FROM {{src}} WHERE regexp_matches(line, '[0-9] bytes|MiB')")
_log("l6_early_stop", logs.early_stops, f"SELECT id, {_x('train_time:([0-9]+)ms', 'BIGINT')} AS time_ms, {_x('step:([0-9]+)/', 'BIGINT')} AS step FROM {{src}} WHERE regexp_matches(line, '^stopping_early')")
_log("l10_throughput", logs.throughput, f"SELECT id, round({_x('train_time:([0-9]+)ms', 'BIGINT')} / CAST(greatest({_x('step:([0-9]+)/', 'BIGINT')}, 1) AS DOUBLE), 4) AS step_ms FROM {{src}} WHERE regexp_matches(line, 'train_time:[0-9]+ms')")

BOARD = "(1, 'a', 1.2244, '2026-03-17'), (2, 'b', 1.2197, '2026-03-18'), (3, 'c', 1.2230, '2026-03-18'), (4, 'd', 1.1925, '2026-03-19'), (5, 'e', 1.1928, '2026-03-19'), (6, 'f', 1.0810, '2026-04-09')"


def board(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT id, run, CAST(score AS DOUBLE) AS score, day FROM VALUES {BOARD} AS t(id, run, score, day)")


BEST = f"b AS (SELECT id, run, CAST(score AS DOUBLE) AS score, day FROM (VALUES {BOARD}) AS t(id, run, score, day)), r AS (SELECT *, min(score) OVER (ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b)"


def before() -> Window:
    return Window.orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)  # a leaderboard: a few hundred rows


@register("w17_record_sequence", f"WITH {BEST} SELECT id, run, score, best IS NULL OR score < best AS is_record FROM r")
def w17(spark: SparkSession, d: str) -> DataFrame:
    best = F.min("score").over(before())
    return board(spark).select("id", "run", "score", (best.isNull() | (F.col("score") < best)).alias("is_record"))


@register("l8_acceptance", f"WITH {BEST} SELECT id, round((best - score) * ln(2.0) * 2.3, 6) AS gain_nats, coalesce((best - score) * ln(2.0) * 2.3 >= 0.005, true) AS accepted FROM r")
def l8(spark: SparkSession, d: str) -> DataFrame:
    """Gain over the best before in nats a token, at 2.3 bytes a token; at least 0.005 is asked for."""
    gain = (F.min("score").over(before()) - F.col("score")) * F.log(F.lit(2.0)) * 2.3
    return board(spark).select("id", F.round(gain, 6).alias("gain_nats"), F.coalesce(gain >= 0.005, F.lit(True)).alias("accepted"))


@register("l9_delta_to_baseline", f"WITH {BEST} SELECT id, round(score - (SELECT score FROM b WHERE id = 1), 6) AS delta_bpb, round((score - (SELECT score FROM b WHERE id = 1)) * ln(2.0), 6) AS delta_nats_per_byte FROM b")
def l9(spark: SparkSession, d: str) -> DataFrame:
    b = board(spark)
    delta = F.col("score") - F.col("base")
    return b.join(F.broadcast(b.where("id = 1").select(F.col("score").alias("base")))).select("id", F.round(delta, 6).alias("delta_bpb"), F.round(delta * F.log(F.lit(2.0)), 6).alias("delta_nats_per_byte"))


@register("l7_leaderboard", f"WITH {BEST} SELECT day, min(score) AS best, count(*) AS runs FROM b GROUP BY 1")
def l7(spark: SparkSession, d: str) -> DataFrame:
    return board(spark).groupBy("day").agg(F.min("score").alias("best"), F.count("*").alias("runs"))


# fixed values: scores of three seeds each of two runs, with t = -11.83 and df = 3.31
SEEDS = "('new', 1.11508120), ('new', 1.11437394), ('new', 1.11475014), ('old', 1.11922988), ('old', 1.12002032), ('old', 1.11888882)"


def seeds(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT grp, CAST(v AS DOUBLE) AS v FROM VALUES {SEEDS} AS t(grp, v)")


@register("a18_seed_summary", f"SELECT grp, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 8) AS mean, round(stddev_samp(CAST(v AS DOUBLE)), 8) AS sd, min(CAST(v AS DOUBLE)) AS lo, max(CAST(v AS DOUBLE)) AS hi FROM (VALUES {SEEDS}) AS t(grp, v) GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("mean"), F.round(F.stddev_samp("v"), 8).alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))


WELCH = f"""WITH s AS (SELECT grp, avg(CAST(v AS DOUBLE)) AS m, var_samp(CAST(v AS DOUBLE)) / count(*) AS q, count(*) AS n FROM (VALUES {SEEDS}) AS t(grp, v) GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(a.q + b.q), 4) AS t, round((a.q + b.q) * (a.q + b.q) / (a.q * a.q / (a.n - 1) + b.q * b.q / (b.n - 1)), 4) AS df FROM s a, s b WHERE a.grp = 'new' AND b.grp = 'old'"""


def welch(rows: DataFrame, a: str, b: str) -> DataFrame:
    """t and degrees of freedom of two groups of ``rows(grp, v)``; one aggregate."""
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("v")))
    s = rows.agg(*[of(f, g).alias(f"{n}{k}") for k, g in ((1, a), (2, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return s.select(((F.col("m1") - F.col("m2")) / F.sqrt(q1 + q2)).alias("t"), ((q1 + q2) * (q1 + q2) / (q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1))).alias("df"))


@register("a20_welch_test", WELCH)
def a20(spark: SparkSession, d: str) -> DataFrame:
    return welch(seeds(spark), "new", "old").select(F.round("t", 4).alias("t"), F.round("df", 4).alias("df"))


@register("a20p_welch_p_value")
def a20p(spark: SparkSession, d: str) -> DataFrame:
    return welch(seeds(spark), "new", "old").select(F.round("t", 4).alias("t"), F.round(t_cdf("t", "df"), 8).alias("p"))


@register("l8p_significant_record")
def l8p(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of the rule: at least 0.005 nats better than the best before, and p under 0.01 (one-sided)."""
    gain = seeds(spark).agg((F.avg(F.when(F.col("grp") == "old", F.col("v"))) - F.avg(F.when(F.col("grp") == "new", F.col("v")))).alias("gain")).select((F.col("gain") * F.log(F.lit(2.0)) * 2.3).alias("gain_nats"))
    test = welch(seeds(spark), "new", "old").select(t_cdf("t", "df").alias("p"))
    return gain.join(F.broadcast(test)).select(F.round("gain_nats", 6).alias("gain_nats"), F.round("p", 6).alias("p"), ((F.col("gain_nats") >= 0.005) & (F.col("p") < 0.01)).alias("accepted"))


RUNS4 = "(1.1927), (1.1935), (1.1921), (1.1929)"


@register("a19_one_sample_test")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """One-sided test of a mean below 1.195."""
    v = spark.sql(f"SELECT CAST(v AS DOUBLE) AS v FROM VALUES {RUNS4} AS t(v)")
    s = v.agg(((F.avg("v") - 1.195) / (F.stddev_samp("v") / F.sqrt(F.count("*")))).alias("t"), (F.count("*") - 1).cast("double").alias("df"))
    return s.select(F.round("t", 4).alias("t"), F.round(t_cdf("t", "df"), 4).alias("p"))


SUBS = """(1, '{"author": "x", "val_bpb": 1.2244, "val_loss": 2.0673, "bytes_total": 15863489, "date": "2026-03-18T14:56:29Z", "seeds": [1, 2]}'),
(2, '{"author": "", "val_loss": 1.14276, "artifact_bytes": 15900000, "date": "2026-03-20"}'), (3, '{"author": "y", "mean_bpb": 1.0828, "seeds": {"42": {"val_bpb": 1.083}}, "artifact_size_bytes": 15991930, "p_value": "<0.001"}'),
(4, '{"author": "z", "mean_val_bpb": 1.2, "artifact_bytes_mean": 17000000, "p_value": 0.25}')"""
NUM = lambda k, e: f"CAST({e}(j, '$.{k}') AS DOUBLE)"


def _subs(extract: str) -> str:
    n = lambda k: NUM(k, extract)
    return f"""SELECT id, coalesce({n('val_bpb')}, {n('mean_val_bpb')}, {n('mean_bpb')}) AS bpb, {n('val_loss')} AS val_loss, CAST(coalesce({n('bytes_total')}, {n('artifact_bytes')}, {n('artifact_size_bytes')}, {n('artifact_bytes_mean')}) AS BIGINT) AS bytes,
 {extract}(j, '$.p_value') AS p_value, substring({extract}(j, '$.date'), 1, 10) AS day, coalesce({n('bytes_total')}, {n('artifact_bytes')}, {n('artifact_size_bytes')}, {n('artifact_bytes_mean')}) <= 16000000 AS fits FROM """


@register("p16_submissions", _subs("json_extract_string") + f"(VALUES {SUBS}) AS t(id, j)")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Submissions with keys of many names, and whether the artifact fits."""
    return spark.sql(_subs("get_json_object") + f"VALUES {SUBS} AS t(id, j)")


SCHED = "CASE WHEN step >= 18800 AND step < 20000 THEN greatest((20000 - step) / CAST(1200 AS DOUBLE), 0.0) ELSE 1.0 END"
WALL = "CASE WHEN greatest(600000 - step * 43.5, 0.0) <= 1200 * 43.5 THEN greatest(600000 - step * 43.5, 0.0) / (1200 * 43.5) ELSE 1.0 END"
FRAC = "CASE WHEN step / CAST(20000 AS DOUBLE) >= 1.0 - 0.6 THEN greatest((1.0 - step / CAST(20000 AS DOUBLE)) / 0.6, 0.05) ELSE 1.0 END"
RAMP = "(1 - least(step / CAST(500 AS DOUBLE), 1.0)) * 0.85 + least(step / CAST(500 AS DOUBLE), 1.0) * 0.95"


@register("r7_schedules", f"SELECT step, round(CAST({SCHED} AS DOUBLE), 6) AS by_step, round(CAST({WALL} AS DOUBLE), 6) AS by_clock, round(CAST({FRAC} AS DOUBLE), 6) AS by_share FROM (SELECT unnest(range(0, 20001, 100)) AS step)")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 20001, 100).toDF("step").selectExpr("step", f"round(CAST({SCHED} AS DOUBLE), 6) AS by_step", f"round(CAST({WALL} AS DOUBLE), 6) AS by_clock", f"round(CAST({FRAC} AS DOUBLE), 6) AS by_share")


@register("r8_momentum_ramp", f"SELECT step, round(CAST({RAMP} AS DOUBLE), 6) AS momentum FROM (SELECT unnest(range(0, 1001, 10)) AS step)")
def r8(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 1001, 10).toDF("step").selectExpr("step", f"round(CAST({RAMP} AS DOUBLE), 6) AS momentum")


@register("a7_cap_vote", "SELECT event_id // 1000 AS step, bool_or(value > 90) AS capped, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    """A flag that any rank can raise (A7) and a mean over ranks (A8)."""
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.expr("event_id div 1000").alias("step")).agg(F.bool_or(F.col("value") > 90).alias("capped"), F.round(F.avg("value"), 6).alias("mean"))
