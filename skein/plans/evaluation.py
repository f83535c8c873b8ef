"""Evaluation and sweep queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import metrics
from skein.operators import evaluation as ev
from skein.plans.scalar import ORACLE as _SCALAR
from skein.session import table

C = F.col


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_results(table(spark, d, "query_result"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval runs made from the score table: one per query."""
    p = table(spark, d, "prop_node").filter("prop_score is not null").groupBy("query_id").agg(F.max("prop_score").alias("confidence"), F.count("*").alias("hits"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.max("hop").alias("hop"), F.count_if("is_stub").alias("mentions"))
    source = F.element_at(F.array(F.lit("tier1"), F.lit("tier1+tier2"), F.lit("tier2"), F.lit("miss")), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    r = p.withColumn("source", source)
    return r.withColumn("score", metrics.run_score(C("source"), C("confidence"), C("hits"), C("chars"), C("mentions")))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Methods, and methods by question type, in one pass."""
    s = ev.summarise(_scored(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("method_name", "question_type", "level", "n", "answer_hits", "anchor_hits", r("answer_rate"), r("anchor_rate"), r("mean_f1"), r("mean_len"), r("error_rate"))


def eval_type_table(spark: SparkSession, d: str) -> DataFrame:
    return ev.type_table(_scored(spark, d))


def eval_run_scores(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("query_id", "source", "score")


def eval_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.histogram(_runs(spark, d))


def eval_tier_timing(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_result").filter("latency_ms is not null").select(C("method_name").alias("source"), (C("latency_ms") / 1000).alias("seconds"))
    return ev.tier_timing(q).select("source", "n", "share")


def eval_spread(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).select(C("source").alias("param"), C("hop").cast("double").alias("value"), "score")
    g = r.groupBy("param", "value").agg(F.max("score").alias("score"))
    return ev.spread(g).select("param", "spread", "rank")


def eval_versus_baseline(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).groupBy(C("source").alias("config")).agg(F.round(F.max("score"), 2).alias("score"))
    return ev.versus_baseline(r, "tier1")


def eval_top_bottom(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d).select(C("query_id").cast("string").alias("config"), "score")
    return ev.top_bottom(r)


def eval_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_result").groupBy("question_type").agg(F.count("*").alias("n"))


_NAMES = ("eval_summary", "eval_type_table", "eval_run_scores", "eval_histogram", "eval_tier_timing", "eval_spread", "eval_versus_baseline", "eval_top_bottom", "eval_counts")
QUERIES = {n: globals()[n] for n in _NAMES}
_M = _SCALAR["fn_answer_metrics"].replace("SELECT result_id, round(rc, 6) AS recall", "SELECT method_name, question_type, latency_ms, coalesce(trim(error), '') <> '' AS failed, round(rc, 6) AS recall")
_M = _M.replace("round(CASE WHEN b > 0", "(CASE WHEN b > 0").replace("END::DOUBLE, 6) AS f1", "END::DOUBLE) AS f1")
_TYPES = ", ".join(f"round(avg(answer_hit::INT) FILTER (question_type = '{t}'), 4) AS {t}" for t in ev.QUESTION_TYPES)
_RUNS = """runs AS (SELECT query_id, confidence, hits, chars, hop, mentions, ['tier1', 'tier1+tier2', 'tier2', 'miss'][(query_id % 4 + 1)::INT] AS source FROM (
  SELECT query_id, max(prop_score) AS confidence, count(*) AS hits, sum(length(coalesce(content, ''))) AS chars, max(hop) AS hop, count(*) FILTER (is_stub) AS mentions FROM prop_node WHERE prop_score IS NOT NULL GROUP BY query_id)),
run AS (SELECT *, round(least(100.0::DOUBLE, CASE source WHEN 'tier1+tier2' THEN 45 WHEN 'tier1' THEN 30 WHEN 'tier2' THEN 15 ELSE 0 END + confidence * 20 + least(hits, 5) * 3 + least(chars::DOUBLE / 100, 15) + least(mentions, 5) * 2), 2) AS score FROM runs)"""
ORACLE = {
    "eval_summary": f"""WITH m AS ({_M}) SELECT method_name, question_type, (CASE WHEN grouping(question_type) = 1 THEN 1 ELSE 0 END)::BIGINT AS level, count(*) AS n, count(*) FILTER (answer_hit) AS answer_hits, count(*) FILTER (anchor_hit) AS anchor_hits,
  round(avg(answer_hit::INT), 6) AS answer_rate, round(avg(anchor_hit::INT), 6) AS anchor_rate, round(avg(f1), 6) AS mean_f1, round(avg(context_len), 6) AS mean_len, round(avg(failed::INT), 6) AS error_rate FROM m GROUP BY GROUPING SETS ((method_name), (method_name, question_type))""",
    "eval_type_table": f"WITH m AS ({_M}) SELECT method_name, {_TYPES} FROM m GROUP BY method_name",
    "eval_run_scores": f"WITH {_RUNS} SELECT query_id, source, score FROM run",
    "eval_histogram": f"WITH {_RUNS} SELECT b.bucket::BIGINT AS bucket, count(r.score) AS n FROM range(0, 101, 10) b(bucket) LEFT JOIN run r ON floor(r.score / 10) * 10 = b.bucket GROUP BY b.bucket",
    "eval_tier_timing": "SELECT method_name AS source, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 4) AS share FROM query_result WHERE latency_ms IS NOT NULL GROUP BY method_name",
    "eval_spread": f"WITH {_RUNS}, g AS (SELECT source AS param, hop, max(score) AS score FROM run GROUP BY ALL), s AS (SELECT param, round(max(score) - min(score), 6) AS spread FROM g GROUP BY param) SELECT param, spread, rank() OVER (ORDER BY spread DESC)::INT AS rank FROM s",
    "eval_versus_baseline": f"WITH {_RUNS}, g AS (SELECT source AS config, round(max(score), 2) AS score FROM run GROUP BY source) SELECT config, score, round(score - (SELECT score FROM g WHERE config = 'tier1'), 6) AS delta FROM g",
    "eval_top_bottom": f"""WITH {_RUNS}, r AS (SELECT query_id::VARCHAR AS config, score FROM run), a AS (SELECT config, score, row_number() OVER (ORDER BY score DESC, config) AS t, row_number() OVER (ORDER BY score, config) AS b FROM r)
SELECT config, score, 'top' AS side, t::INT AS rank FROM a WHERE t <= 5 UNION ALL SELECT config, score, 'bottom', b::INT FROM a WHERE b <= 5""",
    "eval_counts": "SELECT question_type, count(*) AS n FROM query_result GROUP BY question_type",
}
