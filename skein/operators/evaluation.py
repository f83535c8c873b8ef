"""Evaluation of retrieval methods and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import metrics

# Question types.
QUESTION_TYPES = "attribute_recall event_participant temporal_causal entity_relationship event_outcome event_location cross_entity".split()


def score_results(results: DataFrame) -> DataFrame:
    """Result rows with recall, F1, hits, context length and error flag.

    Columns read: context, expected_answer, retrieval_anchor, error; null
    contexts count as empty, null or blank errors as none.
    """
    c, a = F.col("context"), F.col("expected_answer")
    return results.withColumns({
        "recall": metrics.token_recall(c, a), "f1": metrics.token_f1(c, a), "answer_hit": metrics.answer_hit(c, a), "anchor_hit": metrics.anchor_hit(c, F.col("retrieval_anchor")),
        "context_len": F.length(F.coalesce(c, F.lit(""))), "failed": F.coalesce(F.trim("error"), F.lit("")) != "",
    })


def summarise(scored: DataFrame) -> DataFrame:
    """Per method and over question types (null type: the whole method), in one pass."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    g = scored.groupingSets([["method_name"], ["method_name", "question_type"]], "method_name", "question_type").agg(
        F.count("*").alias("n"), F.count_if("answer_hit").alias("answer_hits"), F.count_if("anchor_hit").alias("anchor_hits"), rate("answer_hit").alias("answer_rate"), rate("anchor_hit").alias("anchor_rate"),
        F.avg("f1").alias("mean_f1"), F.avg("context_len").alias("mean_len"), F.avg("latency_ms").alias("mean_latency"), rate("failed").alias("error_rate"), F.grouping_id().alias("level"),
    )
    return g.withColumn("composite", metrics.composite(F.col("n"), F.col("answer_rate"), F.col("anchor_rate"), F.col("mean_f1"), F.col("error_rate")))


def type_table(scored: DataFrame) -> DataFrame:
    """Answer-hit rate of each method by question type, as columns."""
    return scored.groupBy("method_name").pivot("question_type", QUESTION_TYPES).agg(F.round(F.avg(F.col("answer_hit").cast("int")), 4))


def spread(runs: DataFrame) -> DataFrame:
    """Per parameter of a sweep (param, value, score): range and best and worst value."""
    g = runs.groupBy("param").agg(F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.max_by("value", F.struct("score", (-F.col("value")).alias("v"))).alias("best_value"), F.min_by("value", F.struct("score", "value")).alias("worst_value"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("spread"))))  # one row per parameter


def histogram(scores: DataFrame, width: int = 10) -> DataFrame:
    """Counts of scores 0 to 100 in buckets, empty ones with 0."""
    spark = scores.sparkSession
    buckets = spark.range(0, 101, width).select(F.col("id").alias("bucket"))
    n = scores.groupBy((F.floor(F.col("score") / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def tier_timing(runs: DataFrame) -> DataFrame:
    """Per source tier: runs, share, and seconds (sum, mean, least, most)."""
    total = Window.partitionBy()
    g = runs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("total_s"), F.round(F.avg("seconds"), 3).alias("mean_s"), F.round(F.min("seconds"), 3).alias("least_s"), F.round(F.max("seconds"), 3).alias("most_s"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 4))  # one row per tier


def top_bottom(runs: DataFrame, n: int = 5) -> DataFrame:
    """The best and worst ``n`` runs with their ranks (config, score)."""
    best = runs.orderBy(F.desc("score"), "config").limit(n).withColumn("side", F.lit("top"))
    worst = runs.orderBy("score", "config").limit(n).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col("score")).otherwise(F.col("score")), "config")))


def versus_baseline(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Runs with the difference to the baseline's score."""
    base = runs.filter(F.col("config") == baseline).agg(F.max("score").alias("_base"))
    return runs.crossJoin(F.broadcast(base)).withColumn("delta", F.round(F.col("score") - F.col("_base"), 6)).drop("_base")  # a one-row aggregate


def bars(counts: DataFrame, key: str, width: int = 40) -> DataFrame:
    """Counts as text bars, for reports."""
    top = counts.agg(F.max("n").alias("_top"))
    share = F.col("n") / F.greatest("_top", F.lit(1))
    return counts.crossJoin(F.broadcast(top)).select(key, F.repeat(F.lit("█"), F.round(share * width).cast("int")).alias("bar"), F.format_string("%.1f%%", share * 100).alias("of_top"))  # a one-row aggregate


def report(rows: list, title: str) -> str:
    """A Markdown table of small aggregated rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    cols = rows[0].__fields__
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows]) + "\n"
