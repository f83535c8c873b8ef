"""Keyword search over text records, for batches of queries.

Records are cut into their distinct runs of letters: the keyword of a query that the
fewest records can hold drives the join, so queries are not compared with every
record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import trim_all
from skein.session import broadcast_if_small, stage

#: Lines shown of one record; letters by which a keyword is looked up in runs of letters.
LINES, HEAD = 10, 4


def keywords(query: Column) -> Column:
    """Runs of four small letters or more of a lower-cased query, without repeats."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z]{4,}"), F.lit(0)))


def grep(queries: DataFrame, records: DataFrame, lines: int = LINES) -> DataFrame:
    """(query_id, stem, block): records holding all keywords as substrings.

    ``queries``: query_id, text; ``records``: stem, content.  The block is the
    record's first ``lines`` lines with any keyword under ``[stem]``.  Queries
    without keywords match nothing; null texts count as empty.

    A keyword has small letters only, so it lies within one run of these in a
    record.  Which runs hold which keywords is found on the distinct runs of all
    records; a query then looks only at the records that hold its rarest keyword,
    and these are verified on the whole text.
    """
    q = queries.select("query_id", keywords(F.coalesce("text", F.lit(""))).alias("words")).filter(F.size("words") > 0)
    q = stage(q, "asked")
    r = records.select("stem", F.coalesce("content", F.lit("")).alias("content")).withColumn("low", F.lower("content"))
    held = r.select("stem", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z]{4,}"), F.lit(0)))).alias("run"))
    runs = stage(held.groupBy("run").agg(F.count("*").alias("n")), "runs")
    words = q.select(F.explode("words").alias("word")).distinct()
    # a run is cut into all its parts of HEAD letters, and a keyword looks among the runs that have its first ones
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - (HEAD - 1)), lambda i: F.substr("run", i, F.lit(HEAD))))
    within = runs.withColumn("part", F.explode(parts)).join(words.withColumn("part", F.substring("word", 1, HEAD)).hint("merge"), "part")
    within = stage(within.filter(F.contains("run", F.col("word"))).select("word", "run", "n"), "within")
    often = within.groupBy("word").agg(F.sum("n").alias("n"))
    known = q.select("query_id", "words", F.explode("words").alias("word")).join(often, "word").groupBy("query_id", "words").agg(F.count("*").alias("known"), F.min(F.struct("n", "word")).alias("b"))
    probe = stage(known.filter(F.col("known") == F.size("words")).select("query_id", "words", F.col("b.word").alias("word")), "probe")
    wanted = stage(within.join(probe.select("word").distinct(), "word", "left_semi").select("run", "word"), "wanted")
    near = held.join(broadcast_if_small(wanted), "run").select("stem", "word").distinct()
    pairs = stage(near.join(broadcast_if_small(probe.select("query_id", "word")), "word").select("query_id", "stem"), "near")
    cand = broadcast_if_small(pairs, 8 << 20).join(r, "stem").join(broadcast_if_small(probe.select("query_id", "words")), "query_id")
    hit = cand.filter(F.forall("words", lambda w: F.contains(F.col("low"), w)))
    shown = F.slice(F.filter(F.split("content", r"\R"), lambda x: F.exists("words", lambda w: F.contains(F.lower(x), w))), 1, lines)
    return hit.select("query_id", "stem", F.concat(F.lit("["), F.col("stem").cast("string"), F.lit("]\n"), F.array_join(F.transform(shown, trim_all), "\n")).alias("block"))


def grep_context(queries: DataFrame, records: DataFrame, lines: int = LINES) -> DataFrame:
    """(query_id, context): a query's blocks by stem, joined by blank lines."""
    g = grep(queries, records, lines).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("stem", "block"))).alias("b"))
    return g.select("query_id", F.array_join(F.col("b.block"), "\n\n").alias("context"))


def best_records(queries: DataFrame, records: DataFrame, most: int = 10, lines: int = LINES) -> DataFrame:
    """At most ``most`` records of each query, by stem."""
    w = Window.partitionBy("query_id").orderBy("stem")
    return grep(queries, records, lines).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
