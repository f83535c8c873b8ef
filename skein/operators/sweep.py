"""Sweeps over the knobs of the cascade: every query under every configuration, in one job.

What no knob changes is found once per query: similar pathways and facts, entities
by name, records by keyword.  The knobs then are columns.  Every (configuration,
query) has its own starts, which move through the graph together.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.functions import metrics
from skein.operators import cascade, graph, grep, traversal, vector
from skein.session import stage

#: Knobs by what they open or close, each with the direction that opens it.
GROUPS = {
    "entry": {"start_threshold": -1, "confident_threshold": 1, "graph_anchor_threshold": -1, "graph_anchor_max_starts": 1},
    "reach": {"propagation_hop_threshold": -1, "propagation_max_depth": 1, "propagation_max_nodes": 1, "graphrag_seed_threshold": -1},
    "weight": {"propagation_decay": 1, "stub_penalty": 1},
}
KNOBS = [k for g in GROUPS.values() for k in g]
#: Factors on a knob's default, one knob at a time.
FACTORS = (0.25, 0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0)


def _scaled(knob: str, factor: float) -> float:
    """A knob's default times a factor; counts stay whole and at least 1, shares at most 1."""
    base = getattr(RetrievalConfig(), knob)
    return float(max(1, round(base * factor))) if isinstance(base, int) else min(1.0, round(base * factor, 4))


def build_configs(spark: SparkSession) -> DataFrame:
    """(config, param, value, knobs...): the baseline, one knob at a time, groups of knobs together.

    A group is opened or closed by half of each default; every combination of
    opened and closed groups is one configuration.
    """
    base = {k: float(v) for k, v in asdict(RetrievalConfig()).items() if k in KNOBS}
    rows = {"baseline": (None, None, base)}
    for k in KNOBS:
        for f in FACTORS:
            v = _scaled(k, f)
            if v != base[k]:
                rows[f"{k}={v:g}"] = (k, v, base | {k: v})
    for bits in range(2 ** len(GROUPS)):
        way = {g: 1 if bits >> i & 1 else -1 for i, g in enumerate(GROUPS)}
        own = {k: _scaled(k, 1 + 0.5 * way[g] * sign) for g, knobs in GROUPS.items() for k, sign in knobs.items()}
        rows["+".join(f"{g}:{'open' if w > 0 else 'closed'}" for g, w in way.items())] = (None, None, base | own)
    made = [(name, p, v, *[knobs[k] for k in KNOBS]) for name, (p, v, knobs) in rows.items()]
    return spark.createDataFrame(made, "config string, param string, value double, " + ", ".join(f"{k} double" for k in KNOBS))


def coverage(runs: DataFrame) -> DataFrame:
    """One row over the runs of a sweep that reached the graph: nodes on average, at most, at least, and how many runs."""
    return runs.filter("nodes > 0").agg(F.round(F.avg("nodes"), 4).alias("mean_nodes"), F.max("nodes").alias("most_nodes"), F.min("nodes").alias("least_nodes"), F.count("*").alias("n_runs"))


def sweep(queries: DataFrame, s: cascade.Stores, configs: DataFrame) -> DataFrame:
    """(config, query_id, source, confidence, hits, chars, nodes, score) of every query under every configuration.

    ``queries``: query_id, text, vec; a null text finds no names or records.
    ``configs``: as ``build_configs`` makes them, a bounded set.  Rows follow the
    cascade: a confident pathway, confident facts, the graph with or without facts,
    facts alone, records, else a miss.
    """
    q = stage(queries.select("query_id", "text", "vec"), "queries")
    c = F.broadcast(configs)  # as many rows as configurations
    key = ["config", "query_id"]
    every = q.select("query_id").crossJoin(c)  # the queries times a bounded set
    paths = vector.search_pathways(q, s.pathways, cascade.PATHWAYS).select("query_id", "score")
    path = paths.groupBy("query_id").agg(F.max("score").alias("path_best"))
    facts = stage(vector.search_facts(q, s.facts, cascade.ANCHORS).select("query_id", "rank", "score", "text"), "facts")
    own = facts.filter(F.col("rank") <= cascade.FACTS).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "text"))).alias("known"))
    records = grep.grep_context(q, s.records).select("query_id", F.length("context").alias("record_chars"))
    found = every.join(path, "query_id", "left").join(own, "query_id", "left").join(records, "query_id", "left")
    known = F.filter(F.coalesce("known", F.array().cast("array<struct<score:double,text:string>>")), lambda x: x["score"] >= F.col("start_threshold"))
    found = found.withColumn("memory", known).withColumn("best", F.array_max("memory.score"))
    sure_path = F.coalesce(F.col("path_best") >= F.greatest("start_threshold", "confident_threshold"), F.lit(False))
    sure_fact = F.coalesce(F.col("best") >= F.col("confident_threshold"), F.lit(False))
    found = stage(found.withColumn("sure", sure_path | sure_fact).withColumn("sure_path", sure_path), "found")

    # starts of those that are not sure: names first, then what the best facts name
    left = found.filter("not sure")
    by_name = graph.search_entities(q, s.entities).select("query_id", F.col("entity_id").alias("start_id"), F.lit(0).alias("tier"), "rank", F.lit(None).cast("double").alias("score"))
    bare = F.regexp_replace("text", r"^(Entity|Event): ", "")
    named = facts.select("query_id", "rank", "score", F.lower(F.regexp_extract("text", r"^(Entity|Event): ", 1)).alias("node_type"), F.trim(F.split_part(bare, F.lit(" | "), F.lit(1))).alias("name")).filter("node_type <> ''")
    index = s.nodes.groupBy("node_type", "name").agg(F.min("id").alias("start_id"))
    by_fact = named.join(index, ["node_type", "name"]).select("query_id", "start_id", F.lit(1).alias("tier"), "rank", "score")
    anchors = by_name.unionByName(by_fact).join(left.select(*key, "graph_anchor_threshold", "graph_anchor_max_starts"), "query_id")
    anchors = anchors.filter(F.col("score").isNull() | (F.col("score") >= F.col("graph_anchor_threshold")))
    first = anchors.groupBy(*key, "start_id", "graph_anchor_max_starts").agg(F.min(F.struct("tier", "rank")).alias("o"))
    listed = first.groupBy(*key, "graph_anchor_max_starts").agg(F.sort_array(F.collect_list(F.struct("o", "start_id"))).alias("l"))  # names and eight facts of one query
    knobs = [k for k in KNOBS if k.startswith("propagation") or k == "stub_penalty"]
    starts = listed.select(*key, F.explode(F.slice("l", 1, F.col("graph_anchor_max_starts").cast("int"))).alias("a")).join(q.select("query_id", "vec"), "query_id").join(c.select("config", *knobs), "config")
    starts = stage(starts.select(F.struct(*key).alias("query_id"), F.col("a.start_id").alias("start_id"), "vec", *knobs), "starts")
    walked = traversal.merge_best(traversal.propagate(starts, s.adjacency, s.nodes, s.vectors))
    text = cascade.format_nodes(walked).select("query_id", F.col("confidence").alias("graph_best"), F.length("text").alias("graph_chars"))
    nodes = walked.groupBy("query_id").agg(F.count("*").alias("nodes")).join(text, "query_id").select("query_id.*", "nodes", "graph_best", "graph_chars")

    full = found.join(nodes, key, "left")
    by_graph, by_facts = F.col("nodes").isNotNull(), F.col("best").isNotNull()
    source = F.when(F.col("sure") | (by_facts & ~by_graph), "tier1").when(by_graph & by_facts, "tier1+tier2").when(by_graph | F.col("record_chars").isNotNull(), "tier2").otherwise("miss")
    confidence = F.when(F.col("sure_path"), F.col("path_best")).otherwise(F.coalesce("best", "graph_best", F.lit(0.0)))
    memory_chars = F.aggregate("memory", F.lit(0), lambda n, x: n + F.length(x["text"]))
    only_records = ~F.col("sure") & ~by_graph & ~by_facts
    hits = F.when(only_records, F.col("record_chars").isNotNull().cast("int")).otherwise(F.size("memory") + by_graph.cast("int") + F.col("sure_path").cast("int"))
    chars = F.when(only_records, F.coalesce("record_chars", F.lit(0))).otherwise(memory_chars + F.coalesce("graph_chars", F.lit(0)))
    out = full.select(*key, source.alias("source"), confidence.alias("confidence"), hits.alias("hits"), chars.alias("chars"), F.coalesce("nodes", F.lit(0)).alias("nodes"))
    return out.withColumn("score", metrics.run_score(F.col("source"), F.col("confidence"), F.col("hits"), F.col("chars"), F.lit(0)))
