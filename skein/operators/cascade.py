"""The tiered cascade: pathways, facts, graph, records; for a batch of queries.

Every tier is a frame keyed by query; queries answered by a tier are taken out
with an anti-join before the next.  Nothing is written: new pathways and facts
are returned beside the answers, and applying them is up to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.operators import graph, grep, traversal, vector
from skein.session import broadcast_if_small, stage

#: Facts asked for as answers and as anchors; nodes kept of pathways.
FACTS, ANCHORS, PATHWAYS, PATH_NODES, STORED_NODES, STORED_WORDS = 5, 8, 5, 15, 10, 12


@dataclass
class Stores:
    """What the cascade and the methods search: frames as the graph and vector modules make them.

    ``arcs``: source, target, relation of the entity graph, by name.
    ``chunks``: id, text, vec of the pieces of whole documents.
    ``looked``: what several methods look up alike for the same queries.
    """

    nodes: DataFrame
    adjacency: DataFrame
    entities: DataFrame
    vectors: DataFrame
    facts: DataFrame
    pathways: DataFrame
    records: DataFrame
    arcs: DataFrame | None = None
    chunks: DataFrame | None = None
    looked: Looked | None = None


class Looked:
    """Nearest facts, graph answers and record texts of a batch of queries, each looked up once when first asked for.

    A query's rows do not depend on the other queries, so those of a part of the
    batch are the rows of its queries.
    """

    def __init__(self, queries: DataFrame, s: Stores, config: RetrievalConfig = RetrievalConfig()) -> None:
        self.queries, self.stores, self.config = queries, s, config

    @cached_property
    def facts(self) -> DataFrame:
        """The ``ANCHORS`` most similar facts, whatever their score."""
        return stage(vector.search_facts(self.queries, self.stores.facts, ANCHORS), "facts")

    @cached_property
    def graph(self) -> DataFrame:
        return stage(graph_tier(self.queries, self.stores, self.config, self.facts), "graph")

    @cached_property
    def records(self) -> DataFrame:
        return stage(grep.grep_context(self.queries, self.stores.records), "grep")


@dataclass
class Answers:
    """``answers``: query_id, source, confidence, hits, reconsolidated."""

    answers: DataFrame
    new_pathways: DataFrame
    new_facts: DataFrame


def pathway_tier(queries: DataFrame, pathways: DataFrame, nodes: DataFrame, c: RetrievalConfig) -> DataFrame:
    """(query_id, confidence, hits): contents of the nodes of the best pathways.

    Node ids in order of score and position, each once, the first 15; the
    confidence is the best score.  Pathways below the start threshold do not count.
    """
    found = vector.search_pathways(queries, pathways, PATHWAYS).filter(F.col("score") >= c.start_threshold)
    ids = found.select("query_id", "score", "rank", F.posexplode("pathway").alias("pos", "id"))
    first = ids.groupBy("query_id", "id").agg(F.min(F.struct("rank", "pos")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o")
    top = stage(first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PATH_NODES), "top")
    texts = broadcast_if_small(top, 8 << 20).join(nodes.select("id", "content"), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "content"))).alias("t"))
    best = found.groupBy("query_id").agg(F.max("score").alias("confidence"))
    return texts.join(best, "query_id").select("query_id", "confidence", F.col("t.content").alias("hits"))


def anchor_starts(queries: DataFrame, s: Stores, c: RetrievalConfig, near: DataFrame | None = None) -> DataFrame:
    """(query_id, start_id, vec): at most three start nodes of each query.

    First entities whose name holds all words of the query, then the entities or
    events that the best facts name in their prefix, in order, each once.
    ``near``: the ``ANCHORS`` best facts where they are known already.
    """
    by_name = graph.search_entities(queries, s.entities).select("query_id", F.col("entity_id").alias("start_id"), F.lit(0).alias("tier"), F.col("rank"))
    near = vector.search_facts(queries, s.facts, ANCHORS) if near is None else near
    facts = near.filter(F.col("score") >= c.graph_anchor_threshold)
    named = facts.select("query_id", "rank", F.regexp_extract("text", r"^(Entity|Event): ", 1).alias("kind"), F.trim(F.split_part(F.regexp_replace("text", r"^(Entity|Event): ", ""), F.lit(" | "), F.lit(1))).alias("name"))
    index = s.nodes.groupBy("node_type", "name").agg(F.min("id").alias("start_id"))
    by_fact = named.filter("kind <> ''").withColumn("node_type", F.lower("kind")).join(index, ["node_type", "name"]).select("query_id", "start_id", F.lit(1).alias("tier"), "rank")
    first = by_name.unionByName(by_fact).groupBy("query_id", "start_id").agg(F.min(F.struct("tier", "rank")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o", "start_id")
    top = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= c.graph_anchor_max_starts)
    return top.select("query_id", "start_id").join(queries.select("query_id", "vec"), "query_id")


def format_nodes(merged: DataFrame) -> DataFrame:
    """(query_id, confidence, text, pathway): nodes by score as one text block."""
    line = F.concat(F.format_string("[hop %d | %s | score %.2f] ", "hop", "node_type", "prop_score"), F.coalesce("name", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, 200))
    g = merged.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("prop_score")).alias("s"), "hop", "ord", "node_id", line.alias("line")))).alias("n"))
    return g.select("query_id", (-F.element_at("n", 1)["s"]).alias("confidence"), F.array_join(F.col("n.line"), "\n\n").alias("text"), F.slice(F.col("n.node_id"), 1, STORED_NODES).alias("pathway"))


def graph_tier(queries: DataFrame, s: Stores, c: RetrievalConfig, near: DataFrame | None = None) -> DataFrame:
    starts = stage(anchor_starts(queries, s, c, near), "starts")
    return format_nodes(traversal.merge_best(traversal.propagate(starts, s.adjacency, s.nodes, s.vectors, c)))


def retrieve(queries: DataFrame, s: Stores, config: RetrievalConfig = RetrievalConfig(), deep_search: bool = False) -> Answers:
    """Answer queries (query_id, text, vec) tier by tier.

    A pathway answers if it is confident; so do facts.  Otherwise the graph is
    tried for every query: with facts beside it the answer is ``tier1+tier2`` with
    the graph's text first and the facts' confidence, else ``tier2``.  Facts alone
    are ``tier1``.  Records found by keyword are ``tier2`` with confidence 0 and
    are returned as new facts.  The rest is ``miss``.  ``deep_search`` skips the
    confident ends.
    """
    c = config
    q = stage(queries.select("query_id", "text", "vec"), "queries")
    none = F.lit(None).cast("string")
    known = s.looked if s.looked is not None and s.looked.config == c else None
    near = known.facts.filter(F.col("rank") <= FACTS) if known else vector.search_facts(q, s.facts, FACTS)
    facts = near.filter(F.col("score") >= c.start_threshold)
    memory = facts.groupBy("query_id").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("m")).select("query_id", "best", F.col("m.text").alias("memories"))
    memory = stage(memory, "memory")
    done = None
    if not deep_search:
        path = pathway_tier(q, s.pathways, s.nodes, c).filter(F.col("confidence") >= c.confident_threshold).select("query_id", F.lit("tier1").alias("source"), "confidence", "hits")
        path = stage(path, "path")
        sure = memory.join(path, "query_id", "left_anti").filter(F.col("best") >= c.confident_threshold).select("query_id", F.lit("tier1").alias("source"), F.col("best").alias("confidence"), F.col("memories").alias("hits"))
        done = stage(path.unionByName(sure), "sure")
    left = q.join(done, "query_id", "left_anti") if done is not None else q
    left = stage(left, "left")
    found = known.graph.join(left.select("query_id"), "query_id", "left_semi") if known else stage(graph_tier(left, s, c), "graph")
    with_graph = found.join(memory, "query_id", "left").select(
        "query_id", F.when(F.col("best").isNotNull(), "tier1+tier2").otherwise("tier2").alias("source"), F.coalesce("best", "confidence").alias("confidence"), F.concat(F.array("text"), F.coalesce("memories", F.array().cast("array<string>"))).alias("hits")
    )
    only = memory.join(left, "query_id", "left_semi").join(found, "query_id", "left_anti").select("query_id", F.lit("tier1").alias("source"), F.col("best").alias("confidence"), F.col("memories").alias("hits"))
    rest = left.join(found, "query_id", "left_anti").join(memory, "query_id", "left_anti")
    texts = known.records.join(rest.select("query_id"), "query_id", "left_semi") if known else stage(grep.grep_context(rest, s.records), "grep")
    by_file = texts.select("query_id", F.lit("tier2").alias("source"), F.lit(0.0).alias("confidence"), F.array("context").alias("hits"))
    parts = with_graph.unionByName(only).unionByName(by_file)
    answered = parts if done is None else done.unionByName(parts)
    all_rows = q.select("query_id").join(answered, "query_id", "left").join(texts.select("query_id", F.lit(True).alias("reconsolidated")), "query_id", "left").select(
        "query_id", F.coalesce("source", F.lit("miss")).alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"), F.coalesce("reconsolidated", F.lit(False)).alias("reconsolidated")
    )
    words = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""), 1, STORED_WORDS)
    paths = found.select("query_id", "pathway").join(left.select("query_id", F.array_join(words, " ").alias("key_terms"), "vec"), "query_id").select("key_terms", "pathway", "vec")
    new_facts = texts.join(left.select("query_id", "vec"), "query_id").select(F.col("context").alias("text"), "vec")
    return Answers(all_rows.withColumn("confidence", F.col("confidence").cast("double")), paths, new_facts)


def format_context(answers: DataFrame) -> DataFrame:
    """(query_id, context): hits as a numbered block for a prompt."""
    lines = F.transform("hits", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return answers.select("query_id", F.array_join(lines, "\n\n").alias("context"))


def web_tier(spark):
    """The web tier has no source; it gives no rows of (title, url, snippet)."""
    return spark.createDataFrame([], "title string, url string, snippet string")
