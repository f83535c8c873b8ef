"""Retrieval methods with one contract, and running them over a question set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.functions import hooks, ids
from skein.functions.vectors import embedder
from skein.operators import cascade, entity_graph, graph, grep, segments, traversal, vector
from skein.session import broadcast_if_small, stage

Method = Callable[[DataFrame, cascade.Stores, int], DataFrame]


def _joined(df: DataFrame, text: str = "text") -> DataFrame:
    g = df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("t"))
    return g.select("query_id", F.array_join(F.col(f"t.{text}"), "\n\n").alias("context"))


def dense(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """The k most similar facts."""
    if s.looked is not None and k <= cascade.ANCHORS:
        return _joined(s.looked.facts.filter(F.col("rank") <= k))
    return _joined(vector.search_facts(queries, s.facts, k))


def rag_chunks(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """The k most similar chunks with their rounded scores; facts where the stores have no chunks."""
    chunks = (s.facts if s.chunks is None else s.chunks).select("id", "text", "vec")
    hits = broadcast_if_small(stage(vector.top_k(queries, chunks, k), "hits")).join(chunks.select("id", "text"), "id")
    return _joined(hits.withColumn("text", F.concat(F.format_string("[%d] (%.4f) ", "rank", F.round("score", 4)), "text")))


def graph_prop(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """Decayed propagation from the anchors of each query; ``k`` does not apply."""
    found = cascade.graph_tier(queries, s, RetrievalConfig()) if s.looked is None else s.looked.graph
    return found.select("query_id", F.col("text").alias("context"))


def graph_rag(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """Two directed steps over the entity graph around the most similar entities.

    Without ``arcs`` in the stores, over the adjacency by name.
    """
    named = s.nodes.filter("node_type = 'entity' and name is not null")
    seeds = named.join(s.vectors, "id").groupBy(F.lower("name").alias("id")).agg(F.min_by("vec", "id").alias("vec"))
    n = s.nodes.select("id", "name")
    arcs = s.arcs if s.arcs is not None else s.adjacency.join(n.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst").select("source", "target", F.concat(F.lit("K"), "kind_ord").alias("relation"))
    return entity_graph.contexts(queries, seeds, named.select("name", "node_type", F.col("content").alias("description")), arcs, k)


def filestore(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """Keyword search over the records; ``k`` does not apply."""
    return grep.grep_context(queries, s.records) if s.looked is None else s.looked.records


def tiered(queries: DataFrame, s: cascade.Stores, k: int) -> DataFrame:
    """The cascade; ``k`` does not apply."""
    return cascade.format_context(cascade.retrieve(queries, s).answers)


METHODS: dict[str, Method] = {"dense": dense, "rag_chunks": rag_chunks, "graph_prop": graph_prop, "graph_rag": graph_rag, "filestore": filestore, "cascade": tiered}


#: Methods that read nothing of a query but its vector; their contexts may be long.
BY_VECTOR = ("rag_chunks", "graph_rag")


def run_methods(queries: DataFrame, s: cascade.Stores, k: int = 5, only: list[str] | None = None, show: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """(method_name, query_id, context): every method on every question; empty where it finds nothing.

    ``show`` makes the columns that stand in place of the context.  Methods that read
    only the vector run once for queries of the same vector, and ``show`` with them.
    Each method's rows are written before the next one, so plans stay apart.
    """
    q = stage(queries.select("query_id", "text", "vec"), "queries")
    heads = stage(q.groupBy("vec").agg(F.min("query_id").alias("head"), F.collect_list("query_id").alias("query_ids")), "heads")
    s = replace(s, looked=cascade.Looked(q, s))
    shown = show or (lambda c: [c])
    out = None
    for name in only or list(METHODS):
        one = heads.select(F.col("head").alias("query_id"), F.lit("").alias("text"), "vec") if name in BY_VECTOR else q
        c = one.select("query_id").join(METHODS[name](one, s, k), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        c = stage(c.select("query_id", *shown(F.col("context"))), name)
        if name in BY_VECTOR:
            c = heads.select(F.col("head").alias("query_id"), F.explode("query_ids").alias("asker")).join(c, "query_id").drop("query_id").withColumnRenamed("asker", "query_id")
        c = c.select(F.lit(name).alias("method_name"), "query_id", *[x for x in c.columns if x != "query_id"])
        out = c if out is None else out.unionByName(c)
    return out


def conflicts(texts: DataFrame, facts: DataFrame, judge: Callable[[str], str] = hooks.silent, k: int = 5) -> DataFrame:
    """(query_id, verdict): what a judge says against a text and its nearest facts.

    No verdict where the judge says nothing, NONE, or fails.
    """
    near = vector.search_facts(texts, facts, k).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "text"))).getField("text"), "\n").alias("known"))
    prompts = texts.join(near, "query_id").select(F.col("query_id").alias("id"), F.concat(F.lit("Known:\n"), "known", F.lit("\nNew:\n"), "text", F.lit("\nName contradictions or answer NONE.")).alias("prompt"))
    said = hooks.ask(prompts, judge)
    return said.filter("trim(coalesce(response, '')) not in ('', 'NONE')").select(F.col("id").alias("query_id"), F.col("response").alias("verdict"))


def index_chunks(docs: DataFrame, embed: Callable[[Column], Column] | None = None, source: str = "documents") -> DataFrame:
    """Chunks with deterministic ids and vectors: id, chapter, chunk_idx, source, text, vec."""
    c = segments.chunks(docs)
    return c.select(ids.chunk_id(F.col("doc_id"), F.col("chunk_id"), F.col("text")).alias("id"), F.col("doc_id").alias("chapter"), F.col("chunk_id").alias("chunk_idx"), F.lit(source).alias("source"), "text", (embed or embedder())(F.col("text")).alias("vec"))


def index_entities(ents: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Entity seeds with deterministic ids and vectors, one per lower-case name."""
    t = entity_graph.seed_texts(graph.descriptions(ents), ents)
    return t.select(ids.seed_id(F.col("name")).alias("id"), "key", "name", (embed or embedder())(F.col("text")).alias("vec"))


def spread_of_starts(queries: DataFrame, s: cascade.Stores) -> DataFrame:
    """Graph metrics of each query over all its anchors."""
    starts = cascade.anchor_starts(queries, s, RetrievalConfig())
    return traversal.graph_metrics(traversal.merge_best(traversal.propagate(starts, s.adjacency, s.nodes, s.vectors)))
