"""From documents to the graph: segments, events, links and the next tables.

The whole batch of documents is one job; names are linked against the tables as
they were before the batch, and new names are unified by name when they are
written, so a name that recurs in a batch counts its mentions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import ids
from skein.functions.text import normalize_name
from skein.operators import annotate, graph, linking, segments, upsert
from skein.session import stage


@dataclass
class Graph:
    """The tables of the graph; ``properties`` are attribute rows by entity name."""

    documents: DataFrame
    entities: DataFrame
    events: DataFrame
    edges: DataFrame
    properties: DataFrame


EVENTS = "id string, document_id bigint, segment_id int, temporal_order bigint, title string, action string, outcome string, summary string, source_text string, participants array<string>, locations array<string>"
ENTITIES = "id string, name string, entity_type string, aliases array<string>, is_stub boolean, confidence double, source_count bigint, first_seen date, last_updated date"
PROPERTIES = "name string, properties map<string,string>"


def empty_graph(spark: SparkSession) -> Graph:
    make = lambda s: spark.createDataFrame([], s)
    return Graph(make(upsert.DOCUMENT_SCHEMA), make(ENTITIES), make(EVENTS), make(upsert.EDGE_SCHEMA), make(PROPERTIES))


def create_tables(g: Graph, prefix: str = "") -> None:
    """Register the tables for SQL as temporary views."""
    for name in ("documents", "entities", "events", "edges", "properties"):
        getattr(g, name).createOrReplaceTempView(f"{prefix}{name}")


def ingest(docs: DataFrame, g: Graph, today: Column | None = None, mode: str = "paragraph", tokens: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The next graph and the resolutions made, from documents (doc_id, title, text, source, date).

    ``tokens`` replaces the rule-based annotator's.  Ids depend on content and
    place, so a document that comes again adds nothing to events and edges; null
    texts give no segments.
    """
    today = F.current_date() if today is None else today
    documents = upsert.insert_absent(g.documents, docs.select(F.col("doc_id").alias("id"), "title", F.coalesce("date", today).alias("date"), "source"), "id")
    tok = stage(annotate.annotate(segments.segment(docs, mode)) if tokens is None else tokens, "tokens")
    raw = annotate.extract_events(tok).select(F.col("doc_id"), F.col("seg_id").alias("segment_id"), F.col("sent_id").alias("pos"), "title", "action", "outcome", "summary", "source_text", "participants", "locations")
    ordered = linking.temporal_order(raw)
    tidy = lambda c: F.array_distinct(F.filter(F.transform(c, normalize_name), lambda x: x != ""))
    events = ordered.select(ids.event_id(F.col("title"), F.col("doc_id"), F.col("temporal_order")).alias("id"), F.col("doc_id").alias("document_id"), "segment_id", "temporal_order", "title", "action", "outcome", "summary", "source_text", tidy("participants").alias("participants"), tidy("locations").alias("locations"))
    events = stage(events.join(g.events.select("id"), "id", "left_anti"), "events")
    mentions = events.select(F.explode("participants").alias("name"), F.lit("person").alias("entity_type")).unionByName(events.select(F.explode("locations").alias("name"), F.lit("location").alias("entity_type")))
    known = g.entities.select("id", "name", "aliases", "is_stub")
    resolved = stage(linking.resolve_names(mentions.select("name"), known), "resolved")
    props = annotate.extract_properties(tok).select(F.col("entity").alias("name"), "attribute", "value", F.concat_ws(":", "doc_id", "seg_id").alias("seq"))
    fresh = mentions.join(resolved.filter("node_id is null").select(F.col("input_name").alias("name")), "name", "left_semi").unionByName(props.select("name", F.lit("unknown").alias("entity_type")))
    entities = stage(upsert.upsert_entities(g.entities, fresh, today), "entities")
    name_id = entities.groupBy("name").agg(F.min("id").alias("new_id")).join(resolved.select(F.col("input_name").alias("name"), "node_id"), "name", "full_outer").select("name", F.coalesce("node_id", "new_id").alias("entity_id")).filter("entity_id is not null")
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    who = events.select("id", F.explode("participants").alias("name")).join(name_id, "name").select(F.col("entity_id").alias("src"), F.col("id").alias("dst"), F.lit("PARTICIPANT_IN").alias("kind"), F.lit("").alias("role"), none_n.alias("specificity"))
    where = events.select("id", F.posexplode("locations").alias("pos", "name")).join(name_id, "name").select(F.col("id").alias("src"), F.col("entity_id").alias("dst"), F.lit("LOCATED_AT").alias("kind"), none_s.alias("role"), F.col("pos").cast("bigint").alias("specificity"))
    within = graph.precedes(events)
    across = linking.link_across(events, g.events)
    links = within.unionByName(across).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("PRECEDES").alias("kind"), none_s.alias("role"), none_n.alias("specificity"))
    all_events = g.events.unionByName(events)
    nodes = entities.select("id").unionByName(all_events.select("id"))
    edges = upsert.add_edges(g.edges, who.unionByName(where).unionByName(links), nodes)
    return Graph(documents, entities, all_events, edges, upsert.merge_properties(g.properties, props)), resolved


def summary(before: Graph, after: Graph, resolved: DataFrame) -> DataFrame:
    """One row of counts of an ingest run."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(after.documents, "documents")
    for df, name in ((after.events, "events"), (before.events, "events_before"), (after.entities, "entities"), (after.edges, "edges"), (resolved.filter("is_ambiguous"), "ambiguous")):
        out = out.crossJoin(F.broadcast(count(df, name)))  # one-row aggregates
    return out
