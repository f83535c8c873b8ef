"""What retrieval remembers: facts, pathways and records, written by ingest and by answers.

As everywhere, current tables and new rows give the next tables.  Ids depend on
content, so writing again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import hooks, text
from skein.functions.ids import fact_id, pathway_id
from skein.functions.vectors import embedder
from skein.operators import cascade, graph, upsert
from skein.operators.pipeline import Graph
from skein.sources import books

FACTS = "id string, text string, seq string, user_id string, pathway array<string>, vec array<float>"
PATHWAYS = "id string, key_terms string, pathway array<string>, seq string, vec array<float>"
RECORDS = "type string, name string, content string"
USER = "app_user"


@dataclass
class Memory:
    """Facts, pathways and records as tables."""

    facts: DataFrame
    pathways: DataFrame
    records: DataFrame


def empty_memory(spark: SparkSession) -> Memory:
    make = lambda s: spark.createDataFrame([], s)
    return Memory(make(FACTS), make(PATHWAYS), make(RECORDS))


def embedded(df: DataFrame, column: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``vec``: every distinct text of a column is embedded once."""
    once = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("vec", (embed or embedder())(F.col(column)))
    return df.join(once, column, "left")


def event_pathways(events: DataFrame, first: DataFrame) -> DataFrame:
    """(key_terms, pathway, seq): each angle on an event leads to it and its first participants.

    ``first``: event_id, entity_ids, as ``graph.first_participants`` gives them.
    """
    v = text.event_variants(*[F.col(c) for c in ("participants", "action", "outcome", "locations", "title", "summary")])
    terms = events.select("id", F.explode(v).alias("v")).select("id", "v.variant", F.col("v.terms").alias("key_terms"))
    path = F.concat(F.array("id"), F.coalesce("entity_ids", F.array().cast("array<string>")))
    return terms.join(first, terms["id"] == first["event_id"], "left").select("key_terms", path.alias("pathway"), F.concat("id", F.lit(":"), "variant").alias("seq"))


def entity_pathways(ents: DataFrame) -> DataFrame:
    """(key_terms, pathway, seq): name with type, name with properties and each alias lead to the entity."""
    v = text.entity_variants(F.col("name"), F.col("node_type"), F.col("properties"), F.col("aliases"))
    terms = ents.select("id", F.explode(v).alias("v"))
    return terms.select(F.col("v.terms").alias("key_terms"), F.array("id").alias("pathway"), F.concat("id", F.lit(":"), "v.variant").alias("seq"))


def latest_pathways(pathways: DataFrame) -> DataFrame:
    """(id, key_terms, pathway, seq): one per id, the last by ``seq``."""
    return pathways.withColumn("id", pathway_id(F.col("key_terms"))).groupBy("id").agg(F.max_by(F.struct("key_terms", "pathway", "seq"), "seq").alias("r")).select("id", "r.*")


def graph_entities(g: Graph) -> DataFrame:
    """The entities of an ingested graph in the form of the graph operators, with their properties."""
    none = F.create_map().cast("map<string,string>")
    return g.entities.join(g.properties, "name", "left").select("id", "name", F.col("entity_type").alias("node_type"), "aliases", "is_stub", "confidence", "source_count", "first_seen", "last_updated", F.coalesce("properties", none).alias("properties"))


def remember(m: Memory, before: Graph, after: Graph, day: Column | None = None, embed: Callable[[Column], Column] | None = None, consolidate: Callable[[str], str] | None = None, force: bool = False) -> Memory:
    """The memory after an ingest: of its new events, and of entities that are new or changed.

    Facts name an event or entity in their prefix; ``consolidate`` may rewrite a
    fact (NONE or a failure keeps it).  Pathways lead to events and entities,
    records get one dated line per participant of a new event.  ``force`` writes
    all events again, as for one whose text was corrected.
    """
    day = F.current_date() if day is None else day
    events = after.events if force else after.events.join(before.events.select("id"), "id", "left_anti")
    ents, old = graph_entities(after), graph_entities(before)
    same = ["id", "name", "node_type", "source_count"]
    changed = ents.join(old.select(*same), same, "left_anti")
    said = F.concat(F.lit("Event: "), "title", F.lit(" | "), F.coalesce("summary", F.lit("")))
    known = F.concat(F.lit("Entity: "), "name", F.lit(" | Type: "), F.coalesce("node_type", F.lit("")))
    facts = events.filter("title is not null").select(said.alias("text"), F.col("id").alias("seq")).unionByName(changed.filter("name is not null").select(known.alias("text"), F.col("id").alias("seq")))
    if consolidate is not None:
        told = hooks.ask(facts.select(F.col("text").alias("id"), F.col("text").alias("prompt")).distinct(), consolidate)
        facts = facts.join(told.withColumnRenamed("id", "text"), "text", "left").select(F.when(F.coalesce("response", F.lit("NONE")) == "NONE", F.col("text")).otherwise(F.col("response")).alias("text"), "seq")
    facts = facts.withColumns({"user_id": F.lit(USER), "pathway": F.array().cast("array<string>")})
    paths = event_pathways(events, graph.first_participants(after.edges)).unionByName(entity_pathways(changed))
    line = events.select(F.explode("participants").alias("name"), F.coalesce("summary", "title").alias("fact")).filter("fact is not null").distinct()
    kind = ents.groupBy("name").agg(F.min("node_type").alias("type"))
    entries = upsert.record_entries(line.join(kind, "name").select(F.coalesce("type", F.lit("unknown")).alias("type"), "name", day.alias("date"), "fact"))
    return Memory(upsert.store_facts(m.facts, embedded(facts, "text", embed)), upsert.store_pathways(m.pathways, embedded(paths, "key_terms", embed)), books.update_records(m.records, entries))


def write_back(m: Memory, answers: cascade.Answers, seq: str) -> Memory:
    """The memory after a batch of answers: their new pathways and facts are stored.

    ``seq`` orders the batches: the last of one id wins.
    """
    vec = F.col("vec").cast("array<float>").alias("vec")
    paths = answers.new_pathways.select("key_terms", "pathway", F.lit(seq).alias("seq"), vec)
    facts = answers.new_facts.select("text", F.lit(seq).alias("seq"), F.lit(USER).alias("user_id"), F.array().cast("array<string>").alias("pathway"), vec)
    return Memory(upsert.store_facts(m.facts, facts), upsert.store_pathways(m.pathways, paths), m.records)


def forget_spilled(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Facts without the rows that bear the pathway id of an angle on one of the events."""
    none = events.sparkSession.createDataFrame([], "event_id string, entity_ids array<string>")
    return upsert.delete_ids(facts, latest_pathways(event_pathways(events, none)))


def stores(g: Graph, m: Memory, embed: Callable[[Column], Column] | None = None) -> cascade.Stores:
    """What the cascade searches, from an ingested graph and its memory."""
    ents = graph_entities(g)
    nodes = graph.nodes(ents, g.events)
    vectors = embedded(nodes.select("id", "name"), "name", embed).select("id", "vec")
    records = m.records.select(F.replace("name", F.lit(" "), F.lit("_")).alias("stem"), "content")
    return cascade.Stores(nodes, graph.adjacency(g.edges), ents, vectors, m.facts.select("id", "text", "user_id", "pathway", "vec"), m.pathways.select("id", "pathway", "vec"), records)


def fact_ids(texts: DataFrame) -> DataFrame:
    """(id, text): the ids under which facts are stored."""
    return texts.select(fact_id(F.col("text")).alias("id"), "text")
