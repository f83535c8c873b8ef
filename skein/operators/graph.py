"""The property graph as node and edge frames, and its queries.

Nodes come from the entity and event tables, edges from their arrays.  Edges are
a set of (src, dst, kind); both ends must exist.  Wherever a store would answer
in its own order, the smallest id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import blank_to_null, properties_map
from skein.operators.references import clean_key
from skein.session import stage

#: Order of neighbour kinds around an event: participants, places, then events.
KIND_ORDER = {"entity_event": 0, "participant": 1, "location": 2, "precedes_in": 3, "precedes_out": 4, "causes_in": 5, "causes_out": 6}


def entities(raw: DataFrame) -> DataFrame:
    """Entity nodes with defaults: null aliases [], confidence 0.5, sources 1."""
    return raw.filter("id is not null").dropDuplicates(["id"]).select(
        "id", "name", F.col("entity_type").alias("node_type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("is_stub", F.lit(False)).alias("is_stub"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("source_count", F.lit(1)).alias("source_count"), "first_seen", "last_updated", properties_map(F.col("properties")).alias("properties"),
    )


def events(raw: DataFrame) -> DataFrame:
    """Event nodes, one per id, null arrays empty."""
    return whole_events(raw.filter("id is not null").dropDuplicates(["id"]))


def whole_events(e: DataFrame) -> DataFrame:
    """Events of distinct ids with null arrays empty."""
    none = F.array().cast("array<string>")
    return e.withColumns({c: F.coalesce(F.col(c), none) for c in ("participants", "locations", "caused_by", "leads_to")})


def name_index(ents: DataFrame) -> DataFrame:
    """(name, entity_id): the smallest id of each exact name."""
    return ents.filter("name is not null").groupBy("name").agg(F.min("id").alias("entity_id"))


def entity_content(name: Column, kind: Column, props: Column) -> Column:
    """``name (type): k: v, ...`` or without properties ``name (type)``."""
    head = F.concat(F.coalesce(name, F.lit("")), F.lit(" ("), F.coalesce(kind, F.lit("")), F.lit(")"))
    pairs = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")
    return F.when(F.size(props) > 0, F.concat(head, F.lit(": "), pairs)).otherwise(head)


def nodes(ents: DataFrame, evs: DataFrame) -> DataFrame:
    """(id, node_type, name, content, is_stub): entities and events; an event wins an id clash."""
    e = ents.select("id", F.lit("entity").alias("node_type"), "name", entity_content(F.col("name"), F.col("node_type"), F.col("properties")).alias("content"), "is_stub", F.lit(1).alias("_o"))
    v = evs.select("id", F.lit("event").alias("node_type"), F.col("title").alias("name"), F.coalesce(blank_to_null(F.col("source_text")), blank_to_null(F.col("summary")), F.col("title")).alias("content"), F.lit(False).alias("is_stub"), F.lit(0).alias("_o"))
    both = e.unionByName(v)
    return both.groupBy("id").agg(F.min_by(F.struct("node_type", "name", "content", "is_stub"), "_o").alias("n")).select("id", "n.*")


def edges(ents: DataFrame, evs: DataFrame) -> DataFrame:
    """(src, dst, kind, specificity): distinct edges whose ends exist.

    PARTICIPANT_IN entity to event, LOCATED_AT event to entity with its first
    position, CAUSES and PRECEDES event to event.
    """
    idx = name_index(ents)
    who = evs.select("id", F.explode("participants").alias("name")).join(idx, "name").select(F.col("entity_id").alias("src"), F.col("id").alias("dst"), F.lit("PARTICIPANT_IN").alias("kind"), F.lit(None).cast("int").alias("specificity"))
    where = evs.select("id", F.posexplode("locations").alias("pos", "name")).join(idx, "name").groupBy("id", "entity_id").agg(F.min("pos").alias("specificity"))
    where = where.select(F.col("id").alias("src"), F.col("entity_id").alias("dst"), F.lit("LOCATED_AT").alias("kind"), "specificity")
    into = evs.select("id", F.explode("caused_by").alias("k")).select(clean_key(F.col("k")).alias("src"), F.col("id").alias("dst"))
    out = evs.select("id", F.explode("leads_to").alias("k")).select(F.col("id").alias("src"), clean_key(F.col("k")).alias("dst"))
    known = evs.select("id")
    causes = into.join(known, into.src == known.id, "left_semi").unionByName(out.join(known, out.dst == known.id, "left_semi")).filter("src is not null and dst is not null")
    causes = causes.select("src", "dst", F.lit("CAUSES").alias("kind"), F.lit(None).cast("int").alias("specificity"))
    before = precedes(evs).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("PRECEDES").alias("kind"), F.lit(None).cast("int").alias("specificity"))
    return who.distinct().unionByName(where).unionByName(causes.distinct()).unionByName(before)


def precedes(evs: DataFrame) -> DataFrame:
    """(from_id, to_id): per document and participant each event to the next one.

    The order is temporal_order, then id.  Null documents link nothing.
    """
    w = Window.partitionBy("document_id", "name").orderBy(F.col("temporal_order").asc_nulls_first(), "id")
    one = evs.filter("document_id is not null").select("document_id", "id", "temporal_order", F.explode(F.array_distinct("participants")).alias("name")).filter("name is not null")
    return one.withColumn("from_id", F.lag("id").over(w)).filter("from_id is not null and from_id <> id").select("from_id", F.col("id").alias("to_id")).distinct()


def adjacency(edge: DataFrame) -> DataFrame:
    """(src, dst, kind_ord): who is a neighbour of whom.

    Entities lead to their events only; events to participants, places and, both
    ways, to events before and after, causing and caused.
    """
    def pick(kind: str, a: str, b: str, order: str) -> DataFrame:
        return edge.filter(F.col("kind") == kind).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(KIND_ORDER[order]).alias("kind_ord"))

    parts = [
        pick("PARTICIPANT_IN", "src", "dst", "entity_event"), pick("PARTICIPANT_IN", "dst", "src", "participant"), pick("LOCATED_AT", "src", "dst", "location"),
        pick("PRECEDES", "dst", "src", "precedes_in"), pick("PRECEDES", "src", "dst", "precedes_out"), pick("CAUSES", "dst", "src", "causes_in"), pick("CAUSES", "src", "dst", "causes_out"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbours(ids: DataFrame, adj: DataFrame, node: DataFrame) -> DataFrame:
    """(id, neighbour_id, kind_ord, node_type, name, content) of the given ids."""
    n = node.withColumnRenamed("id", "dst")
    return ids.select(F.col("id").alias("src")).distinct().join(adj, "src").join(n, "dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour_id"), "kind_ord", "node_type", "name", "content")


def fetch_nodes(ids: DataFrame, node: DataFrame) -> DataFrame:
    """Nodes of ``ids`` (key, node_ids array) in input order, repeats kept, unknown skipped."""
    want = ids.select("key", F.posexplode("node_ids").alias("pos", "id"))
    return want.join(node, "id").select("key", "pos", "id", "node_type", "name", "content")


def by_name(names: DataFrame, ents: DataFrame) -> DataFrame:
    """Entity of each exact name, case counts; smallest id among equals."""
    return names.select("name").distinct().join(name_index(ents), "name")


def by_alias(names: DataFrame, ents: DataFrame) -> DataFrame:
    """Entity of each exact alias; smallest id among equals."""
    a = ents.select("id", F.explode("aliases").alias("name")).groupBy("name").agg(F.min("id").alias("entity_id"))
    return names.select("name").distinct().join(a, "name")


def search_tokens(query: Column) -> Column:
    """Words of two letters or more, tested before other marks are dropped."""
    kept = F.filter(F.split(F.regexp_replace(query, r"^\s+|\s+$", ""), r"\s+"), lambda t: F.length(t) >= 2)
    return F.filter(F.transform(kept, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9 ]", "")), lambda t: t != "")


#: Letters of a word by which it is looked up: whole up to eight, else by its first eight, twelve and so on.
WHOLE, HEADS = 8, (12, 16, 24, 32)


def _head(t: Column) -> Column:
    """The part of a word that is looked up."""
    n = F.length(t)
    size = F.when(n <= WHOLE, n)
    for a, b in zip((WHOLE, *HEADS), HEADS):
        size = size.when(n < b, F.lit(a))
    return F.substring(t, F.lit(1), size.otherwise(F.lit(HEADS[-1])))


def _pieces(t: Column) -> Column:
    """Every part of a word that may be the head of another one."""
    part = lambda k: F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i: F.substr(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[part(k) for k in (*range(1, WHOLE + 1), *HEADS)]))


def search_entities(queries: DataFrame, ents: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, entity_id, rank): entities whose name holds all words of a query.

    Stubs only where no other entity matches; ``limit`` by id.  A query's word has
    letters and digits only, so it lies within one run of these in a name: words and
    runs, each once, meet by equi-join on parts of the runs.  A query then looks only
    among the names that hold its rarest word, once for all queries of the same
    words.  Parts are many times the runs, which the engine's estimates do not know,
    so they are kept from being broadcast.
    """
    q = queries.select("query_id", F.array_sort(F.array_distinct(search_tokens(F.col("text")))).alias("tokens")).filter(F.size("tokens") > 0)
    asked = stage(q.select("tokens").distinct(), "asked")
    n = ents.filter("name is not null").select("id", "is_stub", F.lower("name").alias("name"))
    held = stage(n.select("id", "is_stub", "name", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("[a-z0-9]+"), F.lit(0)))).alias("run")), "held")
    tasks = max(2, ents.sparkSession.sparkContext.defaultParallelism)
    runs = held.groupBy("run").agg(F.count("*").alias("n")).repartition(tasks, "run").select("run", "n", F.explode(_pieces(F.col("run"))).alias("head"))
    words = asked.select(F.explode("tokens").alias("word")).distinct().withColumn("head", _head(F.col("word")))
    within = stage(runs.join(words.hint("merge"), "head").filter(F.contains("run", F.col("word"))).select("word", "run", "n"), "within")
    often = within.groupBy("word").agg(F.sum("n").alias("n"))
    found = asked.select("tokens", F.explode("tokens").alias("word")).join(often.hint("merge"), "word").groupBy("tokens").agg(F.count("*").alias("known"), F.min(F.struct("n", "word")).alias("r"))
    probe = found.filter(F.col("known") == F.size("tokens")).select("tokens", F.col("r.word").alias("word"))
    near = probe.join(within.select("word", "run").hint("merge"), "word").join(held.hint("merge"), "run")
    hit = near.filter(F.forall("tokens", lambda t: F.contains(F.col("name"), t))).select("tokens", "id", "is_stub").distinct()
    w = Window.partitionBy("tokens")
    first = hit.withColumn("rank", F.row_number().over(w.orderBy("is_stub", "id"))).filter(F.col("rank") <= limit)
    best = first.withColumn("least", F.min(F.col("is_stub").cast("int")).over(w)).filter(F.col("is_stub").cast("int") == F.col("least"))
    return q.join(best.hint("merge"), "tokens").select("query_id", F.col("id").alias("entity_id"), "rank")


def events_of_entities(groups: DataFrame, edge: DataFrame, evs: DataFrame) -> DataFrame:
    """(key, id, temporal_order): distinct events of any entity of a group."""
    part = edge.filter("kind = 'PARTICIPANT_IN'").select(F.col("src").alias("entity_id"), F.col("dst").alias("id"))
    return groups.select("key", "entity_id").join(part, "entity_id").select("key", "id").distinct().join(evs.select("id", F.coalesce("temporal_order", F.lit(0)).alias("temporal_order")), "id")


def first_participants(edge: DataFrame, most: int = 3) -> DataFrame:
    """(event_id, entity_ids): up to ``most`` participants of an event by id."""
    w = Window.partitionBy("dst").orderBy("src")
    top = edge.filter("kind = 'PARTICIPANT_IN'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("entity_ids")).select(F.col("dst").alias("event_id"), "entity_ids")


def hops(ids: DataFrame, edge: DataFrame, n: int = 2) -> DataFrame:
    """(id, other): pairs within exactly ``n`` undirected steps, ends distinct."""
    both = edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = ids.select(F.col("id"), F.col("id").alias("at"))
    for _ in range(n):
        out = out.join(both, out["at"] == both["src"]).select("id", F.col("dst").alias("at")).distinct()
    return out.filter("id <> at").select("id", F.col("at").alias("other"))


def hop_counts(edge: DataFrame) -> DataFrame:
    """(id, n): how many other nodes lie exactly two undirected steps from each node, as ``hops`` counts them.

    The neighbours of a start's neighbour of most edges are not paired with the
    start: their number is taken as it is, and only what the start reaches by its
    other neighbours and that one does not have is counted beside it.
    """
    both = edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    size = both.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("size"))
    top = both.join(size, "dst").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("size", F.col("dst").alias("hub"))).alias("t")).select("id", "t.*")
    step = both.withColumnRenamed("src", "id").join(top, "id").filter(F.col("dst") != F.col("hub")).select("id", "hub", F.col("dst").alias("at"))
    seen = both.select(F.col("src").alias("hub"), F.col("dst").alias("other"))
    more = step.join(both.select(F.col("src").alias("at"), F.col("dst").alias("other")), "at").select("id", "hub", "other").distinct().join(seen, ["hub", "other"], "left_anti")
    n = top.join(more.groupBy("id").agg(F.count("*").alias("more")), "id", "left")
    return n.select("id", (F.col("size") + F.coalesce("more", F.lit(0)) - 1).alias("n")).filter("n > 0")  # a start reaches itself


def descriptions(ents: DataFrame) -> DataFrame:
    """(id, name, node_type, description) for the entity graph.

    The description is a property of that name, else the summary, else the first
    four properties that are not empty within the first four.
    """
    p = F.col("properties")
    four = F.filter(F.slice(F.map_entries(p), 1, 4), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    rest = F.array_join(F.transform(four, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    text = F.coalesce(blank_to_null(F.try_element_at(p, F.lit("description"))), blank_to_null(F.try_element_at(p, F.lit("summary"))), rest)
    return ents.select("id", "name", F.coalesce(blank_to_null(F.col("node_type")), F.lit("Unknown")).alias("node_type"), text.alias("description"))
