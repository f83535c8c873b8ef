"""Keyword search, cascade, entity graph and pathway queries, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.operators import cascade, entity_graph, graph, grep, memory, methods, sweep, traversal, upsert
from skein.plans.graph import _EDGE, _ENT, _EVT, Graph
from skein.plans.ingest import _CHUNK
from skein.plans.scalar import ORACLE as _SCALAR
from skein.plans.scalar import _DNS, _UUID, _atok, _join, _tok
from skein.session import once, stage, table

C = F.col


def _with_vector(spark: SparkSession, d: str, df: DataFrame, key: str) -> DataFrame:
    """Adds ``vec``: the embedding that the number ``key`` points to."""
    e = table(spark, d, "embeddings")
    return df.withColumn("vec_id", F.pmod(C(key), F.lit(e.count()))).join(e.select("vec_id", C("embedding").alias("vec")), "vec_id").drop("vec_id")


def grep_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding all keywords of each evaluation passage."""
    q = table(spark, d, "eval_item").select(C("item_id").alias("query_id"), C("passage").alias("text"))
    r = table(spark, d, "documents").select(C("doc_id").alias("stem"), C("text").alias("content"))
    return grep.grep(q, r).select("query_id", "stem", F.md5("block").alias("block"))


def grep_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_result").filter("result_id % 50 = 0").select(C("result_id").alias("query_id"), C("retrieval_anchor").alias("text"))
    r = table(spark, d, "documents").select(C("doc_id").alias("stem"), C("text").alias("content"))
    return grep.grep(q, r).select("query_id", "stem")


def pathway_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Pathways of all events: key-term variants with the event and its participants."""
    g = Graph(spark, d)
    last = memory.latest_pathways(memory.event_pathways(g.events, graph.first_participants(g.edges)))
    return last.select(C("id").alias("pid"), "key_terms", F.array_join("pathway", " ").alias("pathway"))


def pathway_backfill_entities(spark: SparkSession, d: str) -> DataFrame:
    """Pathways of all entities: names with types, with properties, and aliases."""
    last = memory.latest_pathways(memory.entity_pathways(Graph(spark, d).entities))
    return last.select(C("id").alias("pid"), "key_terms", F.array_join("pathway", " ").alias("pathway"))


def _stores(spark: SparkSession, d: str) -> cascade.Stores:
    g = Graph(spark, d)
    # every tier reads the graph, so it is made once
    own = ("id", "document_id", "title", "summary", "source_text", "temporal_order", "participants", "locations", "caused_by", "leads_to")
    raw = table(spark, d, "graph_event").filter("id is not null").select(*own)
    g.entities, g.events = stage(g.entities, "entities"), stage(graph.whole_events(once(raw, "id")), "events")
    g.nodes = stage(graph.nodes(g.entities, g.events), "nodes")
    edges = stage(graph.edges(g.entities, g.events), "edges")
    docs = table(spark, d, "documents")
    facts = _with_vector(spark, d, docs.select(C("doc_id").cast("string").alias("id"), "doc_id", F.coalesce("title", F.lit("")).alias("text"), F.lit("app_user").alias("user_id"), F.array().cast("array<string>").alias("pathway")), "doc_id").drop("doc_id")
    named = g.entities.filter("name is not null").join(g.vectors(), "id").select(F.concat(F.lit("e:"), "id").alias("id"), F.concat(F.lit("Entity: "), "name", F.lit(" | Type: "), F.coalesce("node_type", F.lit(""))).alias("text"), F.lit("app_user").alias("user_id"), F.array().cast("array<string>").alias("pathway"), "vec")
    facts = facts.unionByName(named)
    paths = stage(graph.first_participants(edges).select(C("event_id").alias("id"), F.concat(F.array("event_id"), "entity_ids").alias("pathway")), "pathways").join(g.vectors(), "id")
    records = docs.select(C("doc_id").alias("stem"), C("text").alias("content"))
    return cascade.Stores(g.nodes, graph.adjacency(edges), g.entities, g.vectors(), facts, paths, records)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, vec): the chunks of all documents; vectors as those of nodes, by a hash of the id."""
    c = once(stage(methods.index_chunks(table(spark, d, "documents")).select("id", "text"), "chunks"), "id")
    return _with_vector(spark, d, c.withColumn("h", F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint")), "h").drop("h")


def cascade_answers(spark: SparkSession, d: str) -> DataFrame:
    """The tiered cascade over the stated questions: tier, confidence, hits."""
    a = cascade.retrieve(Graph(spark, d).mixed_questions(), _stores(spark, d)).answers
    return a.select("query_id", "source", F.round("confidence", 6).alias("confidence"), F.size("hits").alias("n_hits"), F.md5(F.array_join("hits", "\n")).alias("hits"), "reconsolidated")


def cascade_tier1(spark: SparkSession, d: str) -> DataFrame:
    """The pathway tier alone, whatever its confidence."""
    g = Graph(spark, d)
    s = _stores(spark, d)
    t = cascade.pathway_tier(g.questions(), s.pathways, s.nodes, RetrievalConfig(start_threshold=0.2))
    return t.select("query_id", F.round("confidence", 6).alias("confidence"), F.md5(F.array_join("hits", "\n")).alias("hits"))


def method_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Every method over the stated questions: length and digest of each context."""
    g = Graph(spark, d)
    arcs = entity_graph_arcs(spark, d).unionByName(entity_graph.alias_arcs(g.edges, g.entities))
    s = replace(_stores(spark, d), arcs=stage(arcs, "arcs"), chunks=_chunks(spark, d))
    return methods.run_methods(g.mixed_questions(), s, show=lambda c: [F.length(c).alias("n"), F.md5(c).alias("context")])


def eval_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The stated questions through the cascade under every configuration of the sweep."""
    runs = sweep.sweep(Graph(spark, d).mixed_questions(), _stores(spark, d), sweep.build_configs(spark))
    return runs.select("config", "query_id", "source", F.round("confidence", 6).alias("confidence"), "hits", "chars", "nodes", F.round("score", 4).alias("score"))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents with ids and vectors."""
    return methods.index_chunks(table(spark, d, "documents")).select("id", "chapter", "chunk_idx", F.size("vec").alias("dim"))


def entity_graph_arcs(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    events = stage(g.events.select("id", "participants", "locations"), "events")
    return entity_graph.co_occurrences(events, g.entities).unionByName(entity_graph.located_in(events, g.entities))


def entity_graph_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return entity_graph.seed_texts(graph.descriptions(g.entities), g.entities)


def entity_graph_expand(spark: SparkSession, d: str) -> DataFrame:
    """How far the graph reaches in two directed steps from every distinct source."""
    return _reach(stage(entity_graph_arcs(spark, d), "arcs"))


def _reach(arcs: DataFrame) -> DataFrame:
    """(query_id, n_nodes, max_hop, n_arcs) of each source; arcs are counted by node and not paired with the sources."""
    seeds = arcs.select(C("source").alias("query_id"), F.lower("source").alias("name")).distinct()
    return seeds.join(traversal.reach_counts(arcs), "name").select("query_id", "n_nodes", "max_hop", "n_arcs")


def upsert_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entities after the unresolved names of the batches after the first."""
    g = Graph(spark, d)
    current = graph.entities(table(spark, d, "graph_entity").filter("batch_no = 0 and name is not null"))
    w = graph.Window.partitionBy("name").orderBy("id")
    current = current.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "name", C("node_type").alias("entity_type"), "aliases", "is_stub", "confidence", "source_count", "first_seen", "last_updated")
    m = g.events.filter("batch_no > 0").select(F.explode("participants").alias("name"), F.lit("person").alias("entity_type"))
    return upsert.upsert_entities(current, m, F.lit("2026-01-01").cast("date")).select("id", "name", "entity_type", "is_stub", "confidence", "source_count", "first_seen", "last_updated")


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents inserted where absent: the earlier chapters, then all."""
    docs = table(spark, d, "documents").select(C("doc_id").alias("id"), "title", C("doc_date").alias("date"), "source")
    first = docs.filter("id % 2 = 0").withColumn("title", F.lit("known"))
    return upsert.insert_absent(first, docs, "id")


def upsert_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by content: the last of equal summaries stays."""
    e = table(spark, d, "graph_event").filter("summary is not null").select(C("summary").alias("text"), C("id").alias("seq"), "document_id")
    empty = spark.createDataFrame([], "id string, text string, seq string, document_id bigint")
    return upsert.store_facts(empty, e).select("id", "seq", "document_id")


_NAMES = ("grep_records", "grep_questions", "pathway_backfill", "pathway_backfill_entities", "cascade_answers", "cascade_tier1", "method_contexts", "eval_sweep", "chunk_index", "entity_graph_arcs", "entity_graph_seeds", "entity_graph_expand", "upsert_mentions", "upsert_documents", "upsert_facts")
QUERIES = {n: globals()[n] for n in _NAMES}


def _grep(q: str, cols: str) -> str:
    shown = "list_slice(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r|\\x0B|\\f|\\x{85}|\\x{2028}|\\x{2029}'), lambda x: len(list_filter(ws, lambda w: contains(lower(x), w))) > 0), 1, 10)"
    block = f"md5('[' || doc_id || ']' || chr(10) || array_to_string(list_transform({shown}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)))"
    return f"""WITH q AS ({q}), k AS (SELECT query_id, list_distinct(regexp_extract_all(lower(coalesce(t, '')), '[a-z]{{4,}}')) AS ws FROM q)
SELECT {cols.replace('BLOCK', block)} FROM k, documents WHERE len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(lower(coalesce(text, '')), w))) = 0"""


_ARCS = f"""{_ENT}, {_EVT}, nm AS (SELECT DISTINCT lower(name) AS low FROM ent),
pp AS (SELECT id, pos, name, lower(name) AS low FROM (SELECT id, unnest(participants) AS name, generate_subscripts(participants, 1) AS pos FROM evt) WHERE lower(name) IN (SELECT low FROM nm)),
ll AS (SELECT id, pos, name, lower(name) AS low FROM (SELECT id, unnest(locations) AS name, generate_subscripts(locations, 1) AS pos FROM evt) WHERE lower(name) IN (SELECT low FROM nm)),
arc AS (SELECT DISTINCT ON (x, y) source, target, 'CO_OCCURS' AS relation FROM (SELECT least(a.low, b.low) AS x, greatest(a.low, b.low) AS y, a.name AS source, b.name AS target, a.id AS i, a.pos AS p, b.pos AS q FROM pp a JOIN pp b ON a.id = b.id AND a.pos < b.pos) ORDER BY x, y, i, p, q, source, target),
loc AS (SELECT DISTINCT ON (x, y) source, target, 'LOCATED_IN' AS relation FROM (SELECT a.low AS x, b.low AS y, a.name AS source, b.name AS target, a.id AS i, a.pos AS p, b.pos AS q FROM pp a JOIN ll b ON a.id = b.id AND a.low <> b.low) ORDER BY x, y, i, p, q, source, target),
arcs AS (SELECT * FROM arc UNION ALL SELECT * FROM loc)"""
_PUUID = _UUID.format(h=f"substr(sha1({_DNS} || encode('pathway:' || substr(key_terms, 1, 80))), 1, 32)")
_CUUID = _UUID.format(h=f"substr(sha1({_DNS} || encode(x)), 1, 32)")
_FUUID = _UUID.format(h=f"substr(sha1({_DNS} || encode('app_user:' || md5(summary))), 1, 32)")
_SEED = f"""{_ENT}, f AS (SELECT *, list_filter(list_slice(json_keys(props), 1, 4), lambda k: coalesce(json_extract_string(props, '$."' || k || '"'), '') <> '') AS ks FROM ent WHERE NOT is_stub OR NOT EXISTS (SELECT 1 FROM ent WHERE NOT is_stub)),
t AS (SELECT id, name, coalesce(nullif(entity_type, ''), 'Unknown') AS k, substr(coalesce(nullif(props->>'description', ''), nullif(props->>'summary', ''), array_to_string(list_transform(ks, lambda k: k || ': ' || json_extract_string(props, '$."' || k || '"')), '; ')), 1, 300) AS d FROM f WHERE name IS NOT NULL)"""
ORACLE = {
    "entity_graph_seeds": f"WITH {_SEED} SELECT DISTINCT ON (key) lower(name) AS key, name, name || ' (' || k || ')' || CASE WHEN d <> '' THEN ': ' || d ELSE '' END AS text FROM t ORDER BY key, id DESC",
    "chunk_index": f"WITH RECURSIVE {_CHUNK}, h AS (SELECT *, 'rag:' || doc_id || ':' || chunk_id || ':' || substr(text, 1, 40) AS x FROM chunk) SELECT {_CUUID} AS id, doc_id AS chapter, chunk_id AS chunk_idx, 64 AS dim FROM h",
    "grep_records": _grep("SELECT item_id AS query_id, passage AS t FROM eval_item", "query_id, doc_id AS stem, BLOCK AS block"),
    "grep_questions": _grep("SELECT result_id AS query_id, retrieval_anchor AS t FROM query_result WHERE result_id % 50 = 0", "query_id, doc_id AS stem"),
    "pathway_backfill": f"""WITH {_EDGE}, t AS (SELECT id, {_atok('participants')} AS p, {_atok('locations')} AS l, {_tok('action')} AS a, {_tok('outcome')} AS o, {_tok('title')} AS t, {_tok('summary')} AS s FROM evt),
u AS (SELECT id, 'who_what' AS variant, p || a AS x FROM t UNION ALL SELECT id, 'who_result', p || o FROM t UNION ALL SELECT id, 'where_what', l || a FROM t UNION ALL SELECT id, 'cause_effect', a || o FROM t UNION ALL SELECT id, 'summary', t || s || p FROM t),
k AS (SELECT id, id || ':' || variant AS seq, {_join('x')} AS key_terms FROM u WHERE len(x) > 0),
f AS (SELECT dst, list(src ORDER BY src) AS ids FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM who) WHERE r <= 3 GROUP BY dst),
z AS (SELECT {_PUUID} AS pid, key_terms, array_to_string([id] || coalesce(ids, []::VARCHAR[]), ' ') AS pathway, seq FROM k LEFT JOIN f ON f.dst = k.id)
SELECT DISTINCT ON (pid) pid, key_terms, pathway FROM z ORDER BY pid, seq DESC""",
    "pathway_backfill_entities": f"""WITH w AS ({_SCALAR['fn_entity_variants']}), k AS (SELECT id, id || ':' || variant AS seq, terms AS key_terms FROM w), z AS (SELECT {_PUUID} AS pid, key_terms, id AS pathway, seq FROM k)
SELECT DISTINCT ON (pid) pid, key_terms, pathway FROM z ORDER BY pid, seq DESC""",
    "entity_graph_arcs": f"WITH {_ARCS} SELECT * FROM arcs",
    "entity_graph_expand": f"""WITH {_ARCS}, w AS (SELECT DISTINCT lower(source) AS s, lower(target) AS t, source, target, relation FROM arcs), st AS (SELECT DISTINCT s, t FROM w),
n0 AS (SELECT DISTINCT source AS q, lower(source) AS n, 0 AS hop FROM arcs),
n1 AS (SELECT DISTINCT q, t AS n, 1 AS hop FROM n0 JOIN st ON n0.n = st.s WHERE (q, t) NOT IN (SELECT (q, n) FROM n0)),
n2 AS (SELECT DISTINCT q, t AS n, 2 AS hop FROM n1 JOIN st ON n1.n = st.s WHERE (q, t) NOT IN (SELECT (q, n) FROM n0) AND (q, t) NOT IN (SELECT (q, n) FROM n1)),
nn AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2), fa AS (SELECT DISTINCT q, source, target, relation FROM nn JOIN w ON nn.n = w.s), fc AS (SELECT q, count(*) AS c FROM fa GROUP BY q)
SELECT q AS query_id, count(*) AS n_nodes, max(hop)::INT AS max_hop, coalesce(any_value(c), 0)::BIGINT AS n_arcs FROM nn LEFT JOIN fc USING (q) GROUP BY q""",
    "upsert_mentions": f"""WITH {_EVT}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM (SELECT DISTINCT ON (id) * FROM graph_entity WHERE id IS NOT NULL AND batch_no = 0 AND name IS NOT NULL)) WHERE r = 1),
m AS (SELECT name, count(*) AS m FROM (SELECT unnest(participants) AS name FROM evt WHERE batch_no > 0) WHERE name IS NOT NULL GROUP BY name)
SELECT coalesce(id, 'entity_' || substr(regexp_replace(lower(name), '[^a-z0-9]', '_', 'g'), 1, 20) || '_' || substr(sha256(name), 1, 8)) AS id, name, CASE WHEN id IS NULL THEN 'person' WHEN entity_type IS NULL AND m IS NOT NULL THEN 'person' ELSE entity_type END AS entity_type,
  CASE WHEN id IS NOT NULL AND m IS NULL THEN coalesce(is_stub, false) WHEN id IS NOT NULL THEN false ELSE m < 2 END AS is_stub,
  round(CASE WHEN id IS NOT NULL AND m IS NULL THEN coalesce(confidence, 0.5) WHEN id IS NOT NULL THEN least(0.97, coalesce(confidence, 0.5) + 0.05 * m) ELSE least(0.97, 0.4 + 0.05 * (m - 1)) END, 6)::DOUBLE AS confidence,
  (CASE WHEN id IS NULL THEN 0 ELSE coalesce(source_count, 1) END + coalesce(m, 0))::BIGINT AS source_count, coalesce(first_seen, DATE '2026-01-01') AS first_seen, CASE WHEN m IS NOT NULL THEN DATE '2026-01-01' ELSE last_updated END AS last_updated
FROM cur FULL JOIN m USING (name)""",
    "upsert_documents": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'known' ELSE title END AS title, doc_date AS date, source FROM documents",
    "upsert_facts": f"SELECT DISTINCT ON (i) i AS id, seq, document_id FROM (SELECT {_FUUID} AS i, id AS seq, document_id FROM graph_event WHERE summary IS NOT NULL) ORDER BY i, seq DESC",
}
