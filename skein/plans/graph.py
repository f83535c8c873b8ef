"""Graph and vector queries over the project's tables, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.operators import graph, traversal, vector
from skein.session import stage, table

C = F.col


class Graph:
    """The frames of one data folder."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d
        self.entities = graph.entities(table(spark, d, "graph_entity"))
        self.events = graph.events(table(spark, d, "graph_event"))
        self.edges = graph.edges(self.entities, self.events)
        self.nodes = graph.nodes(self.entities, self.events)

    def vectors(self) -> DataFrame:
        """A vector per node: the embedding that a hash of its id points to."""
        e = table(self.spark, self.d, "embeddings")
        n = e.count()
        pick = F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint"), F.lit(n))
        return self.nodes.select("id", pick.alias("vec_id")).join(e.select("vec_id", C("embedding").alias("vec")), "vec_id").select("id", "vec")

    def questions(self) -> DataFrame:
        """The stated query set: every result whose id is divisible by 50, with a vector."""
        e = table(self.spark, self.d, "embeddings")
        n = e.count()
        q = table(self.spark, self.d, "query_result").filter("result_id % 50 = 0")
        return q.select(C("result_id").alias("query_id"), C("question").alias("text"), F.pmod(C("result_id"), F.lit(n)).alias("vec_id")).join(e.select("vec_id", C("embedding").alias("vec")), "vec_id").select("query_id", "text", "vec")

    def mixed_questions(self) -> DataFrame:
        """The stated questions with sums of one to five vectors: clear to vague ones."""
        e = table(self.spark, self.d, "embeddings")
        n = e.count()
        q = table(self.spark, self.d, "query_result").filter("result_id % 50 = 0").select(C("result_id").alias("query_id"), C("question").alias("text"))
        parts = F.transform(F.sequence(F.lit(0), F.pmod(F.floor(C("query_id") / 50), F.lit(5))), lambda i: F.pmod(C("query_id") + i * 37, F.lit(n)))
        hit = q.select("query_id", "text", F.explode(parts).alias("vec_id")).join(e.select("vec_id", C("embedding").cast("array<double>").alias("v")), "vec_id")
        size = F.size(F.get(C("vs"), F.lit(0)))
        total = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(C("vs"), F.lit(0.0), lambda s, x: s + F.get(x, i)))
        return hit.groupBy("query_id", "text").agg(F.collect_list("v").alias("vs")).select("query_id", "text", total.alias("vec"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).edges


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).nodes


def graph_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).edges.groupBy("kind").agg(F.count("*").alias("n"))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return graph.neighbours(g.nodes, graph.adjacency(g.edges), g.nodes).select("id", "neighbour_id", "kind_ord", "node_type")


def graph_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    names = table(spark, d, "name_resolution").select(C("input_name").alias("name"))
    a = graph.by_name(names, g.entities).withColumn("how", F.lit("exact"))
    return a.unionByName(graph.by_alias(names, g.entities).withColumn("how", F.lit("alias")))


def graph_fetch_pathway(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    paths = graph.first_participants(g.edges).select(C("event_id").alias("key"), F.concat(F.array("event_id"), "entity_ids").alias("node_ids"))
    return graph.fetch_nodes(paths, g.nodes)


def graph_search_names(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    q = table(spark, d, "name_resolution").filter("input_name is not null").select(C("input_name").alias("query_id"), C("input_name").alias("text")).distinct()
    return graph.search_entities(q, g.entities)


def graph_shared_events(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    groups = g.entities.select(F.coalesce("node_type", F.lit("?")).alias("key"), C("id").alias("entity_id"))
    return graph.events_of_entities(groups, g.edges, g.events)


def graph_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes lie within two undirected steps of each entity and event, over all kinds of edges."""
    return graph.hop_counts(stage(Graph(spark, d).edges, "edges"))


def graph_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return graph.descriptions(Graph(spark, d).entities)


def graph_known_names(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).entities.filter(~C("is_stub")).select("id", "name")


def graph_peopled_events(spark: SparkSession, d: str) -> DataFrame:
    return Graph(spark, d).events.filter(F.size("participants") > 0).select("id", F.array_join("participants", "; ", "").alias("who"))


def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Five most similar vectors of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vec"))
    out = vector.top_k(q, e.select(C("vec_id").alias("id"), C("embedding").alias("vec")), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vector_floor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vec"))
    out = vector.top_k(q, e.select(C("vec_id").alias("id"), C("embedding").alias("vec")), 8, floor=0.35)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _starts(g: Graph) -> DataFrame:
    """A start per question: the entity that has a hash of the question's number."""
    q = g.questions()
    names = g.entities.select("id", F.row_number().over(graph.Window.partitionBy(F.substring(F.md5("id"), 1, 2)).orderBy("id")).alias("r")).filter("r = 1").select(F.substring(F.md5("id"), 1, 2).alias("h"), C("id").alias("start_id"))
    return q.withColumn("h", F.substring(F.md5(C("query_id").cast("string")), 1, 2)).join(names, "h").select("query_id", "start_id", "vec")


def _propagated(spark: SparkSession, d: str, depth: int) -> DataFrame:
    g = Graph(spark, d)
    edges = stage(g.edges, "edges")
    c = replace(RetrievalConfig(), propagation_max_depth=depth, propagation_hop_threshold=0.02)
    return traversal.propagate(_starts(g), graph.adjacency(edges), g.nodes, g.vectors(), c)


def graph_propagate(spark: SparkSession, d: str) -> DataFrame:
    """Four hops, the default depth, from each question's start."""
    out = _propagated(spark, d, 4)
    return out.select("query_id", "start_id", "node_id", "hop", F.round("prop_score", 6).alias("prop_score"))


def graph_propagate_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = traversal.graph_metrics(traversal.merge_best(_propagated(spark, d, 4)))
    return m.withColumn("nodes_per_hop", F.array_join(F.transform(F.map_entries("nodes_per_hop"), lambda e: F.format_string("h%d:%d", e["key"], e["value"])), " "))


_ENT = """ent AS (SELECT DISTINCT ON (id) id, name, entity_type, coalesce(aliases, []::VARCHAR[]) AS aliases, coalesce(is_stub, false) AS is_stub, coalesce(nullif(properties, ''), '{}')::JSON AS props FROM graph_entity WHERE id IS NOT NULL)"""
_EVT = "evt AS (SELECT DISTINCT ON (id) * FROM graph_event WHERE id IS NOT NULL)"
_KEY = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"
_EDGE = f"""{_ENT}, {_EVT}, idx AS (SELECT name, min(id) AS eid FROM ent WHERE name IS NOT NULL GROUP BY name),
who AS (SELECT DISTINCT eid AS src, id AS dst, 'PARTICIPANT_IN' AS kind, NULL::INT AS specificity FROM (SELECT id, unnest(participants) AS name FROM evt) JOIN idx USING (name)),
plc AS (SELECT id AS src, eid AS dst, 'LOCATED_AT' AS kind, min(pos)::INT AS specificity FROM (SELECT id, unnest(locations) AS name, generate_subscripts(locations, 1) - 1 AS pos FROM evt) JOIN idx USING (name) GROUP BY id, eid),
cau AS (SELECT DISTINCT src, dst, 'CAUSES' AS kind, NULL::INT AS specificity FROM (
  SELECT {_KEY.format('k')} AS src, id AS dst FROM (SELECT id, unnest(caused_by) AS k FROM evt) UNION ALL SELECT id, {_KEY.format('k')} FROM (SELECT id, unnest(leads_to) AS k FROM evt))
  WHERE src IN (SELECT id FROM evt) AND dst IN (SELECT id FROM evt)),
one AS (SELECT DISTINCT document_id, id, temporal_order, unnest(participants) AS name FROM evt WHERE document_id IS NOT NULL),
pre AS (SELECT DISTINCT f AS src, id AS dst, 'PRECEDES' AS kind, NULL::INT AS specificity FROM (SELECT id, lag(id) OVER (PARTITION BY document_id, name ORDER BY temporal_order NULLS FIRST, id) AS f FROM one WHERE name IS NOT NULL) WHERE f IS NOT NULL AND f <> id),
edge AS (SELECT * FROM who UNION ALL SELECT * FROM plc UNION ALL SELECT * FROM cau UNION ALL SELECT * FROM pre)"""
_PAIRS = "list_transform(json_keys(props), lambda k: k || ': ' || coalesce(json_extract_string(props, '$.\"' || k || '\"'), ''))"
_NODE = f"""node AS (SELECT id, 'entity' AS node_type, name, coalesce(name, '') || ' (' || coalesce(entity_type, '') || ')' || CASE WHEN len(json_keys(props)) > 0 THEN ': ' || array_to_string({_PAIRS}, ', ') ELSE '' END AS content, is_stub FROM ent WHERE id NOT IN (SELECT id FROM evt)
  UNION ALL SELECT id, 'event', title, coalesce(nullif(source_text, ''), nullif(summary, ''), title), false FROM evt)"""
_ADJ = """adj AS (SELECT src, dst, 0 AS kind_ord FROM edge WHERE kind = 'PARTICIPANT_IN' UNION ALL SELECT dst, src, 1 FROM edge WHERE kind = 'PARTICIPANT_IN' UNION ALL SELECT src, dst, 2 FROM edge WHERE kind = 'LOCATED_AT'
  UNION ALL SELECT dst, src, 3 FROM edge WHERE kind = 'PRECEDES' UNION ALL SELECT src, dst, 4 FROM edge WHERE kind = 'PRECEDES' UNION ALL SELECT dst, src, 5 FROM edge WHERE kind = 'CAUSES' UNION ALL SELECT src, dst, 6 FROM edge WHERE kind = 'CAUSES')"""
_TOKENS = r"list_filter(list_transform(list_filter(string_split_regex(regexp_replace(input_name, '^\s+|\s+$', '', 'g'), '\s+'), lambda t: length(t) >= 2), lambda t: regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')), lambda t: t <> '')"


def _hop(h: int) -> str:
    """SQL of one level of the propagation, from the level before."""
    seen = " UNION ALL ".join(f"SELECT query_id, start_id, node_id FROM raw{i}" for i in range(h))
    return f""", new{h} AS (SELECT query_id, start_id, dst AS node_id, min((l.ord * 10 + kind_ord)) AS p FROM acc{h - 1} l JOIN adj ON l.node_id = adj.src
    WHERE (query_id, start_id) NOT IN (SELECT (query_id, start_id) FROM (SELECT query_id, start_id FROM all{h - 1} GROUP BY ALL HAVING count(*) >= 25)) GROUP BY ALL),
raw{h} AS (SELECT n.query_id, n.start_id, n.node_id, p, {h} AS hop, list_cosine_similarity(q.vec::DOUBLE[], v.vec::DOUBLE[]) * pow(0.9, {h}) * CASE WHEN node.is_stub THEN 0.5 ELSE 1 END AS prop_score
  FROM new{h} n JOIN node ON node.id = n.node_id JOIN vec v ON v.id = n.node_id JOIN start q ON q.query_id = n.query_id AND q.start_id = n.start_id
  WHERE (n.query_id, n.start_id, n.node_id) NOT IN (SELECT (query_id, start_id, node_id) FROM ({seen}))),
acc{h} AS (SELECT * FROM (SELECT query_id, start_id, node_id, hop, prop_score, row_number() OVER (PARTITION BY query_id, start_id ORDER BY p, node_id) AS ord FROM raw{h} WHERE prop_score >= 0.02) WHERE ord <= 25),
all{h} AS (SELECT * FROM all{h - 1} UNION ALL SELECT * FROM acc{h})"""


_PROP = f"""WITH {_EDGE}, {_NODE}, {_ADJ},
vec AS (SELECT node.id, e.embedding AS vec FROM node JOIN embeddings e ON e.vec_id = ('0x' || substr(md5(node.id), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)),
fst AS (SELECT substr(md5(id), 1, 2) AS h, min(id) AS start_id FROM ent GROUP BY 1),
start AS (SELECT r.result_id AS query_id, start_id, e.embedding AS vec FROM query_result r JOIN embeddings e ON e.vec_id = r.result_id % (SELECT count(*) FROM embeddings) JOIN fst ON fst.h = substr(md5(r.result_id::VARCHAR), 1, 2) WHERE r.result_id % 50 = 0),
acc0 AS (SELECT query_id, start_id, start_id AS node_id, 0 AS hop, list_cosine_similarity(start.vec::DOUBLE[], vec.vec::DOUBLE[]) * CASE WHEN node.is_stub THEN 0.5 ELSE 1 END AS prop_score, 1 AS ord FROM start JOIN vec ON vec.id = start_id JOIN node ON node.id = start_id),
raw0 AS (SELECT * FROM acc0), all0 AS (SELECT * FROM acc0)"""

_NAMES = ("graph_edges", "graph_nodes", "graph_label_counts", "graph_neighbours", "graph_lookup", "graph_fetch_pathway", "graph_search_names", "graph_shared_events", "graph_two_hops", "graph_descriptions", "graph_known_names", "graph_peopled_events", "vector_top_k", "vector_floor", "graph_propagate", "graph_propagate_metrics")
QUERIES = {n: globals()[n] for n in _NAMES}
_TOPK = """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"""
ORACLE = {
    "graph_edges": f"WITH {_EDGE} SELECT * FROM edge",
    "graph_nodes": f"WITH {_ENT}, {_EVT}, {_NODE} SELECT * FROM node",
    "graph_label_counts": f"WITH {_EDGE} SELECT kind, count(*) AS n FROM edge GROUP BY kind",
    "graph_neighbours": f"WITH {_EDGE}, {_NODE}, {_ADJ} SELECT adj.src AS id, adj.dst AS neighbour_id, kind_ord, node.node_type FROM adj JOIN node ON node.id = adj.dst",
    "graph_lookup": f"""WITH {_ENT}, n AS (SELECT DISTINCT input_name AS name FROM name_resolution) SELECT name, min(id) AS entity_id, 'exact' AS how FROM n JOIN ent USING (name) GROUP BY name
  UNION ALL SELECT name, min(id), 'alias' FROM n JOIN (SELECT id, unnest(aliases) AS name FROM ent) USING (name) GROUP BY name""",
    "graph_fetch_pathway": f"""WITH {_EDGE}, {_NODE}, t AS (SELECT dst AS key, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM who),
p AS (SELECT key, src AS id, r AS pos FROM t WHERE r <= 3 UNION ALL SELECT DISTINCT key, key, 0 FROM t) SELECT key, pos::INT AS pos, id, node_type, name, content FROM p JOIN node USING (id)""",
    "graph_search_names": f"""WITH {_ENT}, q AS (SELECT DISTINCT input_name, {_TOKENS} AS tokens FROM name_resolution WHERE input_name IS NOT NULL),
h AS (SELECT input_name, id, is_stub, min(is_stub::INT) OVER (PARTITION BY input_name) AS l FROM q, ent WHERE len(tokens) > 0 AND name IS NOT NULL AND len(list_filter(tokens, lambda t: NOT contains(lower(name), t))) = 0),
r AS (SELECT input_name AS query_id, id AS entity_id, row_number() OVER (PARTITION BY input_name ORDER BY id)::INT AS rank FROM h WHERE is_stub::INT = l) SELECT * FROM r WHERE rank <= 3""",
    "graph_shared_events": f"WITH {_EDGE} SELECT DISTINCT coalesce(ent.entity_type, '?') AS key, evt.id, coalesce(evt.temporal_order, 0) AS temporal_order FROM who JOIN ent ON ent.id = who.src JOIN evt ON evt.id = who.dst",
    "graph_two_hops": f"""WITH {_EDGE}, u AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge)
SELECT a.src AS id, count(DISTINCT b.dst) AS n FROM u a JOIN u b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.src""",
    "graph_descriptions": f"""WITH {_ENT}, f AS (SELECT *, list_filter(list_slice(json_keys(props), 1, 4), lambda k: coalesce(json_extract_string(props, '$."' || k || '"'), '') <> '') AS ks FROM ent)
SELECT id, name, coalesce(nullif(entity_type, ''), 'Unknown') AS node_type, coalesce(nullif(props->>'description', ''), nullif(props->>'summary', ''), array_to_string(list_transform(ks, lambda k: k || ': ' || json_extract_string(props, '$."' || k || '"')), '; ')) AS description FROM f""",
    "graph_known_names": f"WITH {_ENT} SELECT id, name FROM ent WHERE NOT is_stub",
    "graph_peopled_events": f"WITH {_EVT} SELECT id, array_to_string(list_transform(participants, lambda p: coalesce(p, '')), '; ') AS who FROM evt WHERE len(participants) > 0",
    "vector_top_k": f"SELECT * FROM ({_TOPK}) WHERE rank <= 5",
    "vector_floor": f"SELECT * FROM ({_TOPK}) WHERE rank <= 8 AND score >= 0.35",
    "graph_propagate_metrics": _PROP + _hop(1) + _hop(2) + _hop(3) + _hop(4) + """,
m AS (SELECT a.*, node.node_type, node.name, node.is_stub, prop_score / (pow(0.9, hop) * CASE WHEN node.is_stub THEN 0.5 ELSE 1 END) AS own
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, start_id ORDER BY hop, ord) AS pl FROM all4) a JOIN node ON node.id = a.node_id WHERE pl <= 25),
h AS (SELECT query_id, string_agg('h' || hop || ':' || n, ' ' ORDER BY hop) AS nodes_per_hop FROM (SELECT query_id, hop, count(*) AS n FROM m GROUP BY ALL) GROUP BY query_id)
SELECT query_id, count(*) AS n_nodes, round(avg(prop_score), 4) AS avg_prop, round(max(prop_score), 4) AS max_prop, round(min(prop_score), 4) AS min_prop, round(avg(own), 4) AS avg_intrinsic, count(*) FILTER (is_stub) AS n_stubs,
  round(count(*) FILTER (is_stub) / count(*), 3) AS stub_ratio, max(hop)::INT AS max_hop, count(*) FILTER (node_type = 'entity') AS n_entities, count(*) FILTER (node_type = 'event') AS n_events, count(DISTINCT name) AS n_names, any_value(nodes_per_hop) AS nodes_per_hop
FROM m JOIN h USING (query_id) GROUP BY query_id""",
    "graph_propagate": _PROP + _hop(1) + _hop(2) + _hop(3) + _hop(4) + " SELECT query_id, start_id, node_id, hop, round(prop_score, 6) AS prop_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, start_id ORDER BY hop, ord) AS pl FROM all4) WHERE pl <= 25",
}
