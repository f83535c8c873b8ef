"""Segmentation, linking, annotation and streams over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import embedder
from skein.operators import annotate, graph, linking, pipeline, segments
from skein.plans.graph import _EDGE, _ENT, Graph
from skein.session import new_path, stage, table
from skein.streaming import ingest as streams

C = F.col


def segment_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    s = segments.by_paragraph(table(spark, d, "documents"))
    return s.select("doc_id", "segment_id", F.md5("text").alias("text"))


def segment_scenes(spark: SparkSession, d: str) -> DataFrame:
    s = segments.by_scene(table(spark, d, "documents"))
    return s.select("doc_id", "segment_id", F.md5("text").alias("text"))


def segment_meaning(spark: SparkSession, d: str) -> DataFrame:
    """Sentences joined while their hashed-word vectors are similar."""
    s = segments.sentences(table(spark, d, "documents")).withColumn("vec", embedder()(C("text")))
    return segments.by_meaning(stage(s, "sentences"), split_at=0.1).select("doc_id", "segment_id", F.length("text").alias("n"))


def segment_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = segments.chunks(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_id", F.length("text").alias("n"), F.md5("text").alias("text"))


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    s = segments.context_windows(segments.sentences(table(spark, d, "documents")))
    return s.select("doc_id", "sent_id", F.md5("context").alias("context"))


def link_precedes(spark: SparkSession, d: str) -> DataFrame:
    return graph.precedes(Graph(spark, d).events)


def link_across_batches(spark: SparkSession, d: str) -> DataFrame:
    """Later batches' events linked to the latest event of the first load."""
    e = Graph(spark, d).events
    return linking.link_across(e.filter("batch_no > 0"), e.filter("batch_no = 0"))


def temporal_order(spark: SparkSession, d: str) -> DataFrame:
    e = Graph(spark, d).events.filter("document_id is not null").select(C("id").alias("pos"), C("document_id").alias("doc_id"), F.coalesce("segment_id", F.lit(0)).alias("segment_id"))
    return linking.temporal_order(e).select(C("pos").alias("id"), "temporal_order")


def resolve_subset(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "name_resolution").select(C("input_name").alias("name"))
    return linking.token_subset_match(n, Graph(spark, d).entities.filter(~C("is_stub")))


def resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "name_resolution").select(C("input_name").alias("name"))
    m = linking.fuzzy_match(n, Graph(spark, d).entities.filter(~C("is_stub")))
    return m.select("name", "id", F.round("ratio", 4).alias("ratio"))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct name with the entity it resolves to, by the first way that finds one."""
    n = table(spark, d, "name_resolution").filter("input_name is not null").select(C("input_name").alias("name"))
    r = linking.resolve_names(n, Graph(spark, d).entities)
    return r.select("input_name", "node_id", "matched_by", "confidence", "is_ambiguous")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return stage(annotate.annotate(segments.by_paragraph(table(spark, d, "documents"))), "tokens")


def extract_events(spark: SparkSession, d: str) -> DataFrame:
    e = annotate.extract_events(_tokens(spark, d))
    return e.select("doc_id", "seg_id", "sent_id", "title", "action", "outcome", F.array_join("participants", "; ").alias("who"), F.array_join("locations", "; ").alias("place"))


def extract_properties(spark: SparkSession, d: str) -> DataFrame:
    return annotate.extract_properties(_tokens(spark, d))


def resolve_pronouns(spark: SparkSession, d: str) -> DataFrame:
    r = annotate.resolve_pronouns(_tokens(spark, d))
    return r.select("doc_id", "seg_id", F.md5("text").alias("text"))


def stream_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per user and day of the event stream, read back from the sink."""
    path, ck = new_path(spark, "stream"), new_path(spark, "offsets")
    feed = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = streams.append_batches(streams.evidence(feed.withColumnRenamed("event_type", "name")), path, ck, mode="complete")
    q.awaitTermination()
    out = spark.read.schema("name string, day timestamp, mentions bigint, batch int").parquet(path)
    return out.filter(C("batch") == out.agg(F.max("batch")).first()[0]).select("name", F.date_format("day", "yyyy-MM-dd").alias("day"), "mentions")


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents taken into an empty graph: counts of its tables."""
    docs = table(spark, d, "documents").select("doc_id", "title", "text", "source", C("doc_date").alias("date"))
    before = pipeline.empty_graph(spark)
    after, resolved = pipeline.ingest(docs, before, F.lit("2026-01-01").cast("date"))
    return pipeline.summary(before, after, resolved)


_NAMES = (
    "segment_paragraphs", "segment_scenes", "segment_meaning", "segment_chunks", "sentence_windows", "link_precedes", "link_across_batches", "temporal_order", "resolve_subset", "resolve_fuzzy", "resolve_cascade",
    "extract_events", "extract_properties", "resolve_pronouns", "ingest_documents", "stream_evidence",
)
QUERIES = {n: globals()[n] for n in _NAMES}
_T = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NUM = "unnest({a}) AS text, generate_subscripts({a}, 1) - 1 AS segment_id"
_PARA = rf"list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {_T.format('x')}), lambda x: length(x) >= 80)"
_SCENE = rf"list_filter(list_transform(string_split_regex(text, '\n\s*(\*{{3,}}|---+|#{{1,3}}\s+\w)'), lambda x: {_T.format('x')}), lambda x: length(x) > 20)"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda t: t <> ''))"
_CHUNK = r"""cut(doc_id, text, s, e) AS (
  SELECT doc_id, text, 0, CASE WHEN length(text) <= 400 THEN length(text) WHEN b = 0 THEN 400 ELSE b END FROM (SELECT doc_id, text, length(regexp_extract(substr(text, 2, 400), '(?s)^.*[ \n\t]')) AS b FROM documents WHERE text <> '')
  UNION ALL SELECT doc_id, text, n, CASE WHEN length(text) <= n + 400 THEN length(text) WHEN b = 0 THEN n + 400 ELSE n + b END
  FROM (SELECT doc_id, text, n, length(regexp_extract(substr(text, n + 2, 400), '(?s)^.*[ \n\t]')) AS b FROM (SELECT doc_id, text, greatest(s + 1, e - 80) AS n FROM cut WHERE e < length(text)))),
piece AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS text FROM cut),
chunk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_id, text FROM piece WHERE length(text) >= 40)"""
_SENT = rf"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda x: {_T.format('x')}), lambda x: x <> '')"
ORACLE = {
    "segment_chunks": f"WITH RECURSIVE {_CHUNK} SELECT doc_id, chunk_id, length(text)::INT AS n, md5(text) AS text FROM chunk",
    "sentence_windows": f"""WITH p AS (SELECT doc_id, {_SENT} AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS text, (generate_subscripts(a, 1) - 1)::INT AS sent_id FROM p)
SELECT doc_id, sent_id, md5(array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ')) AS context FROM u""",
    "segment_paragraphs": f"WITH p AS (SELECT doc_id, {_PARA} AS a FROM documents), u AS (SELECT doc_id, {_NUM.format(a='a')} FROM p) SELECT doc_id, segment_id::INT AS segment_id, md5(text) AS text FROM u",
    "segment_scenes": f"WITH p AS (SELECT doc_id, CASE WHEN len({_SCENE}) > 0 THEN {_SCENE} ELSE {_PARA} END AS a FROM documents), u AS (SELECT doc_id, {_NUM.format(a='a')} FROM p) SELECT doc_id, segment_id::INT AS segment_id, md5(text) AS text FROM u",
    "link_precedes": f"WITH {_EDGE} SELECT src AS from_id, dst AS to_id FROM pre",
    "link_across_batches": f"""WITH {_EDGE}, a AS (SELECT DISTINCT id, coalesce(temporal_order, 0) AS t, unnest(coalesce(participants, []::VARCHAR[]) || coalesce(locations, []::VARCHAR[])) AS name FROM evt WHERE batch_no > 0),
h AS (SELECT DISTINCT id, coalesce(temporal_order, 0) AS t, unnest(participants) AS name FROM evt WHERE batch_no = 0)
SELECT DISTINCT ON (to_id) from_id, to_id FROM (SELECT h.id AS from_id, a.id AS to_id, h.t FROM a JOIN h ON a.name = h.name AND h.t < a.t) ORDER BY to_id, t DESC, from_id DESC""",
    "temporal_order": "SELECT id, (coalesce(segment_id, 0) * 1000 + row_number() OVER (PARTITION BY document_id ORDER BY coalesce(segment_id, 0), id) - 1)::BIGINT AS temporal_order FROM (SELECT DISTINCT ON (id) * FROM graph_event) WHERE document_id IS NOT NULL",
    "resolve_subset": f"""WITH {_ENT}, n AS (SELECT DISTINCT input_name AS name, {_WORDS.format('input_name')} AS w FROM name_resolution WHERE input_name IS NOT NULL), e AS (SELECT id, {_WORDS.format('name')} AS v FROM ent WHERE NOT is_stub AND name IS NOT NULL),
x AS (SELECT name, unnest(w) AS t, len(w) AS k FROM n), y AS (SELECT id, unnest(v) AS t FROM e), h AS (SELECT name, id FROM x JOIN y USING (t) GROUP BY name, k, id HAVING count(*) = k) SELECT name, min(id) AS id FROM h GROUP BY name HAVING count(*) = 1""",
    "stream_evidence": "SELECT event_type AS name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS mentions FROM events GROUP BY ALL",
}
