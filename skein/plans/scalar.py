"""Scalar functions over the graph tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import ids, metrics, text
from skein.session import table

C = F.col


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_entity").dropDuplicates(["id"])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_event").dropDuplicates(["id"])


def fn_entity_key_terms(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("id", text.entity_key_terms(C("name"), C("entity_type"), text.properties_map(C("properties"))).alias("terms"))


def fn_event_key_terms(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("id", text.event_key_terms(C("participants"), C("action"), C("outcome"), C("locations"), C("title")).alias("terms"))


def fn_event_variants(spark: SparkSession, d: str) -> DataFrame:
    v = text.event_variants(C("participants"), C("action"), C("outcome"), C("locations"), C("title"), C("summary"))
    return _events(spark, d).select("id", F.explode(v).alias("v")).select("id", "v.variant", "v.terms")


def fn_entity_variants(spark: SparkSession, d: str) -> DataFrame:
    v = text.entity_variants(C("name"), C("entity_type"), text.properties_map(C("properties")), C("aliases"))
    return _entities(spark, d).select("id", F.explode(v).alias("v")).select("id", "v.variant", "v.terms")


def fn_strip_html(spark: SparkSession, d: str) -> DataFrame:
    t = text.strip_html(text.body_of(C("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))


def fn_clean_book_text(spark: SparkSession, d: str) -> DataFrame:
    t, c = text.clean_book_text(C("text")), text.strip_credits(C("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("text_md5"), text.word_count(t).alias("n_words"), (text.word_count(t) < 100).alias("too_short"), F.md5(c).alias("plain_md5"))


def fn_normalize_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "name_resolution").select("input_name").distinct()
    return n.select("input_name", text.normalize_name(C("input_name")).alias("name"), text.normalize_entity_text(C("input_name")).alias("mention"), text.is_noise(C("input_name")).alias("noise"), text.file_slug(C("input_name")).alias("file_slug"))


def fn_ids(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter("title is not null")
    return e.select(
        "id", ids.fact_id(C("title")).alias("fact_id"), ids.pathway_id(C("title")).alias("pathway_id"), ids.stable_doc_id(C("title"), C("temporal_order")).alias("doc_no"),
        ids.entity_id(C("title")).alias("entity_id"), ids.event_id(C("title"), C("document_id"), C("temporal_order")).alias("event_id"), ids.seed_id(C("title")).alias("seed_id"),
    )


def fn_answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_result")
    return q.select(
        "result_id", F.round(metrics.token_recall(C("context"), C("expected_answer")), 6).alias("recall"), F.round(metrics.token_f1(C("context"), C("expected_answer")), 6).alias("f1"),
        metrics.answer_hit(C("context"), C("expected_answer")).alias("answer_hit"), metrics.anchor_hit(C("context"), C("retrieval_anchor")).alias("anchor_hit"), F.length(F.coalesce("context", F.lit(""))).alias("context_len"),
    )


def fn_mentions(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter("title is not null and source_text is not null")
    return e.select("id", text.mention_count(C("source_text"), F.get("participants", F.lit(0))).alias("n")).filter("n is not null")


def fn_summaries(spark: SparkSession, d: str) -> DataFrame:
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    people, places = F.array_join(F.coalesce("participants", F.array().cast("array<string>")), ", "), F.array_join(F.coalesce("locations", F.array().cast("array<string>")), ", ")
    parts = [some("Event: ", C("title")), some("Participants: ", people), some("Locations: ", places), some("Action: ", C("action")), some("Outcome: ", C("outcome"))]
    return _events(spark, d).select("id", F.concat_ws(" | ", *parts).alias("line"))


def fn_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_result").select("result_id", text.is_factual(F.coalesce("question", F.lit(""))).alias("factual"))


_STOP = "['" + "', '".join(text.TERM_STOP_WORDS) + "']"
_ASTOP = "['" + "', '".join(text.ANSWER_STOP_WORDS) + "']"


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


def _atok(x: str) -> str:
    return f"flatten(list_transform(coalesce({x}, []::VARCHAR[]), lambda y: {_tok('y')}))"


def _join(x: str) -> str:
    """First 20 distinct tokens in order; DuckDB's list_distinct loses the order."""
    return f"array_to_string(list_slice(list_filter({x}, lambda t, i: list_position({x}, t) = i), 1, 20), ' ')"


_E = "(SELECT DISTINCT ON (id) * FROM graph_entity)"
_V = "(SELECT DISTINCT ON (id) * FROM graph_event)"
_PROPS = "list_transform(json_keys(coalesce(nullif(properties, ''), '{}')::JSON), lambda k: json_extract_string(properties, '$.\"' || k || '\"'))"
_UUID = "(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab',(('0x'||substr({h},17,1))::INT % 4)+1,1)||substr({h},18,3)||'-'||substr({h},21,12))"
_DNS = "unhex('6ba7b8109dad11d180b400c04fd430c8')"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'))"


def _uuid(name: str) -> str:
    return _UUID.format(h=f"substr(sha1({_DNS} || encode({name})),1,32)")


_HTML = r"coalesce(nullif(regexp_extract(text, '(?is)<body[^>]*>(.*?)</body>', 1), ''), text)"
_STRIPPED = f"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–")):
    _STRIPPED = f"replace({_STRIPPED}, '{_a}', '{_b}')"
_STRIPPED = _TRIM.format(rf"regexp_replace({_STRIPPED}, '\s+', ' ', 'g')")
_BOOK = r"regexp_replace(regexp_replace(text, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _BOOK = f"replace({_BOOK}, '{_a}', '{_b}')"
_BOOK = _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(" + _BOOK + r", '&#?[\p{L}\p{N}_]+;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_PLAIN = _TRIM.format(r"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
_PLAIN = _TRIM.format(rf"regexp_replace({_PLAIN}, 'Chapter \d+:.*?Translator:.*?Editor:\s*\S+', '', 'g')")
_ANS = f"list_filter({_words('expected_answer')}, lambda t: NOT list_contains({_ASTOP}, t))"

QUERIES = {f.__name__: f for f in (fn_entity_key_terms, fn_event_key_terms, fn_event_variants, fn_entity_variants, fn_strip_html, fn_clean_book_text, fn_normalize_names, fn_ids, fn_answer_metrics, fn_mentions, fn_summaries, fn_requests)}
ORACLE = {
    "fn_entity_key_terms": f"WITH t AS (SELECT id, {_tok('name')} || {_tok('entity_type')} || {_atok(_PROPS)} AS x FROM {_E}) SELECT id, {_join('x')} AS terms FROM t",
    "fn_event_key_terms": f"WITH t AS (SELECT id, {_atok('participants')} || {_tok('action')} || {_tok('outcome')} || {_atok('locations')} || {_tok('title')} AS x FROM {_V}) SELECT id, {_join('x')} AS terms FROM t",
    "fn_event_variants": f"""WITH t AS (SELECT id, {_atok('participants')} AS p, {_atok('locations')} AS l, {_tok('action')} AS a, {_tok('outcome')} AS o, {_tok('title')} AS t, {_tok('summary')} AS s FROM {_V}),
u AS (SELECT id, 'who_what' AS variant, p || a AS x FROM t UNION ALL SELECT id, 'who_result', p || o FROM t UNION ALL SELECT id, 'where_what', l || a FROM t
  UNION ALL SELECT id, 'cause_effect', a || o FROM t UNION ALL SELECT id, 'summary', t || s || p FROM t)
SELECT id, variant, {_join('x')} AS terms FROM u WHERE len(x) > 0""",
    "fn_entity_variants": f"""WITH t AS (SELECT id, {_tok('name')} AS n, {_tok('entity_type')} AS k, {_atok(_PROPS)} AS p, aliases FROM {_E}),
a AS (SELECT id, k, unnest(aliases) AS s, generate_subscripts(aliases, 1) - 1 AS i FROM t),
u AS (SELECT id, 'name_type' AS variant, n || k AS x FROM t UNION ALL SELECT id, 'name_props', n || p FROM t UNION ALL SELECT id, 'alias_' || i, {_tok('s')} || k FROM a WHERE len({_tok('s')}) > 0)
SELECT id, variant, {_join('x')} AS terms FROM u WHERE len(x) > 0""",
    "fn_strip_html": f"SELECT doc_id, md5({_STRIPPED}) AS text_md5, length({_STRIPPED})::INT AS n_chars FROM documents",
    "fn_clean_book_text": f"WITH t AS (SELECT doc_id, {_BOOK} AS b, {_PLAIN} AS p FROM documents), w AS (SELECT *, CASE WHEN b = '' THEN 0 ELSE len(string_split_regex(b, '\\s+')) END::INT AS n FROM t) SELECT doc_id, md5(b) AS text_md5, n AS n_words, n < 100 AS too_short, md5(p) AS plain_md5 FROM w",
    "fn_normalize_names": rf"""WITH n AS (SELECT DISTINCT input_name AS x, {_TRIM.format('input_name')} AS t FROM name_resolution)
SELECT x AS input_name, regexp_replace(regexp_replace(t, '[’''‘]s$', ''), '[!?,.]+$', '') AS name,
  {_TRIM.format(r"regexp_replace(regexp_replace(" + _TRIM.format(r"regexp_replace(x, '''s\b', '', 'g')") + r", '(?i)^(all|the|a|an|this|these|those|some|any)\s+', ''), '[!?,. ]+$', '')")} AS mention,
  (lower(t) IN ({", ".join(f"'{w}'" for w in text.NOISE_WORDS)}) OR length(t) <= 1) AS noise, replace({_TRIM.format(r"regexp_replace(x, '[^\p{L}\p{N}_\s-]', '', 'g')")}, ' ', '_') AS file_slug FROM n""",
    "fn_ids": f"""SELECT id, {_uuid("'app_user:' || md5(title)")} AS fact_id, {_uuid("'pathway:' || substr(title, 1, 80)")} AS pathway_id,
  (('0x' || substr(sha256(title || ':' || temporal_order), 1, 14))::BIGINT % 2147483647)::BIGINT AS doc_no, 'entity_' || substr(regexp_replace(lower(title), '[^a-z0-9]', '_', 'g'), 1, 20) || '_' || substr(sha256(title), 1, 8) AS entity_id,
  'evt_' || substr(regexp_replace(lower(title), '[^a-z0-9]', '_', 'g'), 1, 20) || '_' || substr(sha256(concat_ws(':', title, document_id::VARCHAR, temporal_order::VARCHAR)), 1, 8) AS event_id,
  {_uuid("'graphrag:' || lower(title)")} AS seed_id FROM {_V} WHERE title IS NOT NULL""",
    "fn_answer_metrics": f"""WITH t AS (SELECT *, {_words('context')} AS p, {_words('expected_answer')} AS g, {_ANS} AS k0 FROM query_result),
u AS (SELECT *, CASE WHEN len(k0) > 0 THEN k0 ELSE g END AS k, len(list_intersect(p, g)) AS b FROM t),
r AS (SELECT *, CASE WHEN len(k) > 0 THEN len(list_intersect(p, k)) / len(k)::DOUBLE ELSE 0 END AS rc FROM u)
SELECT result_id, round(rc, 6) AS recall, round(CASE WHEN b > 0 THEN 2.0 * b / (len(p) + len(g))::DOUBLE ELSE 0 END::DOUBLE, 6) AS f1, rc >= 0.6 AS answer_hit,
  (coalesce(retrieval_anchor, '') <> '' AND contains(lower(coalesce(context, '')), lower(retrieval_anchor))) AS anchor_hit, length(coalesce(context, ''))::INT AS context_len FROM r""",
    "fn_mentions": f"SELECT id, ((length(t) - length(replace(t, p, ''))) / length(p))::INT AS n FROM (SELECT id, lower(source_text) AS t, lower(participants[1]) AS p FROM {_V} WHERE title IS NOT NULL AND source_text IS NOT NULL) WHERE p IS NOT NULL AND p <> '' UNION ALL SELECT id, 0 FROM {_V} WHERE title IS NOT NULL AND source_text IS NOT NULL AND coalesce(participants[1], '') = ''",
    "fn_summaries": f"""SELECT id, concat_ws(' | ', 'Event: ' || nullif(title, ''), 'Participants: ' || nullif(array_to_string(participants, ', '), ''), 'Locations: ' || nullif(array_to_string(locations, ', '), ''),
  'Action: ' || nullif(action, ''), 'Outcome: ' || nullif(outcome, '')) AS line FROM {_V}""",
    "fn_requests": rf"SELECT result_id, (NOT regexp_matches(coalesce(question, ''), '(?i)\b({text.CREATIVE})\b') AND regexp_matches(coalesce(question, ''), '(?i)\b({text.FACTUAL})\b')) AS factual FROM query_result",
}
