"""Queries of the training-data problems over the project's tables, and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import groups, history, leakage, mixing, names, pairs, subjects, survivor
from skein.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_events(table(spark, d, "graph_event"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.entity_groups(table(spark, d, "graph_entity"), table(spark, d, "name_resolution"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(p2_found(spark, d), table(spark, d, "graph_entity"))


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden_record(p2_found(spark, d), table(spark, d, "graph_entity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve_typed(table(spark, d, "name_resolution"), table(spark, d, "graph_entity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "query_result"), table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).rows


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).shares


def p8_temperature(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as all documents by pure temperature with the entropy of the targets."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), tempered=True).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_label"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "subject_label"))


_NORMAL = r"nullif(lower(trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))), '')"
_GROUPS = f"""
WITH RECURSIVE held0 AS (
  SELECT id, {_NORMAL.format('name')} AS s FROM graph_entity
  UNION SELECT id, {_NORMAL.format('a')} FROM (SELECT id, unnest(aliases) AS a FROM graph_entity)
  UNION SELECT node_id, {_NORMAL.format('input_name')} FROM name_resolution
    WHERE is_ambiguous IS NOT TRUE AND node_id IN (SELECT id FROM graph_entity)),
held AS (SELECT DISTINCT id, s FROM held0 WHERE s IS NOT NULL),
hub AS (SELECT s, min(id) AS h FROM held GROUP BY s HAVING count(*) > 1),
pair AS (SELECT DISTINCT h AS u, id AS v FROM held JOIN hub USING (s) WHERE id <> h),
edge AS (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
reach(node, seen) AS (SELECT DISTINCT u, u FROM edge UNION SELECT r.node, e.v FROM reach r JOIN edge e ON r.seen = e.u),
grp AS (SELECT node AS entity_id, min(seen) AS group_id FROM reach GROUP BY node)
"""
_KEY = """CASE WHEN is_stub IS FALSE THEN 0 ELSE 1 END, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 WHEN confidence > 1 THEN round(confidence / 100, 2) ELSE confidence END DESC,
  CASE WHEN source_count IS NULL OR source_count = 0 THEN 1 ELSE source_count END DESC, last_updated DESC NULLS LAST, id"""

_BEST = ", ".join(
    f"arg_min({v}, rk) FILTER ({v} IS NOT NULL) AS {f}"
    for f, v in [(f, f if f in ("first_seen", "last_updated") else f"nullif(trim({f}), '')") for f in survivor.FIELDS]
)


def _windows(text: str, key: str, source: str) -> str:
    """Distinct windows of words of a text; the entities are those of the tables."""
    for a, b in (("&#39;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    text = rf"lower(nfc_normalize(regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|<[!?][^<>]*>', '', 'g'), '\p{{Cf}}', '', 'g')))"
    n = leakage.MIN_WORDS
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i
  FROM (SELECT {key}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}))"""


_LEAKS = f"leak AS (SELECT DISTINCT doc_id, item_id FROM ({_windows('text', 'doc_id', 'documents')}) JOIN ({_windows('passage', 'item_id', 'eval_item')}) USING (g))"

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p4_golden": p4_golden, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_temperature": p8_temperature, "p9_found": p9_found, "p9_composition": p9_composition}
ORACLE = {
    "p2_found": _GROUPS + "SELECT entity_id, group_id FROM grp",
    "p4_found": _GROUPS + f"""SELECT group_id, id AS survivor_id FROM (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY {_KEY}) AS r
  FROM graph_entity JOIN grp ON id = entity_id) WHERE r = 1""",
    "p4_golden": _GROUPS + f""", r AS (SELECT e.*, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {_KEY}) AS rk FROM graph_entity e JOIN grp ON id = entity_id)
SELECT group_id, arg_min(id, rk) AS survivor_id, {_BEST}, count(DISTINCT id) AS n_records FROM r GROUP BY group_id""",
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leak",
    "p7_items": f"WITH {_LEAKS} SELECT item_id, suite, count(doc_id) AS n_documents FROM (SELECT DISTINCT item_id, suite FROM eval_item) LEFT JOIN leak USING (item_id) GROUP BY item_id, suite",
}
