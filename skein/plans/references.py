"""Queries of the reference check (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.references import orphan_report, orphan_rows
from skein.session import table


def _four(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("graph_event", "graph_entity", "prop_node", "graph_tombstone")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that was broken when made."""
    return orphan_rows(*_four(spark, d)).select("ref_table", "ref_id", "ref_field", "ref_key", "kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field and month."""
    return orphan_report(*_four(spark, d))


_BASE = r"""
WITH refs0 AS (
  SELECT 'graph_event' AS ref_table, id AS ref_id, 'caused_by' AS ref_field, 'event' AS target, unnest(caused_by) AS k, batch_no, date_trunc('month', recorded_at)::DATE AS period FROM graph_event
  UNION ALL SELECT 'graph_event', id, 'leads_to', 'event', unnest(leads_to), batch_no, date_trunc('month', recorded_at)::DATE FROM graph_event
  UNION ALL SELECT 'prop_node', prop_id::VARCHAR, 'node_id', 'node', node_id, batch_no, date_trunc('month', scored_at)::DATE FROM prop_node),
refs AS (SELECT DISTINCT ref_table, ref_id, ref_field, target, lower(regexp_replace(k, '^\s+|\s+$', '', 'g')) AS ref_key, coalesce(batch_no, 0) AS batch_no, period
  FROM refs0 WHERE regexp_replace(k, '^\s+|\s+$', '', 'g') <> ''),
par AS (SELECT 'event' AS target, id, batch_no FROM graph_event UNION ALL SELECT 'node', id, batch_no FROM graph_event UNION ALL SELECT 'node', id, batch_no FROM graph_entity),
p AS (SELECT target, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS ref_key, min(coalesce(batch_no, 0)) AS fb FROM par GROUP BY ALL),
t AS (SELECT lower(regexp_replace(node_id, '^\s+|\s+$', '', 'g')) AS ref_key, min(coalesce(batch_no, 0)) AS gb FROM graph_tombstone GROUP BY ALL),
found AS (SELECT r.*, CASE WHEN gb <= r.batch_no THEN 'deleted' WHEN fb > r.batch_no THEN 'late' WHEN fb IS NULL AND gb IS NULL THEN 'missing' END AS kind
  FROM refs r LEFT JOIN p USING (target, ref_key) LEFT JOIN t USING (ref_key))
"""
QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLE = {
    "p3_found": _BASE + "SELECT DISTINCT ref_table, ref_id, ref_field, ref_key, kind FROM found WHERE kind IS NOT NULL",
    "p3_report": _BASE + """, d AS (SELECT DISTINCT ref_table, ref_id, ref_field, ref_key, period, kind FROM found)
SELECT ref_table, ref_field, period, count(DISTINCT (ref_id, ref_key)) AS n_refs, count(*) FILTER (kind = 'missing') AS n_missing,
  count(*) FILTER (kind = 'deleted') AS n_deleted, count(*) FILTER (kind = 'late') AS n_late FROM d GROUP BY ALL""",
}
