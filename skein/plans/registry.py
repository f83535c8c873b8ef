"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans import evaluation, graph, ingest, references, retrieval, scalar

_MODULES = [references, scalar, graph, retrieval, ingest, evaluation]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.ORACLE
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiered cascade over the stated questions."""
    return retrieval.cascade_answers(spark, sf_dir)
