"""Queries of the subpackage with SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from skein.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = c.sql(queries.ORACLE[name])
    names = list(rel.columns)
    want = sorted(tuple(map(str, (dict(zip(names, r))[k] for k in cols))) for r in rel.fetchall())
    assert sorted(names) == cols and sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_run(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, DATA).count() >= 0, name
