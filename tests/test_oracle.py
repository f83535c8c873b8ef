"""Every core query with SQL against DuckDB on the smallest tables."""

import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from skein.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def tidy(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted(repr([tidy(dict(zip(names, r))[c]) for c in cols]) for r in rel.fetchall())
    assert got == want


def test_queries_without_sql_run(spark, duck):
    for name, f in registry.queries().items():
        if name not in SQL:
            assert f(spark, DATA).count() >= 0
