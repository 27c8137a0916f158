"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want
