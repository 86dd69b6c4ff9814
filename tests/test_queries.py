"""Every library query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from textloom.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(str(tuple(shown(r[i]) for i in at)) for r in rel.fetchall())
    assert sorted(str(tuple(shown(r[c]) for c in columns)) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
