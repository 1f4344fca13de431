"""Every query with a SQL twin gives the twin's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from strataloom import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_a_twin_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
