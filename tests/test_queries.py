"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(_norm(x[want.columns.index(c)]) for c in cols) for x in want.fetchall())
