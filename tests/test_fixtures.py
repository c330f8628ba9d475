"""Derived inputs of the registered queries against the given tables."""

import os

import pytest

from plumbline.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_queries_hold_whole_texts(spark):
    want = {r["item_id"]: r["text"] for r in fx.table(spark, DATA, "benchmark").collect()}
    got = {r["query_id"]: r["query"] for r in fx.queries(spark, DATA).collect()}
    assert max(map(len, want.values())) > 200
    assert {k: v for k, v in got.items() if k < 1_000_001} == want
