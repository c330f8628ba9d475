"""Searches by cells: exact whatever the bounds skip, and how much they skip."""

import numpy as np
import pytest

from plumbline.operators import search as se
from plumbline.operators import tfidf as tf


def dense(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<double>")


def clustered(rng, groups=40, each=50, dim=8, wide=0.02):
    return (rng.normal(size=(groups, 1, dim)) + rng.normal(size=(groups, each, dim)) * wide).reshape(-1, dim)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e4])
@pytest.mark.parametrize("cell", [1, 16, 10_000])
def test_cells_are_exact(monkeypatch, scale, cell):
    monkeypatch.setattr(se, "CELL", cell)
    rng = np.random.default_rng(7)
    x = clustered(rng, 10, 30) * scale
    x[40:60] = x[3]  # copies tie, by id
    x[100] = 0
    q = np.vstack([x[::17] + rng.normal(size=(18, 8)) * 0.01 * scale, x[3], np.zeros(8)])
    for kind in (se.Euclid(), se.Cosine()):
        best = se.Best(len(q), 5)
        for part in (slice(0, 130), slice(130, 300)):
            se.Cells(np.arange(300)[part], x[part], kind).meet(q, best)
        score = np.round(kind.score(q, x), 9)
        for i in range(len(q)):
            want = sorted(range(300), key=lambda j: (-score[i, j], j))[:5]
            assert best.scores[i].tolist() == [score[i, j] for j in want]
            assert best.ids[i].tolist() == want


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(8)
    x = clustered(rng)
    q = x[::97] + 0.001
    for kind in (se.Euclid(), se.Cosine()):
        cells = se.Cells(np.arange(len(x)), x, kind)
        reach, score = cells.reach(q), kind.score(q, x)
        assert all((score[:, r] <= reach[:, [c]]).all() for c, r in enumerate(cells.rows) if len(r))
        assert sorted(np.concatenate(cells.rows).tolist()) == list(range(len(x)))
        assert cells.meet(q, se.Best(len(q), 5)) < 0.35 * score.size
        far = rng.normal(size=(400, 8))  # nothing to skip by: as many pairs as there are, and no more
        assert se.Cells(np.arange(400), far, kind).meet(far, se.Best(400, 400)) == 160_000


def test_terms_bound_sparse_rows(spark):
    topics = [[f"{chr(97 + t)}{chr(97 + i)}" for i in range(20)] for t in range(8)]
    rng = np.random.default_rng(9)
    texts = [(i, "s", " ".join(rng.choice(topics[i % 8], 12))) for i in range(1200)]
    index = tf.build_index(spark.createDataFrame(texts, "chunk_id long, source_file string, text string").coalesce(1))
    asked = spark.createDataFrame([(t, " ".join(topics[t][:6])) for t in range(8)], "query_id long, query string")
    q = tf.pack(asked.withColumnRenamed("query", "text"), index["vocabulary"], "query_id")
    pairs, scored = se.pruned(q, index["packed"], "chunk_id", 5, se.NEAR)
    assert pairs == 8 * 1200 and scored < 0.5 * pairs
    hits = se.search_tfidf_l2(asked, index, 5).collect()
    weights = {r["chunk_id"]: dict(zip(r["places"], r["weights"], strict=True)) for r in index["packed"].collect()}
    for r in q.collect():
        mine = dict(zip(r["places"], r["weights"], strict=True))
        score = {c: round(1 / (3 - 2 * sum(w * mine.get(p, 0) for p, w in v.items())), 9) for c, v in weights.items()}
        want = sorted(score, key=lambda c: (-score[c], c))[:5]
        assert [h["chunk_id"] for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == r["query_id"]] == want


def test_no_rows(spark):
    none = dense(spark, np.zeros((0, 4)), "vec_id")
    some = dense(spark, np.ones((3, 4)), "vec_id")
    assert se.search_l2(none.withColumnRenamed("vec_id", "query_id"), some).count() == 0
    assert se.search_l2(some.withColumnRenamed("vec_id", "query_id"), none).count() == 0
    assert se.pruned(some.withColumnRenamed("vec_id", "query_id"), some, "vec_id", 2, se.Euclid()) == (9, 9)


def test_alike_are_searched_once(spark, monkeypatch):
    """More queries than a block, most of them alike, and vectors of which many are alike: ties by id as without."""
    rng = np.random.default_rng(3)
    some = rng.integers(-3, 4, (12, 4)).astype(float)
    vectors = [(i, some[i * 7 % 12].tolist()) for i in range(90)]
    queries = [(i, some[i % 12].tolist()) for i in range(60)]
    want = {(q, r, v) for q, x in queries for r, v in enumerate([j for _, j in sorted((-round(1 / (1 + float(((np.array(x) - np.array(y)) ** 2).sum())), 9), j) for j, y in vectors)[:5]], 1)}
    q, v = spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    for block in (20, 5):  # those that differ fit a block, or go by the grid
        monkeypatch.setattr(se, "QUERY_BLOCK", block)
        monkeypatch.setattr(se, "SLAB", 6)
        monkeypatch.setattr(se, "HELD", 4)
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in se.search_l2(q, v, 5).collect()} == want


def test_vectors_that_are_alike_are_met_once_in_a_block(spark, monkeypatch):
    """Queries that fit a block but are more than a few: what is scored is a vector of each value, and the hits are all of them."""
    rng = np.random.default_rng(5)
    some = rng.integers(-3, 4, (12, 4)).astype(float)
    vectors, queries = [(i, some[i * 7 % 12].tolist()) for i in range(90)], [(i, some[i % 12].tolist()) for i in range(60)]
    want = {(q, r, v) for q, x in queries for r, v in enumerate([j for _, j in sorted((-round(1 / (1 + float(((np.array(x) - np.array(y)) ** 2).sum())), 9), j) for j, y in vectors)[:9]], 1)}
    q, v = spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    met, write = {}, se.materialize
    monkeypatch.setattr(se, "materialize", lambda df, name: met.setdefault(name, write(df, name)))
    monkeypatch.setattr(se, "FEW", 59, raising=False)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in se.search_l2(q, v, 9).collect()} == want
    assert met["vectors-once"].count() == len({tuple(x) for x in some.tolist()})
    met.clear()
    monkeypatch.setattr(se, "FEW", 60, raising=False)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in se.search_l2(q, v, 9).collect()} == want and not met
