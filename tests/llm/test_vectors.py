"""Code compression and hard negatives against plain versions, on rows with nulls, odd numbers, ties and copies."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import codes, negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=700, dim=16, seed=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centre[rng.randrange(5)]
        out.append((i, [x + rng.gauss(0, 0.1) for x in c], rng.choice([0, 1, 2, 3, None])))
    copies = [(n + i, out[7][1], i % 3) for i in range(300)]  # one vector many times
    ties = [(2000 + i, [float(i % 2)] * dim, 4) for i in range(40)]
    odd = [(3000, None, 1), (3001, [None] * dim, 1), (3002, [math.nan] * dim, 1), (3003, [math.inf] + [0.0] * (dim - 1), 1), (3004, [], 2), (3005, [0.1] * (dim + 3), 2)]
    more = [(0, out[1][1], 2), (0, out[2][1], 2), (50, out[50][1], 1), (50, out[50][1], out[50][2]), (None, out[3][1], 0), (None, out[3][1], None), (2100, [0.0] * dim, 0)]
    return out + copies + ties + odd + more


def kept(data, dim=16):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    return [(i, f32(v), label) for i, v, label in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def plain_codes(data, parts=8, entries=16, rounds=6):
    data = sorted(kept(data), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(4096 * v) for v in r[1]] for r in data])
    books = [x[:entries, a:z] for a, z in codes.cuts(x.shape[1], parts)]
    near = lambda p, b: ((p[:, None] - b[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for k, (a, z) in enumerate(codes.cuts(x.shape[1], parts)):
            mine = near(x[:, a:z], books[k]).argmin(axis=1)
            books[k] = np.array([[int(s) // (mine == e).sum() for s in x[mine == e, a:z].sum(axis=0)] if (mine == e).any() else books[k][e] for e in range(len(books[k]))])
    d = [near(x[:, a:z], books[k]) for k, (a, z) in enumerate(codes.cuts(x.shape[1], parts))]
    error = sum(y.min(axis=1) for y in d)
    code = ["".join(f"{y[i].argmin():02x}" for y in d) for i in range(len(x))]
    by = {}
    for r, e in zip(data, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    text = ",".join(str(v) for b in books for row in b for v in row)
    import hashlib

    digest = hashlib.sha256(text.encode()).hexdigest()
    return [(r[0], c, int(e), by[r[2]], digest) for r, c, e in zip(data, code, error, strict=True)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_codes_are_plain_k_means(table, monkeypatch):
    want = sorted(plain_codes(rows()), key=key)
    assert sorted(map(tuple, codes.report(table).collect()), key=key) == want
    monkeypatch.setattr(codes, "BLOCK", 90)  # other blocks, the same result
    assert sorted(map(tuple, codes.report(table.repartition(2)).collect()), key=key) == want


def test_codes_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(5, [1.0, 2.0, 3.0], 1), (4, [0.0, 0.0, 0.0], None)], SCHEMA).selectExpr("*", "1 as code", "2 as error", "3 as x")
    got = {r["vec_id"]: r for r in codes.report(few).collect()}
    assert {k: r["error"] for k, r in got.items()} == {4: 0, 5: 0} and len(got[5]["code"]) == 16
    assert codes.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.report(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="magnitude"):
        codes.report(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA)).count()


def test_a_tree_holds_its_points_and_prunes():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(6, 1, 4)) * 3000 + rng.normal(size=(6, 300, 4)) * 40).astype(np.int64).reshape(-1, 4)
    tree = codes._unpack(codes.Tree(x).pack())
    assert sorted(tree["order"]) == list(range(len(x)))
    for b in range(len(tree["count"])):
        own = x[tree["order"][tree["start"][b] : tree["start"][b] + tree["count"][b]]]
        assert (own.sum(axis=0) == tree["sum"][b]).all()
        assert np.sqrt(((own - tree["centre"][b]) ** 2).sum(axis=1)).max() <= tree["radius"][b] + 1e-6
    book = x[::300] + 1
    total, number = codes.sums(tree, x, book)
    mine = codes.nearest(x, book)[0]
    assert (number == np.bincount(mine, minlength=len(book))).all() and (total == [x[mine == e].sum(axis=0) for e in range(len(book))]).all()
    compared = sum(len(r) for _, _, r, _ in codes.walk(tree, x, book))
    assert compared < len(x) / 10  # nearly all balls are owned whole
    assert (codes.entries_of(tree, x, book) == mine).all()


def plain_negatives(data):
    live = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in kept(data) if label is not None]
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (i, v, label) in enumerate(live):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for k, (j, w, m) in enumerate(live) if k != at]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, pid, _ in [r for r in scored if r[2] == label][:5]:
            found = [r for r in scored if r[2] != label and 50 * ps <= 100 * r[0] <= 95 * ps][:3]
            out += [(i, pid, k + 1, j, ps, ns) for k, (ns, j, _) in enumerate(found)]
    return sorted(out, key=key)


@pytest.mark.parametrize("grid", [False, True])
def test_negatives_are_those_of_all_pairs(table, monkeypatch, grid):
    if grid:
        monkeypatch.setattr(negatives, "HELD", 3)
        monkeypatch.setattr(negatives, "CELL", 2)
        monkeypatch.setattr(negatives, "SLICE", 4)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    want = plain_negatives(rows())
    assert len(want) > 50
    assert sorted(map(tuple, negatives.report(table).collect()), key=key) == want


def test_the_threshold_stops_early():
    rng = np.random.default_rng(5)
    n = 2000
    x = np.concatenate([rng.normal(size=(n - 20, 3)) * 20, rng.normal(size=(20, 3)) * 20 + [400, 0, 0]]).astype(np.int32)
    block = negatives.Block(np.arange(n), np.arange(n), np.zeros(n, dtype=np.int64), x)
    a, best = np.array([[256.0, 0, -10]]), negatives.Best(1, 5)
    met = negatives.meet(block, np.array([-1]), np.array([0]), a, np.full((1, 1), -np.inf), np.full((1, 1), np.inf), True, best, 0)
    score = x @ a[0]
    assert best.ids[0].tolist() == sorted(range(n), key=lambda i: (-score[i], i))[:5] and met < n / 4
    again = negatives.meet(block, np.array([-1]), np.array([0]), a, np.full((1, 1), 1e9), np.full((1, 1), np.inf), True, negatives.Best(1, 5), 0)
    assert again == 0  # the window lies above all that the lists promise


def test_negatives_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.report(empty).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA).selectExpr("*", "1 as row", "2 as score", "3 as cand")
    assert negatives.report(alone).count() == 0
    assert vectors.whole(spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)).count() == 0
