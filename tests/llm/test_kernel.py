"""The quality classifier: its statistics, its sums, its calibration, and what it does on a made-up corpus."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import kernel

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randrange(1, 9)))
    docs, labels = [], []
    for i in range(n):
        w, bad = [word() for _ in range(rng.randrange(8, 150))], i % 4 == 0
        text = (" ".join(w).upper() if i % 8 else " ".join(x + "***" for x in w)) if bad else " ".join(w) + "."
        docs.append((i, text, "en"))
        labels.append((i, int(not bad), 0))
    docs += [(n, None, None), (n + 1, "", None), (n + 2, " \n ", "en"), (n + 3, "word " * 200_000, "en"), (None, "no id", "en"), (3, docs[3][1], "en"), (n + 4, "x", "en")]
    labels += [(None, 1, 0), (n + 4, 1, 0), (n + 4, 0, 0), (n + 3, None, 0), (9999, 1, 1), (5, 1, 0)]
    return docs, labels


def test_statistics():
    name = lambda t: dict(zip(kernel.NAMES, kernel.statistics(t.encode()) / kernel.UNIT, strict=True))
    assert not kernel.statistics(b"").any() and not kernel.statistics(b" \n\t").any()
    s = name("One two.\nÜber zwei zwei\nOne two.")
    assert s["words"] == pytest.approx(np.log1p(7), abs=0.01) and s["chars"] == pytest.approx(np.log1p(26), abs=0.01)
    assert s["dup_lines"] == pytest.approx(1 / 3, abs=0.01) and s["ends"] == pytest.approx(2 / 3, abs=0.01)
    assert s["distinct"] == pytest.approx(4 / 7, abs=0.01) and s["repeat_next"] == pytest.approx(1 / 6, abs=0.01)
    assert s["upper"] == pytest.approx(2 / 26, abs=0.01) and s["wide"] == pytest.approx(1 / 26, abs=0.01)
    assert name("a b c d e a b c d e f")["repeat_5"] == pytest.approx(10 / 11, abs=0.01)
    assert name("x*** y&&&")["symbol"] == pytest.approx(6 / 8, abs=0.01)


def test_equations_are_those_of_the_whole(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2000, size=(300, len(kernel.NAMES))), rng.integers(0, 2, size=300)
    rows = spark.createDataFrame([([int(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)], "x array<int>, y double")
    features = kernel.Features(*kernel._standard(rows))
    assert np.allclose(features.mean, x.mean(axis=0)) and np.allclose(features.scale, x.std(axis=0))
    got = [kernel.equations(rows.repartition(k), features) for k in (1, 7)]
    assert (got[0][0] == got[1][0]).all() and (got[0][1] == got[1][1]).all()  # the same, to the last bit
    z = features(x.astype(float))
    assert (got[0][0].sum(axis=0) == np.concatenate([z.T @ z, z.T @ y[:, None]], axis=1)).all() and got[0][1].sum() == 300


def test_features_are_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(kernel, "FEATURES", 8192)
    d = len(kernel.NAMES)
    f = kernel.Features(np.zeros(d), np.ones(d))
    a, b = np.random.default_rng(4).normal(size=(2, 1, d))
    near = 2 * (f(a)[0, 1:] @ f(b)[0, 1:]) / 8192 / kernel.GRAIN**2
    assert near == pytest.approx(np.exp(-((a - b) ** 2).sum() / 2 / kernel.WIDTH**2), abs=0.05)


def test_isotonic():
    ones, all_ = np.array([0, 3, 1, 0, 8, 9]), np.array([10, 10, 10, 0, 10, 9])
    place, value = kernel.isotonic(ones.astype(float), all_.astype(float))
    assert value == pytest.approx([0.5 / 11, 4.5 / 21, 8.5 / 11, 9.5 / 10]) and place == pytest.approx([0.5, 2.0, 4.5, 5.5])


def test_report(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as x", "2 as score", "3 as y", "4 as quality")
    lab = spark.createDataFrame(labels, LABELS).selectExpr("*", "7 as text")
    got = kernel.report(d.repartition(3), lab).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 50 and sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)
    again = kernel.report(d.repartition(8, "text"), lab.repartition(4)).collect()  # the rows split otherwise
    assert sorted(map(str, got)) == sorted(map(str, again))
    # labels of held-out rows teach nothing
    turned = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, kernel.report(d, turned).collect())) == sorted(map(str, got))


def test_without_both_classes(spark):
    docs, labels = corpus(20)
    d = spark.createDataFrame(docs, DOCS)
    only = lambda q: [r for r in labels if r[0] is not None and r[1] == q and r[0] < 20]
    assert {r["score"] for r in kernel.report(d, spark.createDataFrame(only(1), LABELS)).collect()} == {1.0}
    assert {r["score"] for r in kernel.report(d, spark.createDataFrame([], LABELS)).collect()} == {0.0}
    assert kernel.report(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
