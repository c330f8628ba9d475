"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

A text becomes ``len(NAMES)`` statistics (lengths, shares of kinds of characters, repetition of words, lines and word windows),
kept as integers of ``1 / UNIT``. They are standardised by the training rows' means and deviations, and ``FEATURES`` random
cosines (Rahimi and Recht 2007) of them approximate a Gaussian kernel of width ``WIDTH``; the frequencies come from a seed. Each
task sums its rows' normal equations, a matrix for each of ``FOLDS`` folds, and the sums of the tasks add up to those of the
corpus: all labelled rows take part, none is sampled. Their ridge solution scores every document. For the calibration each
training row is scored by the solution without its own fold (the total less that fold), rows are counted by label in ``BINS``
bins of the score, and pooling adjacent violators over the bins gives the isotonic curve; between the middles of its pieces the
score is interpolated, so that it stays the probability of label 1 and ranks within a piece. The fold of a row is a hash of
its statistics, so that exact copies are never on both sides.

Features are rounded to ``1 / GRAIN`` and statistics are integers, so all sums over rows are exact, and the model is the same
however rows are split over files and tasks. Every text is read once, whole; what is trained on and scored is the table of
statistics, some forty bytes a document.

Null and empty texts have the statistics of no words, and get a score like any other. A doc_id that the labels contradict teaches
nothing, nor does a null one; repeated rows count each time; without a labelled row every score is 0, and with one class all
scores are that class; long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASE, as_bytes, materialize, mix, rolling, text_batches, word_hashes
from plumbline.llm.langid import crc

NAMES = "words chars word_mean word_spread upper digit symbol bang other_ascii wide lines line_words dup_lines ends bare distinct repeat_next repeat_5 top_word tail_mark".split()
UNIT = 512
FEATURES, WIDTH, RIDGE, SEED = 256, 5.0, 1e-3, 17
GRAIN = 4096
FOLDS, BINS = 5, 512
#: Rows that are summed at once, in floating point without loss: 2^24 a product.
ROWS = 1 << 14

_KIND = np.zeros(256, dtype=np.int8)  # 0 others
_KIND[65:91], _KIND[48:58], _KIND[128:192] = 1, 2, 6  # A-Z, digits, bytes that go on a character
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3
_KIND[[ord(c) for c in "!?"]] = 4
_KIND[[ord(c) for c in "\"'()+-/:;=@[\\]^_`{}~"]] = 5
_KIND[192:] = 7  # bytes that begin a character beyond ASCII


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(data: bytes) -> np.ndarray:
    """The statistics of a text, in NAMES' order, as integers of 1 / UNIT."""
    hashes, starts, ends = word_hashes(data)
    n, raw = len(hashes), np.frombuffer(data, dtype=np.uint8)
    if not n:
        return np.zeros(len(NAMES), dtype=np.int32)
    kinds = np.bincount(_KIND[raw], minlength=8)
    goes_on = np.concatenate([[0], np.cumsum(_KIND[raw] == 6)])
    sizes = (ends - starts) - (goes_on[ends] - goes_on[starts])  # characters of words
    chars = int(sizes.sum())
    line = np.concatenate([[0], np.cumsum(raw == 10)])[starts]  # the line of each word
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    last = np.r_[first[1:], n]
    with np.errstate(over="ignore"):
        whole = rolling(hashes, first, last)
    marks = np.isin(raw[ends - 1], (33, 44, 46, 63))
    seen, times = np.unique(hashes, return_counts=True)
    windows = 0
    if n >= 5:
        with np.errstate(over="ignore"):
            at = np.arange(n - 4)
            five = rolling(hashes, at, at + 5)
        _, place, many = np.unique(five, return_inverse=True, return_counts=True)
        covered = np.zeros(n + 1, dtype=np.int64)
        twice = np.flatnonzero(many[place] > 1)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
        windows = int((np.cumsum(covered)[:n] > 0).sum())
    out = [
        np.log1p(n), np.log1p(chars), sizes.mean(), sizes.std(),
        *(_share(kinds[k], chars) for k in (1, 2, 3, 4, 5, 7)),
        np.log1p(len(first)), np.log1p(n / len(first)), _share(len(first) - len(np.unique(whole)), len(first)), marks[last - 1].mean(), ((ends - starts) == 1).mean(),
        len(seen) / n, _share((hashes[1:] == hashes[:-1]).sum(), n - 1), windows / n, times.max() / n, marks.mean(),
    ]
    return np.round(np.minimum(np.array(out, dtype=np.float64), 32) * UNIT).astype(np.int32)


def measured(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, x): the statistics; one pass over the texts."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.columns[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array(x, type=pa.list_(pa.int32()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes().alias("t")).mapInArrow(run, "doc_id long, x array<int>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Features:
    """Standardised statistics -> cosines and a constant, in whole numbers of 1 / GRAIN."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(size=(len(NAMES), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, size=FEATURES)
        self.mean, self.scale = mean, scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.concatenate([np.full((len(x), 1), GRAIN), np.round(np.cos(z) * GRAIN)], axis=1)


def _fold(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(x.shape[1], BASE, dtype=np.uint64))
        return (mix((x.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def _standard(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over the rows; sums of integers."""
    x = lambda i: F.col("x")[i].cast("long")
    sums = [f(i) for i in range(len(NAMES)) for f in (lambda i: F.sum(x(i)), lambda i: F.sum(x(i) * x(i)))]
    n, *got = rows.agg(F.count(F.lit(1)), *(s.cast("double") for s in sums)).first()  # one row
    s, q = np.array(got[::2]) / n, np.array(got[1::2]) / n
    deviation = np.sqrt(np.maximum(q - s * s, 0))
    return s, np.where(deviation > 0.5, deviation, UNIT)  # a statistic that never changes says nothing


def equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) -> (FOLDS x d x (d + 1) matrices, number of rows a fold): features by features and by label, in exact sums."""
    d = FEATURES + 1
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((FOLDS, d, d + 1), dtype=np.int64), np.zeros(FOLDS, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x, y = _matrix(b.column("x").slice(at, ROWS)), b.column("y").slice(at, ROWS).to_numpy(zero_copy_only=False)
                z, fold = shared.value(x), _fold(x)
                number += np.bincount(fold, minlength=FOLDS)
                for k in np.unique(fold):
                    own = fold == k
                    total[k] += (z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)).astype(np.int64)
        for k in np.flatnonzero(number):
            rows_ = [np.r_[number[k], r] for r in total[k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d) + k * d, type=pa.int32()), pa.array(rows_, type=pa.list_(pa.int64()))], names=["cell", "v"])

    def add(t: pa.Table) -> pa.Table:  # a row a task
        v = np.sum([c.flatten().to_numpy().reshape(len(c), -1).sum(axis=0) for c in t.column("v").chunks], axis=0)
        return pa.table({"cell": t.column("cell").slice(0, 1), "v": pa.array([v], type=pa.list_(pa.int64()))})

    parts = rows.select("x", "y").mapInArrow(run, "cell int, v array<long>")
    got = parts.groupBy("cell").applyInArrow(add, "cell int, v array<long>").toArrow()  # FOLDS matrices
    total, number = np.zeros((FOLDS, d, d + 1)), np.zeros(FOLDS)
    for cell, v in zip(got.column("cell").to_pylist(), got.column("v").to_pylist(), strict=True):
        number[cell // d], total[cell // d, cell % d] = v[0], v[1:]
    return total, number


def solve(total: np.ndarray, n: float) -> np.ndarray:
    """Ridge weights of summed equations over n rows; the constant is not held back."""
    a, held = total[:, :-1], np.full(len(total), RIDGE * n * GRAIN * GRAIN)
    held[0] = 0
    return np.linalg.solve(a + np.diag(held + 1e-9 * GRAIN * GRAIN), total[:, -1])


def isotonic(ones: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bin -> (place, value) of the pieces of the rising curve nearest to the shares; a row is added to each piece, half of each label."""
    stack: list[list[float]] = []  # ones, all, sum of place x all
    for i in np.flatnonzero(all_):
        stack.append([ones[i], all_[i], (i + 0.5) * all_[i]])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            last = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], last, strict=True)]
    pieces = np.array(stack).reshape(-1, 3)
    return pieces[:, 2] / pieces[:, 1], np.maximum.accumulate((pieces[:, 0] + 0.5) / (pieces[:, 1] + 1))


def _bin(s: np.ndarray) -> np.ndarray:
    """The place of a raw score among the bins, from -0.5 to 1.5."""
    return np.clip((s + 0.5) / 2, 0, 1 - 1e-9) * BINS


def train(measures: DataFrame, labels: DataFrame) -> tuple | float:
    """(doc_id, x) and (doc_id, quality) -> the model, or the one score of a corpus without both classes."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z")
    rows = materialize(measures.join(known, "doc_id").select("x", F.col("y").cast("double").alias("y")), "quality-known")
    have = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}  # two classes
    if len(have) < 2:
        return next(iter(have), 0.0)
    features = Features(*_standard(rows))
    total, number = equations(rows, features)
    weights = solve(total.sum(axis=0), number.sum())
    without = np.array([solve(total.sum(axis=0) - total[k], max(1.0, number.sum() - number[k])) for k in range(FOLDS)])
    shared = rows.sparkSession.sparkContext.broadcast((features, without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), dtype=np.int64)
        features, without = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x, y = _matrix(b.column("x").slice(at, ROWS)), b.column("y").slice(at, ROWS).to_numpy(zero_copy_only=False).astype(int)
                np.add.at(counts, (y, _bin((features(x) * without[_fold(x)]).sum(axis=1)).astype(int)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(counts[1]), pa.array(counts.sum(axis=0))], names=["bin", "ones", "n"])

    bins = rows.mapInArrow(run, "bin int, ones long, n long").groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).orderBy("bin").toPandas()  # BINS rows
    return features, weights, isotonic(bins["ones"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float))


def score(measures: DataFrame, model: tuple | float) -> DataFrame:
    """(doc_id, x) -> (doc_id, score)."""
    if isinstance(model, float):
        return measures.select("doc_id", F.lit(model).alias("score"))
    shared = measures.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        features, weights, (place, value) = shared.value
        if not len(x):
            return pd.Series([], dtype="float64")
        raw = (features(np.stack(x.to_numpy()).astype(np.float64)) * weights).sum(axis=1)
        return pd.Series(np.interp(_bin(raw), place, value))

    return measures.select("doc_id", probability("x").alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted; learnt from labelled documents that are not held out."""
    measures = materialize(measured(docs), "quality-measures")
    held = crc() % 5 == 0
    model = train(measures, labels.filter(~held))
    return score(measures, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
