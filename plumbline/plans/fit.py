"""Fitting the scoring artifact: one pass for the moments, a small solve, one pass for variances and limits.

The published artifact comes ready-made; how it was trained is not. This is a companion of our own: kernel PLS on the
cross-products (Dayal and MacGregor 1997), limits as empirical quantiles of the training rows' statistics, of exact rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.model import Model
from plumbline.operators.monitor import score
from plumbline.operators.readings import feature_columns
from plumbline.sources.shared import materialize


def _moments(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of features and target; null rows are left out. A row of (J+1)^2 numbers a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
        for b in batches:
            x = b.dropna().to_numpy(dtype=float)
            n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        yield pd.DataFrame({"i": np.arange(len(cols) * (len(cols) + 1) + 1), "v": np.concatenate([[n], s, c.ravel()])})

    rows = df.select(*cols).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    k = len(cols)
    return (rows[0], rows[1 : k + 1], rows[k + 1 :].reshape(k, k)) if len(rows) else (0.0, np.zeros(k), np.zeros((k, k)))


def kernel_pls(xx: np.ndarray, xy: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and loadings (J x A) from X'X and X'y of standardised data."""
    r_all, p_all = [], []
    for _ in range(components):
        w = xy / (np.linalg.norm(xy) or 1.0)
        r = w - sum(((p @ w) * q for p, q in zip(p_all, r_all, strict=True)), np.zeros_like(w))
        tt = float(r @ xx @ r)
        if tt <= 1e-12 * max(1.0, float(np.trace(xx))):
            break
        p = xx @ r / tt
        xy = xy - p * float(r @ xy)
        r_all.append(r)
        p_all.append(p)
    if not r_all:
        raise ValueError("features explain nothing of the target")
    return np.array(r_all).T, np.array(p_all).T


def quantile_of(rows: DataFrame, c: str, n: int, quantile: float, accuracy: int = 10_000) -> float:
    """The value of rank ceil(quantile * n), exactly: approximate quantiles bound it, and the few rows between them are ranked."""
    rank, near = math.ceil(Fraction(str(quantile)) * n), 2 / accuracy
    lo, hi = rows.agg(F.percentile_approx(c, [max(0.0, quantile - near), min(1.0, quantile + near)], accuracy)).first()[0]
    below, upto = rows.agg(F.count_if(F.col(c) < lo), F.count_if(F.col(c) <= hi)).first()
    if not below < rank <= upto:
        lo, hi, below = float("-inf"), float("inf"), 0
    return rows.filter(F.col(c).between(lo, hi)).orderBy(c).offset(rank - below - 1).limit(1).first()[c]


def fit_model(readings: DataFrame, components: int = 2, quantile: float = 0.99) -> Model:
    cols = feature_columns(readings)
    n, s, c = _moments(readings, [*cols, "target"])
    if n < 2:
        raise ValueError("no rows to fit on")
    mean = s / n
    cov = c / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale == 0] = 1.0
    z = cov / np.outer(scale, scale)
    r, p = kernel_pls(z[:-1, :-1], z[:-1, -1], components)
    lam = np.maximum(np.diag(r.T @ z[:-1, :-1] @ r), 1e-12)
    j = len(cols)
    rows = lambda m: tuple(map(tuple, m.tolist()))
    model = Model(tuple(mean[:-1].tolist()), tuple(scale[:-1].tolist()), (0.0,) * j, (1.0,) * j, rows(r), rows(p), tuple(lam.tolist()), 0.0, 0.0, tuple(cols))
    scores = materialize(score(readings, model).select("t2", "spe"), "scores")
    scored = scores.count()
    return replace(model, ucl_t2=quantile_of(scores, "t2", scored, quantile), ucl_spe=quantile_of(scores, "spe", scored, quantile))
