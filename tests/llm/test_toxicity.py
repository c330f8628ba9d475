"""FTRL-proximal against a scalar version, the threshold against all thresholds, and accuracy on rows that were not learnt."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import toxicity


def scalar(rows, epochs):
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for y, x in rows:
            value = {i: 1.0 if i < toxicity.HALF else toxicity.PAIR for i in x}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * value[i] for i in x)))
            for i in x:
                g = (p - y) * (toxicity.POSITIVE if y else 1.0) * value[i]
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_is_the_scalar_version():
    rng = random.Random(1)
    rows = [(float(i % 3 == 0), sorted({0, *rng.sample(range(40), 8), *(toxicity.HALF + j for j in rng.sample(range(40), 8))} | ({41} if i % 3 == 0 else set()))) for i in range(60)]
    z, n = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    toxicity.ftrl([(y, np.array(x)) for y, x in rows], z, n, 5)
    got, want = toxicity.weights_of(z, n), scalar(rows, 5)
    assert {i: got[i] for i in want} == pytest.approx(want) and 0 < np.count_nonzero(got) < len(want) and got[41] > 0


def test_the_threshold_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for n in (2, 5, 40):
        y = np.append(rng.integers(0, 2, n), [0.0, 1.0])
        s, weight = np.round(rng.normal(size=n + 2) + y, 1), rng.uniform(0.5, 3, n + 2)
        f1 = lambda t: 2 * (weight * y)[s >= t].sum() / (weight[s >= t].sum() + (weight * y).sum())  # noqa: B023, E731
        assert f1(toxicity.cut_at(s, y, weight)) == pytest.approx(max(f1(t) for t in s))
    assert toxicity.cut_at(s, np.zeros_like(s), weight) == 0


def test_buckets_of_long_texts_are_those_of_short_ones():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    long, seen = toxicity.features(" ".join(words).encode()), {0}
    for a in range(0, len(words), 1000):  # three words of overlap hold every pair
        seen |= set(toxicity.features(" ".join(words[max(0, a - 3) : a + 1000]).encode()).tolist())
    assert set(long.tolist()) == seen and len(words) * 4 > 1 << 16
    assert toxicity.features(b"").tolist() == [0] and (toxicity.values(long) == toxicity.PAIR).sum() == (long >= toxicity.HALF).sum()
