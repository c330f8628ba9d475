"""Codewords: loss-weighted decoding against a plain version, ambiguity, ties, and texts longer than a piece."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def plain(text, model):
    """(language, score, ambiguous) by sums over n-grams and a loop over codewords."""
    languages, code, weights = model
    got = langid.grams(text.lower().encode())
    margin = [sum(float(weights[g, b]) for g in got) / len(got) * min(len(got), langid.SURE) * langid.SCALE for b in range(code.shape[1])]
    loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margin, strict=True)) for word in code]
    share = [math.exp(min(loss) - x) for x in loss]
    share = [x / sum(share) for x in share]
    best = min(range(len(share)), key=lambda i: (-share[i], i))
    return languages[best], share[best], len(share) > 1 and sorted(share)[-2] > share[best] / 4


def test_decoding_is_that_of_the_plain_version(spark):
    rng = random.Random(1)
    alphabets = {"aa": "bakelo ", "bb": "zixuqy ", "cc": "bakezi ", "dd": "ñéíóú "}
    text = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    rows = [(i, text(k, 80), k) for i in range(240) for k in [sorted(alphabets)[i % 4]]]
    model = langid.train(spark.createDataFrame([*rows, *rows[:30], (900, None, "aa"), (901, "bake", None)], SCHEMA))
    assert model[0] == sorted(alphabets) and model[1].shape == (4, 7)
    tests = [text(rng.choice("abcd") * 2, rng.randrange(1, 60)) for _ in range(60)] + [text("aa", 20) + text("bb", 20), "b", "é", text("dd", 70_000)]
    tests = [t for t in tests if t.strip()]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(tests)], SCHEMA)
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for i, t in enumerate(tests):
        want = plain(t, model)
        assert (got[i]["lang_pred"], got[i]["ambiguous"]) == (want[0], want[2]) and got[i]["score"] == pytest.approx(want[1], abs=1e-4)
    assert any(r["ambiguous"] for r in got.values()) and not all(r["ambiguous"] for r in got.values())


def test_codewords_stand_apart():
    for n in (2, 3, 5, 7, 12, 40):
        code = langid.codebook(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (2 ** (n - 2) if n <= 7 else 5) and (np.abs(code.sum(axis=0)) < n).all()
