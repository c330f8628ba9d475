"""The licence classifier against a plain version, notices inside lines, and wordings that did not train."""

import math
import random

import numpy as np
import pytest

from plumbline.llm import licenses
from plumbline.llm.common import word_hashes

SYLLABLES = ("ba", "ke", "li", "mo", "su", "ra", "ti", "no")


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randrange(1, 5))) for _ in range(n))


def window(text):
    h = licenses.words_of_notice(text)
    return licenses.grams(h)[0], licenses.compared(h)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(1)
    return [window(prose(rng, rng.randrange(2, 25))) for _ in range(600)]


def plain(parts, model):
    """Best (agreement, probability) by paragraph and family, window by window."""
    used, w, least = model
    weight = {int(b): w[i].astype(float) for i, b in enumerate(used)}
    out = {}
    for i, part in enumerate(parts):
        words = part.split()
        last = max(1, math.ceil(len(words) / licenses.STEP) - 1)
        for k in range(last):
            h = word_hashes(b" ".join(words[k * licenses.STEP : k * licenses.STEP + 2 * licenses.STEP]))[0]
            g = licenses.grams(h)[0]
            s = sum((weight.get(int(b), np.zeros(w.shape[1])) for b in licenses._bucket(g)), np.zeros(w.shape[1])) / math.sqrt(len(g))
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            f = int(p[:-1].argmax())
            if p[f] >= least and len(h) > 1:
                key = (i, licenses.FAMILIES[f])
                out[key] = max(out.get(key, (0.0, 0.0)), (licenses.agreement(licenses.compared(h), f), float(p[f])))
    return out


def test_scores_are_those_of_the_plain_version(sample):
    rng, model = random.Random(2), licenses.train(sample)
    notes = [t for family in licenses.FAMILIES for t in licenses.TEMPLATES[family]]
    for _ in range(60):
        lines = [" ".join([prose(rng, rng.randrange(60)), *rng.sample(notes, rng.randrange(3)), prose(rng, rng.randrange(60))]) for _ in range(rng.randrange(4))]
        parts = licenses.paragraphs("\n".join(lines).encode())
        got = {(h["paragraph"], h["family"]): (h["agreement"], h["score"]) for h in licenses.found_in(parts, licenses.full(model))}
        want = plain(parts, model)
        assert got.keys() == want.keys()
        for key, x in want.items():
            assert got[key] == pytest.approx(x, abs=1e-5)


def test_notices_are_found_alone_and_inside_a_line(sample):
    rng, model = random.Random(3), licenses.full(licenses.train(sample))
    confirmed = lambda text: {h["family"] for h in licenses.found_in(licenses.paragraphs(text.encode()), model) if h["agreement"] >= licenses.AGREE}
    for text, family in (("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("All rights reserved.", "proprietary"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc")):
        assert confirmed(text) == {family}
        assert confirmed(f"{prose(rng, 70)} {text} {prose(rng, 70)}") == {family}
    assert confirmed("MIT License") == {"mit"}
    assert not any(confirmed(prose(rng, n)) for n in range(1, 300))
    assert confirmed("") == confirmed("\n \n") == set()


def test_wordings_that_did_not_train(sample, monkeypatch):
    """Each notice in turn is left out of training and of the templates; the family is known by its other notices."""
    hits = {"predicted": 0, "of": 0}
    for i in range(max(map(len, licenses.TEMPLATES.values()))):
        kept = {k: [t for j, t in enumerate(v) if j != i or len(v) == 1] for k, v in licenses.TEMPLATES.items()}
        out = [(k, v[i]) for k, v in licenses.TEMPLATES.items() if len(v) > max(1, i)]
        with monkeypatch.context() as m:
            m.setattr(licenses, "TEMPLATES", kept)
            m.setattr(licenses, "_templates", {})
            model = licenses.full(licenses.train(sample))
            for family, text in out:
                got = licenses.found_in(licenses.paragraphs(text.encode()), model)
                hits["predicted"] += any(h["family"] == family for h in got)
                hits["of"] += 1
    assert hits["of"] >= 100 and hits["predicted"] / hits["of"] >= 0.75, hits
