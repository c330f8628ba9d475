"""Licence scans: a trained paragraph classifier, a calibrated unknown class, and templates that confirm.

A paragraph is a line with a word; one of more than ``2 * STEP`` words is read in windows of so many, a new one every
``STEP`` words, so that a notice inside a long line is seen as well as one that stands alone. Features are hashed word 1- to
3-grams (A-Z lower-cased, ASCII punctuation a blank), scaled by the root of their number. A sparse multinomial logistic
regression over the licence families and ``unknown`` is trained here, with an L1 step that leaves most weights zero: the
families' notices below (their own and common sentences with a licence's name or identifier), with words dropped and cut short, against a bounded, hashed sample of the corpus' own windows. The
unknown class is calibrated on sampled windows and varied notices that did not train: a temperature makes the probabilities
fit them, and a family needs more than ``1 - false_rate`` of the unknown windows reach. What passes is compared with the
family's templates by shared word 3-grams (2-grams for two words; a single word is no notice), and only what agrees is
confirmed.

The sample is bounded by ``SAMPLE`` (documents, a parameter, drawn by a hash of id and text; each gives the hashes of one window of
several words, the one of least hash with its doc_id among all that it has), the model by families x buckets. The scan is one narrow pass over every whole text.
Null and empty texts have no paragraphs; families are listed once, by name; equal probabilities go to the family that comes
first by name; repeated rows are scanned each by itself; an empty corpus trains against the notices alone and gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASE, as_bytes, mix, text_batches, word_hashes
from plumbline.llm.toxicity import _PLAIN

# The wording of public licence notices, by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL-3.0 license.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright 2021 The Company. All rights reserved.", "This material is confidential and proprietary and may not be reproduced without written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
# Public names and identifiers of the licences, and the sentences that commonly name one.
NAMES = {
    "agpl": ["the GNU Affero General Public License v3.0", "AGPL-3.0-or-later"],
    "apache": ["the Apache License 2.0", "Apache-2.0"],
    "bsd": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "cc-by": ["the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-nc": ["the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "cc-by-sa": ["the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc0": ["the CC0 1.0 Universal public domain dedication", "CC0-1.0"],
    "gpl": ["the GNU General Public License v3.0", "GPL-2.0-only"],
    "isc": ["the ISC License", "ISC"],
    "lgpl": ["the GNU Lesser General Public License v3.0", "LGPL-2.1-or-later"],
    "mit": ["the MIT License", "MIT"],
    "mpl": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "unlicense": ["the Unlicense", "Unlicense"],
}
SENTENCES = ["Licensed under {0}.", "Released under the terms of {0}.", "This project is distributed under {0}.", "SPDX-License-Identifier: {1}", "License: {1}"]
for _family, _names in NAMES.items():
    TEMPLATES[_family] += [t for t in (x.format(*_names) for x in SENTENCES) if t not in TEMPLATES[_family]]
FAMILIES = sorted(TEMPLATES)
BITS, SAMPLE, COPIES, STEPS, STEP = 16, 4000, 24, 120, 12
FALSE_RATE, AGREE = 0.0005, 0.5


def paragraphs(data: bytes) -> list[bytes]:
    """Lines with a word, plain."""
    return [x for x in data.translate(_LINES).split(b"\n") if x.strip()]


_LINES = bytes(10 if c == 10 else v for c, v in enumerate(_PLAIN))


def grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word, words) of the 1- to 3-grams of a run of word hashes."""
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * BASE + h[1:]) if len(h) > 1 else h[:0]
        three = mix(two[:-1] * BASE + h[2:]) if len(h) > 2 else h[:0]
    each = (h, two, three)
    return np.concatenate(each), np.concatenate([np.arange(len(x)) for x in each]), np.repeat([1, 2, 3], [len(x) for x in each])


def compared(h: np.ndarray) -> frozenset[int]:
    """The grams of a window that templates are compared by: of three words, or two if there are only two."""
    if len(h) < 2:
        return frozenset()
    found, _, size = grams(h)
    return frozenset(found[size == min(3, len(h))].tolist())


def words_of_notice(text: str) -> np.ndarray:
    return word_hashes(text.encode().translate(_LINES))[0]


class Windows:
    """The windows of the paragraphs of one text: gram hashes with the one or two windows that each gram is in."""

    def __init__(self, parts: list[bytes]):
        n = np.array([len(p.split()) for p in parts], dtype=np.int64)
        self.h = word_hashes(b"\n".join(parts))[0]
        line, begin = np.repeat(np.arange(len(parts)), n), np.concatenate(([0], np.cumsum(n)))[:-1]
        number = np.maximum(1, -(-n // STEP) - 1)
        base = np.concatenate(([0], np.cumsum(number)))
        self.paragraph = np.repeat(np.arange(len(parts)), number)
        k = np.arange(base[-1]) - base[:-1][self.paragraph]
        self.first = begin[self.paragraph] + k * STEP
        self.last = np.minimum(self.first + 2 * STEP, (begin + n)[self.paragraph])
        found, first, size = grams(self.h)
        inside = line[first] == line[np.minimum(first + size, len(line)) - 1]
        found, first, size = found[inside], first[inside], size[inside]
        of = line[first]
        at = first - begin[of]
        k = at // STEP
        before = (k > 0) & (k < number[of]) & (at + size <= (k + 1) * STEP)
        self.grams = np.concatenate([found, found[before]])
        self.window = np.concatenate([base[:-1][of] + np.minimum(k, number[of] - 1), base[:-1][of[before]] + k[before] - 1])
        self.sizes = np.maximum(1, np.bincount(self.window, minlength=base[-1]))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def notices(seed: int = 5) -> list[tuple[int, np.ndarray]]:
    """Training windows of the families, as word hashes: each notice whole, with words dropped, and cut short."""
    rng, out = random.Random(seed), []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            words = words_of_notice(t).tolist()
            for i in range(COPIES):
                kept = [w for w in words if i == 0 or rng.random() > 0.12]
                kept = kept[: max(3, len(kept) - rng.randrange(1 + len(kept) // 3))] if i % 3 == 2 else kept
                out.append((k, np.array(kept, dtype=np.uint64)))
    return out


Model = tuple[np.ndarray, np.ndarray, float]


def train(sample: list[tuple[np.ndarray, frozenset[int]]], false_rate: float = FALSE_RATE) -> Model:
    """Sampled windows (grams, grams to compare) -> used buckets, weights (used buckets x classes), least probability of a family."""
    unlike = [g for g, own in sample if not any(agreement(own, k) >= AGREE for k in range(len(FAMILIES)))]
    known = [(k, grams(h)[0]) for k, h in notices()]
    rows = [*known, *((len(FAMILIES), g) for g in unlike[::2])]
    found = [_bucket(g) for _, g in rows]
    used = np.unique(np.concatenate(found[: len(known)]))  # what no notice has weighs nothing, but counts in the scale
    row, value, x = _sparse(found, used)
    y = np.eye(len(FAMILIES) + 1)[[k for k, _ in rows]]
    weight = (1 / np.maximum(1, y.sum(axis=0)))[y.argmax(axis=1)]
    weight *= len(rows) / weight.sum()
    w, rate = np.zeros((len(used), y.shape[1])), 40.0 / len(rows)
    for _ in range(STEPS):
        g = (_softmax(_scores(row, value, x, w, len(rows))) - y) * weight[:, None]
        w -= rate * np.stack([np.bincount(x, value * g[row, c], len(used)) for c in range(w.shape[1])], axis=1)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 0.05, 0)
    some = (w != 0).any(axis=1)
    used, w = used[some], w[some]
    tried = [*((k, grams(h)[0]) for k, h in notices(seed=6)), *((len(FAMILIES), g) for g in unlike[1::2])]
    s = _scores(*_sparse([_bucket(g) for _, g in tried], used), w, len(tried))
    label = np.array([k for k, _ in tried])
    even = (1 / np.maximum(1, np.bincount(label, minlength=w.shape[1])))[label]
    scale = min((2.0**i for i in np.arange(-3, 3.25, 0.25)), key=lambda c: -(even * np.log(_softmax(s * c)[np.arange(len(s)), label] + 1e-300)).sum())
    calm = _softmax(s[label == len(FAMILIES)] * scale)[:, :-1].max(axis=1)
    return used, (w * scale).astype(np.float32), max(0.5, float(np.quantile(calm, 1 - false_rate)) if len(calm) else 0.5)


def _sparse(found: list[np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of buckets as (row, value, column), of the used buckets."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    value = np.concatenate([np.full(len(f), 1 / np.sqrt(max(1, len(f)))) for f in found])
    x = np.concatenate(found)
    known = np.isin(x, used)
    return row[known], value[known], np.searchsorted(used, x[known])


def _scores(row: np.ndarray, value: np.ndarray, x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, value * w[x, c], n) for c in range(w.shape[1])], axis=1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_templates: dict[str, list[frozenset[int]]] = {}


def agreement(own: frozenset[int], family: int) -> float:
    """Share of grams that a window has in common with the nearest template, of the smaller of the two."""
    best = 0.0
    for t in TEMPLATES[FAMILIES[family]]:
        if t not in _templates:
            h = words_of_notice(t)
            _templates[t] = [compared(h), frozenset(grams(h)[0][grams(h)[2] == 2].tolist())]
        for grams_of in _templates[t]:
            best = max(best, len(own & grams_of) / max(1, min(len(own), len(grams_of))))
    return best


def _sample(docs: DataFrame, sample_size: int) -> list[tuple[np.ndarray, frozenset[int]]]:
    """A window of each sampled document, as hashes: bounded in number and size."""
    share = min(1.0, sample_size / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for draw, doc, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = paragraphs(t)
                w = Windows(parts) if parts else None
                several = np.flatnonzero(w.last - w.first > 1) if parts else []
                if len(several):
                    with np.errstate(over="ignore"):
                        i = several[mix(np.array([w.h[a:b].sum() for a, b in zip(w.first[several], w.last[several], strict=True)]) + np.uint64((doc or 0) & 0xFFFFFFFFFFFFFFFF)).argmin()]
                    h = w.h[w.first[i] : w.last[i]]
                    out.append((draw, doc, grams(h)[0].view(np.int64), np.array(sorted(compared(h)), dtype=np.uint64).view(np.int64)))
            cols = [*(pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)), *(pa.array([x[i] for x in out], type=pa.list_(pa.int64())) for i in (2, 3))]
            yield pa.RecordBatch.from_arrays(cols, names=["draw", "doc_id", "g", "own"])

    # a quarter more than needed is drawn in the scan, and of these the first by the hash are kept: bounded whatever the ids
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1_000_000))
    chosen = docs.select(draw.alias("draw"), F.col("doc_id").cast("long"), as_bytes().alias("t")).filter(F.col("draw") < int(min(1.0, 1.25 * share) * 1_000_000))
    rows = chosen.mapInArrow(run, "draw long, doc_id long, g array<long>, own array<long>").orderBy("draw", "doc_id", "g").limit(sample_size)
    view = lambda x: np.array(x, dtype=np.int64).view(np.uint64)
    return [(view(r["g"]), frozenset(view(r["own"]).tolist())) for r in rows.collect()]  # sample_size windows


def scan(docs: DataFrame, sample_size: int = SAMPLE) -> DataFrame:
    """documents -> doc_id, n_paragraphs, n_predicted, n_confirmed, families, found array<struct<paragraph, family, score, agreement>>."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(train(_sample(docs, sample_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = full(shared.value)
        for b in batches:
            out = []
            for t in b.columns[1].to_pylist():
                parts = paragraphs(t)
                hits = found_in(parts, model)
                out.append((len(parts), len(hits), [h for h in hits if h["agreement"] >= AGREE]))
            found = pa.array([x[2] for x in out], type=pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("agreement", pa.float64())])))
            names = [",".join(sorted({h["family"] for h in x[2]})) for x in out]
            cols = [b.columns[0], *(pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)), pa.array([len(x[2]) for x in out], type=pa.int64()), pa.array(names, type=pa.string()), found]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), as_bytes().alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, n_predicted long, n_confirmed long, families string, found array<struct<paragraph: int, family: string, score: double, agreement: double>>")


def full(model: Model) -> Model:
    """A model with a row for every bucket looked up: bucket -> place, weights with a row of zeros first, threshold."""
    used, w, least = model
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(1, len(used) + 1)
    return place, np.vstack([np.zeros(w.shape[1], dtype=np.float32), w]), least


def found_in(parts: list[bytes], model: Model) -> list[dict]:
    """For each paragraph of a text and each family predicted there: the window that agrees best, then the likeliest."""
    if not parts:
        return []
    place, w, least = model
    v = Windows(parts)
    at = place[_bucket(v.grams)]
    some = at > 0
    scores = np.zeros((len(v.first), w.shape[1]))
    np.add.at(scores, v.window[some], w[at[some]])
    p = _softmax(scores / np.sqrt(v.sizes)[:, None])
    family = p[:, :-1].argmax(axis=1)
    best: dict[tuple[int, int], dict] = {}
    for i in np.flatnonzero((p[np.arange(len(p)), family] >= least) & (v.last - v.first > 1)).tolist():
        k, key = int(family[i]), (int(v.paragraph[i]), int(family[i]))
        hit = {"paragraph": key[0], "family": FAMILIES[k], "score": float(p[i, k]), "agreement": agreement(compared(v.h[v.first[i] : v.last[i]]), k)}
        if key not in best or (hit["agreement"], hit["score"]) > (best[key]["agreement"], best[key]["score"]):
            best[key] = hit
    return [best[k] for k in sorted(best)]


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_paragraphs, n_predicted, n_confirmed, families, score (best confirmed, 0 if none)."""
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", best.alias("score"))
