"""Null and repeated doc_ids through the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("bakelo").join(rng.sample("dfghjmnprstvz", 3)) for _ in range(n)]


def test_mix_takes_what_the_plan_says_of_null_and_repeated_ids(spark):
    rng = random.Random(4)
    text = lambda: " ".join(words(rng, 150))
    twice = text()
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(12)] + [(1, twice, "en", "s1", 0)] * 3 + [(5, text(), "en", "s2", 0)]
    rows += [(None, text(), "en", f"s{i % 2}", 0) for i in range(4)] + [(None, text(), "en", None, 0), (None, None, None, None, None), (13, None, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken, sources = {}, {}
    for r in mixing.plan(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
        sources[r["source"]] = sources.get(r["source"], 0) + r["taken"]
    assert taken[None] and taken[1]
    mixed = mixing.apply(docs).withColumn("n", mixing.size())
    for by, want in (("doc_id", taken), ("source", sources)):
        got = {r[by]: r["n"] for r in mixed.groupBy(by).agg(F.sum("n").alias("n")).collect()}
        assert got == {k: n for k, n in want.items() if n}, by
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.apply(docs.repartition(5)).withColumn("n", mixing.size()).collect()))


def test_one_survivor_of_a_group_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(words(rng, 90)) for _ in range(4))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(2, b), (1, a), (1, a), (None, a), (3, a), (None, near), (None, c), (None, c), (4, d), (None, None), (None, None), (5, " "), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (None, c), (4, d), (5, " ")], key=str)


@pytest.mark.parametrize(("chunk", "rows"), [(128, 512), (2, 3)])
def test_links_are_those_of_exact_similarity(spark, monkeypatch, chunk, rows):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "MOST_ROWS", rows)
    rng, texts = random.Random(6), []
    for _ in range(150):  # 6 to 30 words and some longer; words cut off the end or changed there
        base = words(rng, rng.choice([*range(8, 31), 120, 200]))
        texts.append(base)
        n = max(1, round(len(base) * rng.uniform(0.1, 0.3)))
        texts.append(base[:-n])
        m = max(1, round(len(base) * rng.uniform(0.08, 0.15)))
        texts.append(base[:-m] + words(rng, m))
    texts.append(texts[0] + texts[0][-5:] * 40)  # a passage over and over
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} for w in texts]
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    assert sum(0.75 <= x < 0.8 for x in like.values()) >= 10 and sum(0.8 <= x <= 0.85 for x in like.values()) >= 10
    root = list(range(len(texts)))
    for _ in range(5):
        for (i, j), x in like.items():
            if x >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in simhash.keep(docs).select("doc_id").collect()} == {i for i, r in enumerate(root) if i == r}
