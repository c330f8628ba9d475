"""Samples that classifiers learn from: bounded whatever the ids, and the same model however rows are split over files."""

import random

import numpy as np
import pytest

from plumbline.llm import langid, licenses, toxicity

SCHEMA = "doc_id long, text string, lang string"


def texts(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    return [" ".join(word() for _ in range(12)) for _ in range(n)]


IDS = {"null": lambda i: None, "five": lambda i: i % 5, "one": lambda i: 1, "own": lambda i: i}


@pytest.mark.parametrize("ids", sorted(IDS))
def test_licence_windows(spark, ids):
    df = spark.createDataFrame([(IDS[ids](i), t, "en") for i, t in enumerate(texts(900))], SCHEMA).repartition(4)
    assert 250 <= len(licenses._sample(df, 300)) <= 300 and len(licenses._sample(df, 1000)) == 900
    same = spark.createDataFrame([(IDS[ids](0), "alike in every word", "en")] * 900, SCHEMA)
    assert len(licenses._sample(same, 300)) in (0, 300)  # they draw together; none stands for all then


@pytest.mark.parametrize("ids", sorted(IDS))
def test_rows_of_a_language(spark, ids):
    rows = [(IDS[ids](i), t, "aa" if i % 4 else "bb") for i, t in enumerate(texts(1200))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["lang"]: r["count"] for r in langid.sample(df, "lang", 400, "doc_id", "text").groupBy("lang").count().collect()}
    assert got == {"aa": 400, "bb": 300}
    one = {tuple(r) for r in langid.sample(df, "lang", 100, "doc_id", "text").collect()}
    assert one == {tuple(r) for r in langid.sample(df.repartition(7, "text"), "lang", 100, "doc_id", "text").collect()} and len(one) == 200


def labelled(spark, n=300, ids=lambda i: i):
    rng = random.Random(3)
    rows = [(ids(i), t + (" vile" * (1 + rng.randrange(3)) if i % 3 == 0 else " mild"), "en") for i, t in enumerate(texts(n))]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_weights_do_not_depend_on_files(spark, tmp_path):
    docs, labels = labelled(spark)
    want = toxicity.train(docs, labels)
    assert np.count_nonzero(want) > 1
    for k, (parts, size, group) in enumerate(((1, "128m", None), (6, "4k", 4096), (2, "16k", 512))):
        writer = docs.repartition(parts).write
        (writer.option("parquet.block.size", group) if group else writer).parquet(str(tmp_path / str(k)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert (toxicity.train(spark.read.parquet(str(tmp_path / str(k))), labels.repartition(parts)) == want).all()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shards_are_bounded(spark, monkeypatch):
    docs, labels = labelled(spark)
    sizes = lambda r: np.frombuffer(r["sizes"], dtype=np.int32)
    seen = []
    pack = toxicity.pack
    monkeypatch.setattr(toxicity, "pack", lambda rows, values=700: seen.append(pack(rows, values)) or seen[-1])
    toxicity.train(docs, labels)
    shards = seen[0].collect()
    assert len(shards) == toxicity.SHARDS and all(500 < sizes(r).sum() <= 700 and len(r["x"]) == 4 * sizes(r).sum() for r in shards)


def test_repeated_and_contradicted_labels(spark):
    docs, labels = labelled(spark)
    want = toxicity.train(docs, labels)
    assert (toxicity.train(docs, labels.union(labels).union(labels.limit(0))) == want).all()
    more = docs.union(docs.filter("doc_id = 0").withColumn("doc_id", docs["doc_id"] + 5000))
    odd = labels.union(spark.createDataFrame([(5000, 0), (5000, 1), (None, 1), (7000, None)], "doc_id long, toxic int"))
    assert (toxicity.train(more, odd) == want).all()
    # one id in a third of all rows: its copies fill the class's bound and no more
    copies = docs.union(spark.createDataFrame([(3, f"text number {i} vile", "en") for i in range(150)], SCHEMA))
    seen = []
    pack = toxicity.pack
    toxicity.pack, keep = (lambda rows: seen.append(pack(rows)) or seen[-1]), pack
    try:
        toxicity.train(copies, labels, per_class=120)
    finally:
        toxicity.pack = keep
    y = np.concatenate([np.frombuffer(r["y"]) for r in seen[0].collect()])
    assert (y == 1).sum() <= 120 and (y == 0).sum() <= 120 and (y == 1).sum() > 80
