"""Each stage of the pipeline against a brute-force version on its own input; null and repeated ids, clashing names, no rows."""

import base64
import collections
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.oracles import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (55, 70, 49)]
    rows = []
    for i in range(70):
        t = text(rng.randrange(20, 220))
        if i % 6 == 0:
            t = f"{t}\n{rng.choice(passages)} {text(9)}"
        if i % 10 == 3:
            t = rows[rng.randrange(len(rows))][1]
        if i % 10 == 7:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 17 == 5:
            t = text(8) if i % 2 else (text(12) + "\n") * 9 + "### $$$ %%%"
        rows.append((None if i % 13 == 4 else i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t), "7"))
    rows += [rows[2], rows[2], rows[30], (2, text(60), "en", "s1", 0, "7"), (None, None, None, None, None, "7"), (99, None, "en", "s0", 0, "7"), (98, "", "en", "s0", 0, "7"), (97, text(4000), "en", "s1", 0, "7")]
    return rows


def number(rows):
    return collections.Counter(map(str, rows))


def by_sql(name, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = con.sql(ORACLES[name])
    return [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]


def order(docs):
    """Rows as the stages order them: doc_id, null last, then the text's hash."""
    rows = [tuple(r) for r in docs.select(*COLUMNS, F.xxhash64("text").alias("m")).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each_group(docs):
    rows = order(docs)
    sets, group = [grams(r[1]) for r in rows], list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
    return [r[:-1] for i, r in enumerate(rows) if group[i] == i]


def without_repeats(docs, words=50):
    seen, out = set(), []
    for r in order(docs):
        w, gone = (r[1] or "").split(), set()
        for a in range(len(w) - words + 1):
            if tuple(w[a : a + words]) in seen:
                gone |= set(range(a, a + words))
            seen.add(tuple(w[a : a + words]))
        if not gone or len(gone) < len(w):
            out.append((r[0], [x for i, x in enumerate(w) if i not in gone]))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.createDataFrame(corpus(), SCHEMA).repartition(4).cache(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "").cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_quality_keeps_what_the_sql_keeps(stages):
    _, docs, kept = stages[0]
    want = collections.Counter((r["doc_id"], r["n_words"]) for r in by_sql("op8_quality", docs) if r["kept"])
    assert collections.Counter((r["doc_id"], len((r["text"] or "").split())) for r in kept.collect()) == want
    assert 40 < kept.count() < docs.count() and kept.columns == COLUMNS


def test_one_document_of_each_group_stays(stages):
    _, docs, kept = stages[1]
    assert number(tuple(r) for r in kept.collect()) == number(one_of_each_group(docs))
    assert kept.count() < docs.count()


def test_repeated_passages_go(stages):
    _, docs, cut = stages[2]
    assert number((r["doc_id"], (r["text"] or "").split()) for r in cut.collect()) == number(without_repeats(docs))
    assert sum(len((r["text"] or "").split()) for r in cut.collect()) < sum(len((r["text"] or "").split()) for r in docs.collect())


def test_the_mix_takes_what_the_sql_takes(stages):
    _, docs, mixed = stages[3]
    want = collections.Counter()
    for r in by_sql("op7_mix", docs):
        want[r["doc_id"], r["source_size"]] += r["taken"]
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"], size[r["source"]]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["key"] == "7"
    assert +got == +want


def test_tokens_are_the_library_s(stages):
    _, docs, out = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r["doc_id"], r["source"], hashlib.sha256(",".join(map(str, enc.encode_ordinary(r["text"]))).encode()).hexdigest()) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["source"], r["ids_sha256"]) for r in out.collect()) == want


def test_no_rows_and_no_texts(spark):
    for rows in ([], [(1, None, None, None, None, "7"), (None, "", "en", "s", 0, "7")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[1:3]:
            docs = stage(spark, docs, "")
            assert docs.columns == COLUMNS
    for _, stage in (corpus_pipeline.STAGES[0], *corpus_pipeline.STAGES[3:]):
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
