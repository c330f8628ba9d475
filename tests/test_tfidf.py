"""TF-IDF in numbers: the sketch of frequent terms, rows packed in one pass, and indexes that grow."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import BLANKS, strip
from plumbline.operators import tfidf as tf


def words(t):
    return re.findall(r"[a-z]{2,}", t or "")


def grams(t):
    w = words(t)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def corpus(n=60, seed=1, vocabulary=80):
    rng = random.Random(seed)
    letters = "abcdefghij"
    known = [letters[i // 10] + letters[i % 10] for i in range(vocabulary)]
    texts = [" ".join(known[min(int(rng.expovariate(0.08)), vocabulary - 1)] for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return list(enumerate([*texts, "", None, " ", "zz", texts[3]]))


def plain(texts, k):
    total, df = Counter(), Counter()
    for _, t in texts:
        total.update(grams(t))
        df.update(set(grams(t)))
    top = sorted(total, key=lambda x: (-total[x], x))[:k]
    idf = {x: math.log((1 + len(texts)) / (1 + df[x])) + 1 for x in top}
    rows = {}
    for i, t in texts:
        w = {x: n * idf[x] for x, n in Counter(grams(t)).items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows[i] = {x: round(v / norm, 9) for x, v in w.items()}
    return [(x, total[x], df[x]) for x in top], {i: r for i, r in rows.items() if r}


def vectors(index):
    out = {}
    for r in index["vectors"].collect():
        out.setdefault(r["chunk_id"], {})[r["term"]] = round(r["weight"], 9)
    return out


def vocabulary(df):
    return [(r["term"], r["total"], r["df"]) for r in df.orderBy("at").collect()]


def table(spark, texts, parts=4):
    return spark.createDataFrame([(i, f"s{i % 3}", f"p/{i}", t) for i, t in texts], "chunk_id long, source_file string, file_path string, text string").repartition(parts)


def test_the_index_is_the_plain_one(spark):
    texts = corpus()
    terms, rows = plain(texts, 50)
    index = tf.build_index(table(spark, texts), 50)
    assert vocabulary(index["vocabulary"]) == terms and vectors(index) == rows
    packed = index["packed"].collect()
    assert all(r["places"] == sorted(set(r["places"])) and abs(sum(w * w for w in r["weights"]) - 1) < 1e-12 for r in packed)
    plan = tf.pack(table(spark, texts, 1), index["vocabulary"], "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition of the test's table


@pytest.mark.parametrize("counters", [20, 200, 10_000])
def test_counters_bound_the_counts(spark, counters):
    texts = corpus(200)
    total = Counter(g for _, t in texts for g in grams(t))
    rows = {r["term"]: r["low"] for r in tf.heavy_terms(table(spark, texts, 3), counters=counters).collect()}
    error = rows.pop(None)
    assert all(total[t] - error <= n <= total[t] for t, n in rows.items())
    assert all(n <= error for t, n in total.items() if t not in rows)
    assert error <= sum(total.values()) / counters and len(rows) <= 3 * counters
    assert (error == 0) == (counters == 10_000)


@pytest.mark.parametrize("counters", [5, 60, 400])
def test_the_vocabulary_is_exact_whatever_the_counters(spark, monkeypatch, counters):
    texts = corpus(200)
    settled = tf.candidates(table(spark, texts, 3), 20, counters=counters)
    assert (settled is None) == (counters == 5)  # five counters do not tell which twenty are first
    if counters == 60:
        assert len(settled) < len({g for _, t in texts for g in grams(t)}) / 2
    assert tf.candidates(table(spark, texts, 3), 20, counters=400, most=10) is None
    monkeypatch.setattr(tf, "candidates", lambda *a, f=tf.candidates: f(*a, counters=counters))
    assert vocabulary(tf.fit_vocabulary(table(spark, texts), 20)) == plain(texts, 20)[0]


def test_a_grown_index_is_one_built_at_once(spark):
    texts = corpus()
    other = [(100 + i, (t or "") + " " + t2) for (i, t), t2 in zip(corpus(40, seed=9, vocabulary=30), ["xx yy xx yy zz"] * 40, strict=False)]
    last = [(500, "xx yy"), (501, None), (502, "qq qq qq")]
    index = tf.build_index(table(spark, texts), 40, growable=True)
    for more, so_far in ((other, texts + other), (last, texts + other + last)):
        index = tf.append_texts(index, table(spark, more, 2), 40)
        terms, rows = plain(so_far, 40)
        assert vocabulary(index["vocabulary"]) == terms and vectors(index) == rows
        assert index["chunks"].count() == len(so_far)
    assert "xx yy" in {t for t, *_ in terms}  # terms came in, and old rows had some of them
    with pytest.raises(ValueError, match="in the index"):
        tf.append_texts(index, table(spark, last, 1), 40)
    with pytest.raises(ValueError, match="growable"):
        tf.append_texts(tf.build_index(table(spark, texts), 40), table(spark, last), 40)


def test_terms_that_enter_are_found_in_old_texts(spark):
    old = [(i, "aa bb") for i in range(5)] + [(5, "cc dd"), (6, "cc aa"), (7, "")]
    new = [(10 + i, "cc cc dd") for i in range(9)]
    index = tf.append_texts(tf.build_index(table(spark, old), 3, growable=True), table(spark, new), 3)
    terms, rows = plain(old + new, 3)
    assert [t for t, *_ in terms] == ["cc", "dd", "cc cc"] or "cc" in {t for t, *_ in terms}
    assert vocabulary(index["vocabulary"]) == terms and vectors(index) == rows and 5 in rows and 0 not in rows


def test_no_texts(spark):
    none = table(spark, corpus()).limit(0)
    for growable in (False, True):
        with pytest.raises(ValueError, match="no texts"):
            tf.build_index(none, growable=growable)
    blank = tf.build_index(table(spark, [(1, ""), (2, None)]))
    assert blank["vocabulary"].count() == 0 and blank["packed"].count() == 0
    assert tf.embed(table(spark, [(3, "aa")]).select("chunk_id", "text"), blank["vocabulary"], "chunk_id").agg(F.count("term")).first()[0] == 0


def test_terms_are_counted_in_their_row(spark, monkeypatch):
    """Term counts and totals against plain counters, in pieces of few tokens; texts that share a key count together."""
    from collections import Counter

    monkeypatch.setattr(tf, "PIECE", 7)
    monkeypatch.setattr(tf, "HELD", 20)
    texts = [(1, "aa bb aa bb aa"), (2, None), (3, ""), (4, "cc"), (5, " ".join(f"w{i % 13}" for i in range(60))), (5, "aa w1 w2"), (None, "aa aa")]
    grams = lambda t: (w := (t or "").split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for rows in (texts, texts[:5]):
        df = spark.createDataFrame(rows, "id long, text string").repartition(2)
        want = Counter((i, g) for i, t in rows for g in grams(t))
        got = tf.term_counts(df, "id").collect()
        assert {(r["id"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)
        total, df_ = Counter(g for _, t in rows for g in grams(t)), Counter(g for _, t in rows for g in set(grams(t)))
        assert {(r["term"], r["total"], r["df"]) for r in tf.term_totals(df).collect()} == {(t, n, df_[t]) for t, n in total.items()}


def test_counting_terms_shuffles_no_terms(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "cc dd")], "id long, text string")
    assert "Exchange hashpartitioning(key" not in tf.term_counts(df, "id")._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_and_found_as_numbers():
    """Pairs of a piece are counted without being put together, and those that it has once are left out if it has many terms."""
    rng = random.Random(2)
    lists = [[rng.choice(["a", "b", "c", "ab", "é", "漢"]) for _ in range(rng.choice([0, 1, 2, 9]))] for _ in range(40)] + [None, ["once", "only"]]
    tokens = pa.array(lists, type=pa.list_(pa.string()))
    each = [[*(x or []), *(f"{a} {b}" for a, b in zip(x or [], (x or [])[1:], strict=False))] for x in lists]
    true = Counter(t for x in each for t in x)
    got, missed = tf._counted(tokens, len(true))
    assert dict(zip(got["term"].to_pylist(), got["n"].to_pylist(), strict=True)) == true and not missed
    got, missed = tf._counted(tokens, len(true) - 1)
    assert dict(zip(got["term"].to_pylist(), got["n"].to_pylist(), strict=True)) == {t: n for t, n in true.items() if n > 1} and missed
    terms = ["b", "a b", "ab", "漢 é", "gone", "only", "a gone", "once only", "a"]
    row, at = tf.Places(pa.array(terms)).find(tokens)
    assert Counter(zip(row.tolist(), at.tolist(), strict=True)) == Counter((i, terms.index(t)) for i, x in enumerate(each) for t in x if t in terms)
    for few in ([], ["a"], ["a b"]):
        assert len(tf.Places(pa.array(few, type=pa.string())).find(tokens)[0]) == sum(true[t] for t in few)


def test_a_text_is_trimmed_of_the_blanks_that_python_strips(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    assert sorted(BLANKS) == every
    texts = ["", "  ", "a", *(f"{b}a{b} é{b}\n" for b in every), *every, "​ a ﻿", "".join(every) + "x y" + "".join(every)]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", strip("text").alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: t.strip() for i, t in enumerate(texts)}
