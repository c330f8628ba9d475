"""The sparse suffix array against brute force over all windows of a passage's length."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def repeats(texts, words=50):
    """(name, text) in order -> spans of words whose windows of that length occurred before."""
    seen, out = set(), {}
    for name, text in texts:
        w, spans = (text or "").encode().split(), []
        for a in range(len(w) - words + 1):
            key = tuple(w[a : a + words])
            if key in seen:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + words
                else:
                    spans.append([a, a + words])
            seen.add(key)
        if spans:
            out[name] = [tuple(s) for s in spans]
    return out


def mosaics(seed, n, words, longest):
    """Texts made of pieces of each other, so that passages overlap in many ways."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(longest))]
        for _ in range(3 if out else 0):
            other = rng.choice(out)
            a, p = rng.randrange(len(other) + 1), rng.randrange(len(w) + 1)
            w[p:p] = other[a : a + rng.randrange(5, 120)]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("alphabet", "words", "kmer", "window"), [(2, 8, 3, 4), (3, 12, 3, 6), (400, 50, 8, 24)])
@pytest.mark.parametrize(("parts", "hot"), [(1, 10**6), (7, 5)])
def test_spans_are_those_of_all_windows(spark, monkeypatch, alphabet, words, kmer, window, parts, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = mosaics(alphabet, 40, [f"w{i}" for i in range(alphabet)], 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs cross the ends of ranges
        got = {r["key"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in suffixes.spans(docs, words, kmer, window).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == repeats(list(enumerate(texts)), words) and got


def test_texts_of_like_hash_are_told_apart(spark):
    """Words of which a polynomial hash modulo 2^64 is the same whatever its base: the bytes decide, not the hash."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} " * 60), (4, f"{a} " * 60)], "doc_id long, text string")
    got = {r["key"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in suffixes.spans(docs).collect()}
    assert got == {2: [(1, 61)], 3: [(1, 60)], 4: [(1, 60)]}


def test_null_ids_repeated_rows_and_equal_ids(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = text(90), text(90), text(90), text(60)
    rows = [(3, f"{a} {b}"), (1, a), (1, a), (None, c), (None, f"{d} {c}"), (5, b), (5, f"{c} new"), (5, b), (7, None), (None, None), (8, ""), (None, f"  {d}\n\t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    marks = {r["text"]: r["mark"] for r in docs.select("text", F.xxhash64("text").alias("mark")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, marks[r[1]]))
    want = repeats([((i, t), t) for i, t in order])
    left = []
    for i, t in rows:
        gone = {j for x, y in want.get((i, t), []) for j in range(x, y)}
        kept = [w for j, w in enumerate((t or "").split()) if j not in gone]
        if kept or not gone:
            left.append((i, kept))
    got = [(r["doc_id"], (r["text"] or "").split()) for r in suffixes.remove(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, left)) and len(left) < len(rows)
    assert {r["doc_id"] for r in suffixes.report(docs).collect()} == {k[0] for k in want}


def test_a_long_text_is_read_whole(spark):
    rng = random.Random(8)
    long = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[140_000:140_060]))], "doc_id long, text string")
    assert [(r["key"], [(s["start"], s["stop"]) for s in r["spans"]]) for r in suffixes.spans(docs).collect()] == [(2, [(0, 60)])]
