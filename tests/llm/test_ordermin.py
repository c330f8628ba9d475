"""Order MinHash against a version in plain integers, and the order of documents over any number of ranges."""

import hashlib
import random

import pytest

from plumbline.llm import ordermin
from plumbline.llm.common import BASE

M = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def naive(text, k=6, size=32, least=2):
    if not text:
        return ["0" * 8] * size
    seen, h = {}, []
    for i in range(max(1, len(text) - k + 1)):
        gram = text[i : i + k]
        value = mix(sum((ord(c) + 1) * pow(int(BASE), j, 1 << 64) for j, c in enumerate(gram)) & M)
        n = seen[gram] = seen.get(gram, -1) + 1
        h.append(mix(value + n * int(BASE) & M) if n else value)
    out = []
    for j in range(size):
        order = sorted(range(len(h)), key=lambda i: (h[i] * int(ordermin._ORDERS[j]) & M, i))[:least]
        x = 0
        for i in sorted(order):
            x = mix(x * int(BASE) + h[i] + 1 & M)
        out.append(f"{x >> 32:08x}")
    return out


def like(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def test_fingerprints_are_those_of_plain_integers():
    rng = random.Random(1)
    for text in ["", "a", "abcdef", "aaaaaaaaaaaa", "né 日本 " * 9, *("".join(rng.choices("abc ", k=rng.randrange(200))) for _ in range(30))]:
        assert ordermin.written(ordermin.fingerprint(text)).hex() == "".join(naive(text))


@pytest.mark.parametrize("parts", ["1", "8"])
def test_each_row_meets_the_next_one(spark, parts):
    rng = random.Random(2)
    text = lambda: "".join(rng.choices("abcdefgh ", k=rng.randrange(120)))
    rows = [(i, text()) for i in range(40)] + [(7, "again")] * 3 + [(None, text()), (None, None), (None, None), (9, None), (50, "é" * 41), (-3, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = {r["text"]: r["m"] for r in docs.selectExpr("text", "xxhash64(text) m").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, marks[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = naive(t), naive(edited), naive(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c)))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = ordermin.report(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij ", k=2000))
    near, far = text[:900] + "x" + text[901:], text[1000:] + text[:1000]
    fp = ordermin.fingerprint
    assert ordermin.likeness(fp(text), fp(near)) > 0.8 > ordermin.likeness(fp(text), fp(far)) > ordermin.likeness(fp(text), fp("".join(rng.choices("klm", k=2000))))
