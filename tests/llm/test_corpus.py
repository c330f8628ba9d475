"""Corpus operators against brute force, on made-up texts with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, graph, langid, licenses, mixing, ordermin, quality, simhash, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "su") for b in ("ra", "ti", "no") for c in ("", "n", "st", "l")]
TAIL = [None, "", " \n\t", "one", "Ünïcode   naïve\n\nlines", "x" * 3000, "a b " * 400]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(70))
    for i in range(5, 25, 4):
        texts[i] += "\n" + passage + " " + rng.choice(WORDS)
    for i in range(30, 40):
        w = texts[29].split()
        w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w) if i % 3 else texts[29]
    return texts + TAIL


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t or "")) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(corpus()):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    shared = bpe.load(docs.sparkSession, path, public_tokenizers.PATTERN)
    twice = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), shared), shared)  # a clashing name is replaced
    assert twice.filter(F.col("decoded") != F.coalesce(F.col("text").cast("binary"), F.lit(b""))).count() == 0


def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(60) for b in range(50)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(len(keys))) and h.slot(b"none") == -1


def _repeat_words(w):
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.report(docs).collect()}
    for i, t in enumerate(corpus()):
        w, lines = (t or "").split(" ") and (t or "").encode().split(), [x for x in (t or "").split("\n") if x.strip()]
        assert got[i]["n_words"] == len(w)
        assert got[i]["word_chars"] == sum(len(x.decode()) for x in w)
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["n_repeat_words"] == _repeat_words(w)
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * _repeat_words(w) > 20 * len(w))
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality.report(empty).count() == 0
    assert set(quality.keep(docs).columns) == set(docs.columns)


def test_mixing(spark, docs, empty):
    out = mixing.report(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t in enumerate(corpus())}
    assert {r["doc_id"]: r["size"] for r in out} == size
    total, by = sum(size.values()), {}
    for r in out:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(t for t, _ in by.values()) == pytest.approx(total)
    assert all(abs(t - k) <= 2 * mixing.BLOCK for t, k in by.values())
    assert sorted(mixing.report(docs.repartition(7)).collect()) == sorted(out)
    assert mixing.report(empty).count() == 0
    mixed = mixing.apply(docs).groupBy("doc_id").agg(F.sum(mixing.size()).alias("n"))
    assert {r["doc_id"]: r["n"] for r in mixed.collect()} == {r["doc_id"]: r["taken"] for r in out if r["taken"]}


@pytest.mark.parametrize("votes", [[5, 3, 1], [100, 1, 1, 0], [7], [13, 11, 10, 9, 4, 2, 1, 1]])
def test_sainte_lague(spark, votes):
    for seats in (0, 1, 7, 50):
        df = spark.createDataFrame([(f"p{i}", float(v), seats) for i, v in enumerate(votes)], "p string, v double, s long")
        got = [r["quota"] for r in mixing.sainte_lague(df, [], ["p"], "v", "s").orderBy("p").collect()]
        want = [0] * len(votes)
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want


def _fp(t):
    w = (t or "").encode().lower().split()
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


@pytest.mark.parametrize(("chunk", "rows"), [(128, 512), (2, 3)])
def test_simhash(docs, empty, monkeypatch, chunk, rows):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "MOST_ROWS", rows)
    fps = [_fp(t) for t in corpus()]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in enumerate(fps)}
    assert simhash.report(empty).count() == 0


def test_finer_masks_find_every_pair():
    rng = random.Random(7)
    for radius in (1, 2, 4):
        for _ in range(200):
            a = rng.getrandbits(64)
            b, mask = a, 0
            for i in rng.sample(range(64), rng.randrange(radius + 1)):
                b ^= 1 << i
            while below := simhash.finer(mask, radius):
                met = [m for m in below if (a ^ b) & m == 0]
                assert met and all(m & mask == mask for m in below)
                mask = rng.choice(met)
            assert 64 - mask.bit_count() < radius + 2


def test_many_fingerprints_of_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)
    rng = random.Random(11)
    fps = sorted({rng.choice((0, 1 << 40, 5 << 50)) | rng.getrandbits(11) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    reps = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in enumerate(fps)], "rep long, fp binary").repartition(3)
    found = {(r["a"], r["b"]) for r in simhash.links(reps, 2).collect()}
    label = lambda pairs: _least_reachable(len(fps), pairs)
    assert label(found) == label([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def _least_reachable(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 256, size=(150, 8), dtype=np.uint8)
    fps[10:60] = fps[9]
    for i in range(10, 60):
        fps[i, i % 8] ^= 1 << (i % 7)
    d = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2)
    for radius in (0, 1, 2, 5, 30):
        want = d <= radius
        np.fill_diagonal(want, False)
        assert (simhash.near(fps, radius) == want).all()


def test_simhash_keeps_one_of_a_group(docs):
    kept = {r["doc_id"] for r in simhash.keep(docs).select("doc_id").collect()}
    assert 29 in kept and not kept & {30, 33, 36, 39} and set(range(29)) <= kept


@pytest.mark.parametrize(("chunk", "rows"), [(128, 512), (2, 3)])
def test_near_duplicates_are_those_of_similarity(spark, monkeypatch, chunk, rows):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "MOST_ROWS", rows)
    rng = random.Random(5)
    texts = []
    for changes in (1, 2, 3, 30, 40):  # of 300 words: similarity over 0.9 for the first three, under 0.5 for the others
        base = [rng.choice(WORDS) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for i in rng.sample(range(300), changes):
                w[i] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    like = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    assert not any(0.65 < x < 0.8 for row in like for x in row)
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if like[i][j] >= 0.8) for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in simhash.keep(df).select("doc_id").collect()} == {i for i, r in enumerate(root) if i == r}


def test_links_through_rows_of_null_id(spark, monkeypatch):
    """Fingerprints 1 and 2 are four bits apart; what lies between, two bits from each, has no id, or a greater one."""
    fps = {"a": 0, "b": 0b1111, "c": 0b0011, "d": 0xFFFF << 48 | 1 << 40, "e": 0xFFFF << 48}
    made = lambda df, shingle: df.select("doc_id", F.unhex(F.lpad("text", 16, "0")).alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", made)
    for between in (None, 9):
        rows = [(1, "a"), (2, "b"), (between, "c"), (None, "d"), (None, "e"), (7, "a"), (None, "a")]
        df = spark.createDataFrame([(i, f"{fps[x]:016x}") for i, x in rows], "doc_id long, text string")
        got = {(r["doc_id"], bytes(r["fp"])): r["component_id"] for r in simhash.group(df).collect()}
        assert len(got) == 7 and {c for (_, fp), c in got.items() if fp[0] == 0} == {1} and {c for (_, fp), c in got.items() if fp[0]} == {None}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(100, 100), (7, 3), (3, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}


def test_suffixes(docs, empty):
    seen, want = {}, {}
    for i, t in enumerate(corpus()):
        w, spans = (t or "").encode().split(), []
        for a in range(len(w) - 49):
            if tuple(w[a : a + 50]) in seen:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + 50
                else:
                    spans.append([a, a + 50])
            else:
                seen[tuple(w[a : a + 50])] = i
        if spans:
            want[i] = [tuple(s) for s in spans]
    got = {r["key"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in suffixes.spans(docs).collect()}
    assert got == want and want
    left = {r["doc_id"]: r["text"] for r in suffixes.remove(docs).collect()}
    for i, t in enumerate(corpus()):
        cut = {j for a, b in want.get(i, []) for j in range(a, b)}
        words = [x for j, x in enumerate((t or "").split()) if j not in cut]
        assert i not in left if cut and not words else (left[i] or "").split() == words
    assert suffixes.spans(empty).count() == 0 and suffixes.remove(empty).count() == 0


def test_langid(spark, empty):
    rng = random.Random(2)
    parts = {"aa": "bakelo", "bb": "zixuqy", "cc": "ñéíóúá"}
    rows = [(i, "".join(rng.choice(parts[k]) if rng.random() < 0.8 else " " for _ in range(120)), k, "s", 0) for i in range(300) for k in [sorted(parts)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "aa", "s", 0), (901, "12 34 --", "bb", "s", 0)], SCHEMA)
    got = langid.report(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] >= 900)
    assert langid.report(empty).count() == 0
    assert len(np.unique(langid.codebook(20), axis=0)) == 20 and langid.codebook(4).shape == (4, 7)


def test_toxicity(spark, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) + (" vile rotten" * 2 if i % 4 == 0 else ""), "en", "s", 0) for i in range(800)]
    df = spark.createDataFrame([*rows, (9000, None, None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = toxicity.report(df, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.report(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.report(df, labels.limit(0)).collect()} == {0.0}


def test_ordermin(docs, empty):
    texts = [t or "" for t in corpus()]
    got = {r["doc_id"]: r for r in ordermin.report(docs).collect()}
    for i, t in enumerate(texts):
        after, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert got[i]["fingerprint"] == ordermin.written(ordermin.fingerprint(t)).hex()
    assert got[29]["fingerprint"] == got[30]["fingerprint"] and got[29]["near_next"] == 1
    assert ordermin.report(empty).count() == 0 and ordermin.report(docs.filter("doc_id = 3")).count() == 1


def test_occurrences_are_numbered():
    h = ordermin.numbered(np.array([1, 2, 1, 2, 1, 2, 1, 2], dtype=np.uint32), 2)
    assert len(set(h.tolist())) == len(h) and len(ordermin.numbered(np.zeros(0, dtype=np.uint32))) == 0


def test_licenses(spark, docs, empty):
    notes = ["Released under the MIT License.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    more = spark.createDataFrame([(1000 + i, f"{corpus()[i]}\n{n}\nmore words here", "en", "s", 0) for i, n in enumerate(notes)], SCHEMA)
    got = {r["doc_id"]: r["families"] for r in licenses.report(docs.union(more)).collect()}
    assert [got[1000 + i] for i in range(4)] == ["mit", "proprietary", "apache", "cc-by-nc"]
    assert all(v == "" for k, v in got.items() if k < 1000)
    assert licenses.report(empty).count() == 0


def test_warc(spark):
    full = {"etag": '"a"', "server": "x", "date": "1"}
    rows = [
        (1, 1, "HTTP://www.Ex.org:80/a/?utm_x=1&b=2#top", 0, "response", "p1", full), (2, 1, "https://ex.org/a?b=2", 50, "response", "p2", full | {"etag": '"b"'}),
        (3, 1, "ex.org/a/?b=2", 9000, "revisit", None, {"etag": 'W/"b"', "date": "2", "server": "y"}), (4, 1, "ex.org/a?b=2", 60, "revisit", None, {"etag": '"z"'}),
        (5, 1, "ex.org/new", 60, "revisit", None, {}), (6, 1, None, 60, "revisit", None, {}), (7, 1, "ex.org/a?b=2", 70, "revisit", None, {"date": "3"}), (8, 1, "ex.org/a?b=2", 50, "revisit", None, {"etag": '"b"'}),
    ]
    df = spark.createDataFrame(rows, "record_id long, page_id long, url string, ts long, kind string, payload string, headers map<string,string>")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {3: "resolved", 4: "changed", 5: "no_response", 6: "no_url", 7: "unverified", 8: "resolved"}
    assert got[3]["payload"] == "p2" and got[3]["headers"] == {"etag": 'W/"b"', "server": "x", "date": "2"} and got[4]["headers"] is None
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and out.count() > 0


CLASHES = "a b c g h i j k m n p t v w at fp id key rep row ids size hash kept line lines node part score seat shard span spans start stop stream block bands bucket component component_id decoded edited fingerprint held_out lang_pred n_tokens n_words pivots position predicted quota source_size taken target text_bytes weight word words __key __rep __a __fp".split()


def test_columns_of_clashing_names_change_nothing(spark, docs):
    wide = docs.select("*", *(F.lit(7).alias(c) for c in CLASHES)).cache()
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    reports = {
        "quality": quality.report, "mixing": mixing.report, "simhash": simhash.report, "suffixes": suffixes.report, "langid": langid.report,
        "ordermin": ordermin.report, "licenses": licenses.report, "toxicity": lambda d: toxicity.report(d, labels),
        "bpe": lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    for name, report in reports.items():
        assert sorted(map(str, report(wide).collect())) == sorted(map(str, report(docs).collect())), name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, stage(spark, docs, "").collect())), name
        assert out.filter(" or ".join(f"`{c}` <> 7" for c in CLASHES)).count() == 0, name


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(90))
    other = " ".join(rng.choice(WORDS) for _ in range(90))
    df = spark.createDataFrame([(1, long, "en", "s", 0), (1, long, "en", "s", 0), (None, long, None, None, None), (2, other, "en", "s", 0), (3, long, "en", "s", 0), (None, None, None, None, None)], SCHEMA)
    kept = sorted(str(r["doc_id"]) for r in simhash.keep(df).collect())
    assert kept == ["1", "2", "None"]  # one of each group, the row without text too
    cut = {str(r["doc_id"]) for r in suffixes.remove(df).collect()}
    assert cut == {"1", "2", "None"}  # nothing of row 3 is left
    for report in (quality.report, mixing.report, simhash.report, ordermin.report, langid.report, licenses.report):
        assert report(df).count() == 6
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.report(df, labels).count() == 6
