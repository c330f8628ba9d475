"""Golden cases and edge rules of the reference's operators."""

import json
import math
import random
import re
import sys
from dataclasses import replace
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import chunks as ch
from plumbline.operators import knowledge as kn
from plumbline.operators import monitor as mo
from plumbline.operators import readings as rd
from plumbline.operators import search as se
from plumbline.operators import tfidf as tf
from plumbline.operators.model import Model
from plumbline.plans.fit import fit_model
from plumbline.plans.fixtures import MODEL
from plumbline.plans.report import text_report
from plumbline.sources import files
from plumbline.streaming.monitor import monitor_stream

READ = "reading_id long, ts timestamp_ntz, target double, feature1 double, feature2 double, feature3 double"
TINY = Model((0.0,) * 3, (1.0,) * 3, (0.0,) * 3, (1.0,) * 3, ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)), ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)), (1.0, 2.0), 3.0, 4.0)


def _readings(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i), float(i), *map(lambda v: None if v is None else float(v), x)) for i, x in enumerate(rows)], READ)


def test_scores_by_hand(spark):
    rows = {r["reading_id"]: r for r in mo.score(_readings(spark, [(1, 2, 0), (1, 2, 2), (2, 0, 3), (None, 1, 1)]), TINY).collect()}
    assert len(rows) == 3  # the null feature is dropped
    assert rows[0]["t2"] == pytest.approx(1 + 4 / 2) and not rows[0]["t2_anomaly"]  # equal to the limit
    assert rows[1]["spe"] == pytest.approx(4) and not rows[1]["spe_anomaly"]
    assert rows[2]["t2_anomaly"] and rows[2]["spe_anomaly"]


def test_contributions_sum_to_spe(spark):
    got = mo.score(_readings(spark, [(3, 1, 5)]), TINY).withColumn("c", mo.spe_contributions()).first()
    assert sum(got["c"]) == pytest.approx(got["spe"])


def test_top_features_ties_by_position(spark):
    got = mo.explain(mo.score(_readings(spark, [(3, 3, 3)]), replace(TINY, eigenvalues=(1.0, 1.0))), TINY).first()
    assert [x["feature"] for x in got["t2_top"]] == ["feature1", "feature2", "feature3"]


def test_matrix_helper_agrees_to_the_last_bit(spark, monkeypatch):
    rng = random.Random(8)
    few = lambda *shape: tuple(few(*shape[1:]) for _ in range(shape[0])) if len(shape) > 1 else tuple(rng.uniform(0.1, 2) for _ in range(shape[0]))
    m = Model(few(3), few(3), few(3), few(3), few(3, 2), few(3, 2), few(2), 3.0, 4.0)
    df = _readings(spark, [few(3) for _ in range(60)])
    a = mo.score(df, m).orderBy("reading_id").collect()
    monkeypatch.setattr(mo, "UNROLL", 0)
    b = mo.score(df, m).orderBy("reading_id").collect()
    assert [(r["t"], r["e"], r["t2"], r["spe"]) for r in a] == [(r["t"], r["e"], r["t2"], r["spe"]) for r in b]


def test_features_are_checked(spark):
    with pytest.raises(ValueError, match="no feature"):
        mo.score(spark.createDataFrame([(1,)], "x int"), TINY)
    with pytest.raises(ValueError, match="model"):
        mo.score(_readings(spark, [(1, 2, 3)]).drop("feature3"), TINY)
    assert rd.feature_columns(spark.createDataFrame([(1, 2, 3)], "feature10 int, feature2 int, featurex int")) == ["feature2", "feature10"]


def test_ranges_statuses_and_report(spark):
    ranges = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01T01:00:00"), (2, "2030-01-01", "2031-01-01"), (3, "x", "y")], "range_id long, start_time string, end_time string")
    out = {r["range_id"]: r for r in mo.analyze_ranges(_readings(spark, [(0, 0, 0), (0, 0, 9), (9, 0, 0)]), ranges, TINY).collect()}
    assert [out[i]["status"] for i in (1, 2, 3)] == ["ok", "no_data", "invalid_time"]
    assert out[1]["first_anomaly"]["position"] == 1 and out[1]["anomaly_rate"] == 0.6667
    assert out[2]["first_anomaly"] is None
    text = {r["range_id"]: r["report"] for r in text_report(mo.analyze_ranges(_readings(spark, [(0, 0, 0), (0, 0, 9)]), ranges, TINY)).collect()}
    assert "第 2 个数据点" in text[1] and "50.00%" in text[1] and text[3].endswith("invalid_time")


def test_invalid_time_raises_and_empty_range(spark):
    df = _readings(spark, [(1, 2, 3)])
    with pytest.raises(ValueError):
        rd.time_range_filter(df, "never", "2024-01-01")
    r = rd.range_stats(rd.time_range_filter(df, "2030-01-01 00:00:00", "2030-01-02 00:00:00")).first()
    assert r["count"] == 0 and r["target_mean"] is None
    assert rd.range_stats(rd.project_columns(df, ["ts"])).first()["target_mean"] is None
    assert rd.project_columns(df, ["unknown"]).columns == df.columns


@pytest.mark.parametrize(("n", "size", "overlap", "lengths"), [(500, 500, 50, [500, 50]), (10, 4, 3, [4, 4, 2]), (23, 10, 8, [10, 10, 3, 1]), (0, 5, 1, [])])
def test_chunk_fixed(spark, n, size, overlap, lengths):
    got = spark.createDataFrame([("x" * n,)], "t string").select(ch.chunk_fixed("t", size, overlap).alias("c")).first()["c"]
    assert [len(c) for c in got] == lengths


def test_chunk_fixed_rejects(spark):
    with pytest.raises(ValueError):
        ch.chunk_fixed("t", 5, 5)
    with pytest.raises(ValueError):
        ch.chunk_documents(spark.createDataFrame([], "doc_id long, source_file string, file_path string, text string"), "odd")


SENTENCES = re.compile(r"[^。！？.!?]*[。！？.!?]+\s*|[^。！？.!?]+")


def plain_pack(text: str, most: int, least: int) -> list[str]:
    """Paragraphs of one text packed up to ``most`` characters; a rest of fewer than ``least`` goes to the chunk before it."""
    made = [""]
    for paragraph in re.split(r"\n\s*\n", text or ""):
        if paragraph := paragraph.strip():
            made[-1:] = _grown(made[-1], paragraph, most, least)
    *closed, rest = made
    if closed and len(rest) < least:
        closed[-1] = _joined(closed[-1], rest)
        return closed
    return [c for c in made if c]


def _joined(*parts: str) -> str:
    return "\n\n".join(p for p in parts if p)


def _grown(chunk: str, paragraph: str, most: int, least: int) -> list[str]:
    """An open chunk and the paragraph after it: the chunks that this closes, and the open one.

    They join if both and a blank line fit, or if the chunk has not ``least`` characters yet; what is too long then is cut.
    """
    if len(chunk) + len(paragraph) + 2 <= most:
        return [_joined(chunk, paragraph)]
    closed, left = ([chunk], paragraph) if len(chunk) >= least else ([], _joined(chunk, paragraph))
    return closed + (_sentences(left, most) if len(left) > most else [left])


def _sentences(chunk: str, most: int) -> list[str]:
    """Pieces of whole sentences of up to ``most`` characters, one sentence at least; the last one stays open as it is."""
    pieces = [""]
    for sentence in SENTENCES.findall(chunk):
        if sentence.strip():
            pieces[-1:] = [pieces[-1] + sentence] if len(pieces[-1]) + len(sentence) <= most else [pieces[-1], sentence]
    *closed, rest = pieces
    return [c.strip() for c in closed if c.strip()] + [rest]


def packed(spark, texts, most, least):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ch.chunk_semantic("t", most, least).alias("c"))
    return [r["c"] for r in df.orderBy("i").collect()]


def test_pack(spark):
    assert packed(spark, ["  \n ", None, "", "tiny"], 100, 10) == [[], [], [], ["tiny"]]
    assert packed(spark, ["a" * 50 + "\n\n" + "b" * 60 + "\n\nc"], 100, 20) == [["a" * 50, "b" * 60 + "\n\nc"]]
    assert packed(spark, ["a" * 50 + "\n\n" + "b" * 60 + "\n\nc"], 62, 20) == [["a" * 50, "b" * 60 + "\n\nc"]]
    assert packed(spark, ["x" * 30 + ". " + "y" * 30 + ". " + "z" * 30 + ".", "q" * 99], 40, 5) == [["x" * 30 + ".", "y" * 30 + ".", "z" * 30 + "."], ["q" * 99]]


@pytest.mark.parametrize(("most", "least"), [(10, 1), (25, 9), (60, 5), (14, 40)])
def test_pack_is_the_fold_on_random_texts(spark, most, least):
    rng = random.Random(most)
    parts = ["word", "two words. ", "end! ", "。", "\n\n", "\n \n", "x" * 12, " ", "\u00a0", "\u3000\n\n", "\x1c", "é", "\n", "？\u2003", "𝄞"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(45))) for _ in range(400)] + ["word. " * 3000, ("one line. two\n\n" * 500)]
    got = packed(spark, texts, most, least)
    assert got == [plain_pack(t, most, least) for t in texts]
    for t, g in zip(texts, got, strict=True):
        assert "".join("".join(g).split()) == "".join(t.split())


def test_tfidf_and_searches(spark):
    c = spark.createDataFrame([(1, "s1", "alpha beta beta"), (2, "s1", "alpha gamma"), (3, "s2", "- ."), (4, "s2", "delta alpha")], "chunk_id long, source_file string, text string")
    i = tf.build_index(c)
    idf = {r["term"]: r["idf"] for r in i["vocabulary"].collect()}
    assert idf["alpha"] == pytest.approx(np.log(5 / 4) + 1)
    norms = i["vectors"].groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norms) and {r["chunk_id"] for r in norms} == {1, 2, 4}
    q = spark.createDataFrame([(1, "gamma"), (2, "unknown"), (3, " ")], "query_id long, query string")
    hits = {}
    for r in se.search_tfidf_l2(q, i, 9).orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert hits == {1: [2, 3, 1, 4], 2: [3, 1, 2, 4]}  # the zero vector before chunks without overlap
    assert {r["chunk_id"] for r in se.search_by_source(q, i, "s2", 1).collect()} <= {3, 4}
    with pytest.raises(ValueError):
        tf.build_index(c.limit(0))


def test_knowledge_files_and_lookups(spark, tmp_path):
    (tmp_path / "features.json").write_text(json.dumps({"features": {"feature1": {"name": "n", "anomaly_causes": ["a"]}}}))
    k = files.read_knowledge(spark, str(tmp_path))
    assert k["solutions"].count() == 0 and k["features"].first()["feature_name"] == "feature1"
    got = {r["feature_name"]: r for r in kn.explain_features(spark.createDataFrame([("feature1",), ("feature9",)], "feature_name string"), k["features"]).collect()}
    assert got["feature1"]["name"] == "n" and got["feature1"]["unit"] == "" and got["feature9"]["name"] == "feature9" and got["feature9"]["description"] == kn.NOT_RECORDED


def test_document_files(spark, tmp_path):
    for name, data in {"a.txt": " é　".encode(), "b.TXT": "汉字".encode("gbk"), "c.txt": b"\xff\xff\xff", "d.md": b"x", "e.txt": b" \n"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.txt").write_bytes(b"no")
    got = {r["source_file"]: r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é", "b.TXT": "汉字", "c.txt": "", "e.txt": ""}


def test_model_and_index_files(spark, tmp_path):
    files.write_model(spark, MODEL, str(tmp_path / "m"))
    assert files.read_model(spark, str(tmp_path / "m")) == MODEL
    v = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(ValueError):
        files.append_index(v.select("chunk_id"), v, v.select("chunk_id"), spark.createDataFrame([(1, [1.0])], v.schema))


def test_folder_to_index_to_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": "alpha beta.\n\nbeta gamma.".encode(), "b.txt": "丁 汉字 delta".encode("gbk"), "c.txt": b" ", "d.md": b"alpha"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    stats = {r["file_path"].rpartition("/")[2]: (r["chunks"], r["failed"]) for r in files.index_folder(spark, str(tmp_path / "in"), str(tmp_path / "ix"), most=12, least=3).collect()}
    assert stats == {"a.txt": (2, False), "b.txt": (1, False), "c.txt": (0, True)}
    index = files.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "gamma"), (2, "delta 汉字")], "query_id long, query string")
    best = se.attach_metadata(se.search_tfidf_l2(q, index, 1), index["chunks"])
    assert {r["query_id"]: (r["source_file"], r["text"]) for r in best.collect()} == {1: ("a.txt", "beta gamma."), 2: ("b.txt", "丁 汉字 delta")}
    assert tf.index_stats(index).first()["n_sources"] == 2
    spark.read.parquet(str(tmp_path / "ix" / "chunks")).drop("source_file").write.parquet(str(tmp_path / "bare" / "chunks"))
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, str(tmp_path / "bare"))
    for part in ("vocabulary", "packed"):
        spark.read.parquet(str(tmp_path / "ix" / part)).write.parquet(str(tmp_path / "bare" / part))
    with pytest.raises(FileNotFoundError, match="COMPLETE"):  # all parts, but never finished
        files.read_index(spark, str(tmp_path / "bare"))
    (tmp_path / "bare" / files.COMPLETE).touch()
    assert files.read_index(spark, str(tmp_path / "bare"))["chunks"].filter("source_file is not null").count() == 0


def test_parser_chunker_and_embedder_of_ones_own(spark, tmp_path):
    (tmp_path / "a.rev").write_bytes(b"one|two")
    docs = files.read_documents(spark, str(tmp_path), lambda content, path: F.reverse(content.cast("string")), (".rev",))
    got = ch.chunk_documents(docs, lambda text: F.split(text, "[|]")).orderBy("chunk_pos").collect()
    assert [r["text"] for r in got] == ["owt", "eno"]

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    texts = spark.createDataFrame([(1, "a"), (2, "aaaa"), (3, None)], "id long, text string").filter("text is not null").select("id", lengths("text").alias("embedding"))
    hits = se.search_l2(texts.filter("id = 2").withColumnRenamed("id", "query_id"), texts.withColumnRenamed("id", "vec_id"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in hits] == [2, 1]


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_search_skips_nulls_and_is_brute_force_in_one_block_or_many(spark, monkeypatch, block):
    monkeypatch.setattr(se, "QUERY_BLOCK", block)
    monkeypatch.setattr(se, "SLAB", 15)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[20:30] = v[5]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    vectors = spark.createDataFrame([*rows, (99, None), (None, [0.0] * 4)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([*rows[:10], (98, None)], "query_id long, embedding array<double>")
    got = {}
    for r in se.search_l2(queries, vectors, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {i: sorted(range(60), key=lambda j: (-round(1 / (1 + float(((v[i] - v[j]) ** 2).sum())), 9), j))[:4] for i in range(10)}
    assert got == want
    assert se.search_l2(queries.limit(0), vectors, 4).count() == 0 and se.search_l2(queries, vectors.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="unlike length"):
        se.search_l2(queries, vectors.union(spark.createDataFrame([(100, [1.0])], vectors.schema)).coalesce(1), 4).collect()


def test_keywords_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(kn, "KEYWORD_BLOCK", 2)
    sols = spark.createDataFrame([(i, f"p{i} Tail", None, ["Root"]) for i in range(9)], "solution_id long, problem string, symptoms array<string>, root_causes array<string>")
    words = spark.createDataFrame([("P3",), ("p5 t",), (None,), ("zz",), ("p3",), ("p8",)], "keyword string")
    assert sorted(r["solution_id"] for r in kn.solutions_by_keyword(sols, words).collect()) == [3, 5, 8]
    assert kn.solutions_by_keyword(sols, words.limit(0)).count() == 0


def test_many_ranges_by_bucket(spark):
    df = _readings(spark, [(i, 1, 1) for i in range(60)])
    ranges = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", f"2024-01-01 00:{min(59, i % 60 + i % 9):02d}:30") for i in range(100)], "range_id long, start_time string, end_time string")
    near = lambda n: sorted((r["range_id"], r["reading_id"]) for r in rd.range_join(df, rd.parse_ranges(ranges), n).collect())
    assert near(1000) == near(64) == near(0) and len(near(0)) > 100


def test_public_functions_are_there():
    import plumbline

    assert len(plumbline.__all__) > 70 and all(callable(getattr(plumbline, name)) for name in plumbline.__all__)
    with pytest.raises(AttributeError):
        plumbline.nothing


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__
    from plumbline.plans.queries import QUERIES

    for name in ("plumbline.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "plumbline.llm.queries", raising=False)
    with pytest.warns(UserWarning, match="left out"):
        assert __spark_entry__.queries() == QUERIES
    with pytest.warns(UserWarning, match="left out"):
        assert __spark_entry__.oracle_sql()


def test_fit_recovers_structure(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    rows = [(i, datetime(2024, 1, 1, i // 60, i % 60), float(2 * a[0] - a[1]), *map(float, a)) for i, a in enumerate(x)]
    m = fit_model(spark.createDataFrame(rows, READ), 2, 0.95)
    out = mo.score(spark.createDataFrame(rows, READ), m)
    assert 0.02 < out.filter("t2_anomaly").count() / 400 < 0.08


def test_stream_equals_batch(spark, tmp_path):
    df = _readings(spark, [(i % 4, 1, i % 7) for i in range(50)])
    df.write.parquet(str(tmp_path / "in"))
    batch = monitor_stream(df, TINY, "10 minutes").orderBy("window_start").collect()
    live = monitor_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), TINY, "10 minutes")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").orderBy("window_start").collect() == batch


def test_capitals_are_the_same_word(spark):
    from plumbline.functions.text import capitals

    terms = spark.createDataFrame([(1, "Erßie"), (2, "Erssie"), (3, "größe"), (4, "")], "concept_id long, term string").withColumn("definition", F.col("term"))
    asked = terms.select(capitals("term").alias("term_query")).distinct()
    assert {r["term_query"]: r["concept_id"] for r in kn.concept_by_term(asked, terms).collect()} == {"ERẞIE": 1, "ERSSIE": 2, "GRÖẞE": 3, "": 4}


def test_limits_have_their_exact_rank(spark):
    from plumbline.plans.fit import quantile_of

    values = [((i * 7919) % 30_011) / 7 for i in range(30_011)] + [1e6] * 200
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.99, 0.5, 0.995, 0.0001):
        assert quantile_of(df, "v", len(values), q) == sorted(values)[math.ceil(q * len(values)) - 1]
    assert quantile_of(df, "v", len(values), 0.9, accuracy=10) == sorted(values)[math.ceil(0.9 * len(values)) - 1]
