"""Streams: ranges that close by the watermark are those of the batch; a folder is indexed file by file, across crashes."""

import random
from datetime import datetime, timedelta

import pytest

from plumbline.operators import monitor as mo
from plumbline.operators import search as se
from plumbline.operators import tfidf as tf
from plumbline.operators.model import Model
from plumbline.sources import files
from plumbline.streaming import folder, ranges

READ = "reading_id long, ts timestamp_ntz, target double, feature1 double, feature2 double, feature3 double"
TINY = Model((0.0,) * 3, (1.0,) * 3, (0.0,) * 3, (1.0,) * 3, ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)), ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)), (1.0, 2.0), 3.0, 4.0)
ZERO = datetime(2024, 1, 1)


def replay(spark, tmp_path, batches, asked, late="10 minutes"):
    """The batches as files, one after the other, through the stream."""
    spark.createDataFrame([], READ).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(READ).parquet(str(tmp_path / "in"))
    q = ranges.watch_ranges(live, asked, TINY, late).writeStream.outputMode("append").format("memory").queryName("over").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, READ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
    finally:
        q.stop()
    return {r["range_id"]: r for r in spark.table("over").collect()}


def test_ranges_close_as_the_batch_has_them(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, ZERO + timedelta(seconds=20 * i), 1.0, *(float(rng.choice([0, 1, 1, 2 if i > 25 else 1])) for _ in range(2)), 3.0 if i % 41 == 40 else 0.0) for i in range(400)]
    order = sorted(rows, key=lambda r: (r[0] // 60, rng.random()))  # shuffled within twenty minutes
    batches = [order[i : i + 60] for i in range(0, 400, 60)] + [[(999, ZERO + timedelta(days=2), 0.0, 0.0, 0.0, 0.0)]]
    spans = [(0, 1800), (600, 601), (100, 7000), (5000, 5100), (7990, 90_000), (50_000, 60_000)]
    text = lambda s: str(ZERO + timedelta(seconds=s))
    asked = spark.createDataFrame([(k, text(a), text(b)) for k, (a, b) in enumerate(spans)] + [(77, "never", "x"), (78, text(172_700), text(999_999))], "range_id long, start_time string, end_time string")
    got = replay(spark, tmp_path, batches, asked)
    want = {r["range_id"]: r for r in mo.analyze_ranges(spark.createDataFrame(rows, READ), asked, TINY).collect() if r["status"] == "ok"}
    assert set(got) == {0, 1, 2, 3} == set(want)  # 78 is not over, 4 and 5 have no readings
    for k, r in got.items():
        for c in ("total_samples", "anomaly_count", "t2_count", "spe_count"):
            assert r[c] == want[k][c]
        for c in (f"{v}_{s}" for v in ("t2", "spe") for s in ranges.STATS):
            assert r[c] == pytest.approx(want[k][c])
        first = want[k]["first_anomaly"]
        assert (r["first_ts"], r["first_reading_id"], r["position"]) == ((first["ts"], first["reading_id"], first["position"]) if first else (None, None, None))
    assert any(r["position"] for r in got.values()) and any(r["first_ts"] is None for r in got.values())


def test_stored_readings_come_in_bounded_batches_in_order_of_time(spark, tmp_path):
    """What a task holds is bounded by the batch, and the rows are those of the batch job; ties of time stay together."""
    rng = random.Random(6)
    rows = [(i, ZERO + timedelta(seconds=20 * (i // 3)), 1.0, *(float(rng.choice([0, 1, 1, 2 if i > 150 else 1])) for _ in range(2)), 0.0) for i in range(600)]
    spans = [(0, 1800), (600, 601), (100, 3300), (0, 3300), (50_000, 60_000)]
    text = lambda s: str(ZERO + timedelta(seconds=s))
    asked = spark.createDataFrame([(k, text(a), text(b)) for k, (a, b) in enumerate(spans)], "range_id long, start_time string, end_time string")
    table = spark.createDataFrame(rng.sample(rows, 600) + [(999, None, 1.0, 9.0, 9.0, 9.0)], READ)
    folder_ = str(tmp_path / "replayed")
    got = {r["range_id"]: r for r in ranges.replay(table, asked, TINY, folder_, rows=150).collect()}
    want = {r["range_id"]: r for r in mo.analyze_ranges(table, asked, TINY).collect() if r["status"] == "ok"}
    assert set(got) == {0, 1, 2, 3} == set(want)
    for k, r in got.items():
        first = want[k]["first_anomaly"]
        assert (r["total_samples"], r["anomaly_count"]) == (want[k]["total_samples"], want[k]["anomaly_count"])
        assert r["t2_mean"] == pytest.approx(want[k]["t2_mean"]) and r["spe_std"] == pytest.approx(want[k]["spe_std"])
        assert (r["first_ts"], r["first_reading_id"], r["position"]) == ((first["ts"], first["reading_id"], first["position"]) if first else (None, None, None))
    sizes = [r["count"] for r in spark.read.parquet(f"{folder_}/batches").groupBy("__batch").count().collect()]
    assert sum(sizes) == 600 and len(sizes) == 4 and max(sizes) <= 160
    assert ranges.replay(table.limit(0), asked, TINY, str(tmp_path / "none")).count() == 0


def test_late_rows_count_for_nothing(spark, tmp_path):
    at = lambda i, m, bad=0.0: (i, ZERO + timedelta(minutes=m), 0.0, 0.0, 0.0, bad)
    batches = [[at(1, 0), at(2, 5)], [at(3, 40)], [at(4, 1, 9.0), at(5, 35, 9.0)], [at(6, 300)], [at(7, 41, 9.0)]]
    asked = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "range_id long, start_time string, end_time string")
    r = replay(spark, tmp_path, batches, asked)[1]
    assert (r["total_samples"], r["anomaly_count"], r["first_reading_id"], r["position"]) == (4, 1, 5, 2)  # row 4 was late, row 7 after the end


def put(tmp_path, **texts):
    (tmp_path / "in").mkdir(exist_ok=True)
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)


def run(spark, tmp_path, **params):
    q = folder.ingest_folder(spark, f"file://{tmp_path}/in", str(tmp_path / "ix"), str(tmp_path / "ck"), most=12, least=3, **params)
    q.awaitTermination(120)
    return folder.read_growing(spark, str(tmp_path / "ix"))


def whole(index):
    chunks = sorted((r["source_file"], r["chunk_pos"], r["text"]) for r in index["chunks"].collect())
    named = {r["chunk_id"]: (r["source_file"], r["chunk_pos"]) for r in index["chunks"].collect()}
    vectors = sorted((*named[r["chunk_id"]], r["term"], round(r["weight"], 9)) for r in index["vectors"].collect())
    return chunks, vectors, len(named)


def at_once(spark, tmp_path, n):
    files.index_folder(spark, str(tmp_path / "in"), str(tmp_path / f"once{n}"), most=12, least=3).count()
    return whole(files.read_index(spark, str(tmp_path / f"once{n}")))


def test_a_folder_grows(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        folder.read_growing(spark, str(tmp_path / "ix"))
    put(tmp_path, a="alpha beta.\n\nbeta gamma.", b="delta alpha", c=" ")
    assert whole(run(spark, tmp_path)) == at_once(spark, tmp_path, 1)
    put(tmp_path, d="delta delta.\n\nepsilon zeta", e="zeta eta")
    assert whole(run(spark, tmp_path, files_per_batch=1)) == at_once(spark, tmp_path, 2)
    assert whole(run(spark, tmp_path)) == at_once(spark, tmp_path, 3)  # nothing new, nothing done
    assert len(folder.versions(spark, str(tmp_path / "ix"))) == 2
    hits = se.search_tfidf_l2(spark.createDataFrame([(1, "eta zeta")], "query_id long, query string"), folder.read_growing(spark, str(tmp_path / "ix")), 1)
    assert hits.count() == 1


@pytest.mark.parametrize("step", ["build", "chunks", "mark"])
def test_a_crash_in_the_middle_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step):
    put(tmp_path, a="alpha beta.\n\nbeta gamma.")
    run(spark, tmp_path)
    put(tmp_path, b="delta alpha", c="gamma gamma")

    def crash(*a, **k):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        if step == "build":
            m.setattr(folder, "append_texts", crash)
        elif step == "chunks":
            m.setattr(folder, "PARTS", ("terms", "none of the parts"))  # stops after chunks and the first part are written
        else:
            m.setattr(folder, "COMPLETE", "_NOT_THE_MARK")  # all parts, but never marked
        try:
            run(spark, tmp_path)
        except Exception:  # noqa: BLE001, S110
            pass
    monkeypatch.undo()
    before = folder.read_growing(spark, str(tmp_path / "ix"))
    assert before["chunks"].select("source_file").distinct().count() == 1  # readers see the version before
    if step == "mark":  # the stream holds the batch for done: run it again, as it would after a real crash
        (tmp_path / "ck" / "commits" / "1").unlink()
        (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert whole(run(spark, tmp_path)) == at_once(spark, tmp_path, step)
    assert tf.index_stats(folder.read_growing(spark, str(tmp_path / "ix"))).first()["total_chunks"] == at_once(spark, tmp_path, step + "2")[2]
