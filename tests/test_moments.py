"""Ranges from cells against ranges from readings."""

import datetime as dt
import random
import statistics

import pytest

from plumbline.operators import moments as mm
from plumbline.operators import readings as rd

START = dt.datetime(2024, 1, 30, 22, 58)


def rows(n=500, seed=1):
    rng = random.Random(seed)
    at = [START + dt.timedelta(seconds=rng.choice([rng.randrange(400_000), 60 * rng.randrange(6000), 3600 * rng.randrange(110)]), microseconds=rng.choice([0, 0, 500_000])) for _ in range(n)]
    return [(i, t, rng.choice([1e6 + rng.gauss(0, 3), rng.gauss(5, 1), None])) for i, t in enumerate(at)] + [(n, None, 7.0)]


def ranges(seed=2, n=150):
    rng, out = random.Random(seed), []
    for i in range(n):
        a = START + dt.timedelta(seconds=rng.choice([rng.randrange(-5000, 400_000), 60 * rng.randrange(6000), 3600 * rng.randrange(110)]), microseconds=rng.choice([0, 250_000]))
        b = a + dt.timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 3600, 86_400, rng.randrange(300_000)]), microseconds=rng.choice([0, 750_000]))
        out.append((i, str(a), str(b).replace(" ", "T")))
    return out + [(n, "never", "2024-01-01"), (n + 1, "2024-02-02 00:00:00", "2024-02-01 00:00:00")]


def test_cells_are_the_readings(spark):
    data = rows()
    df = spark.createDataFrame(data, "reading_id long, ts timestamp_ntz, target double").repartition(3)
    asked = spark.createDataFrame(ranges(), "range_id long, start_time string, end_time string")
    got = {r["range_id"]: r for r in mm.stats_by_cells(df, asked).collect()}
    assert len(got) == 152 and got[150]["status"] == "invalid_time" and got[150]["count"] is None and got[151]["count"] == 0
    for i, a, b in ranges()[:150]:
        a, b = dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)
        inside = [x for _, t, x in data if t is not None and a <= t <= b]
        some = [x for x in inside if x is not None]
        r = got[i]
        assert r["count"] == len(inside), (a, b)
        assert (r["target_max"], r["target_min"]) == ((max(some), min(some)) if some else (None, None))
        assert r["target_mean"] == (pytest.approx(statistics.fmean(some), rel=1e-9) if some else None)
        assert r["target_std"] == (pytest.approx(statistics.stdev(some), rel=1e-6, abs=1e-6) if len(some) > 1 else None)
    same = {r["range_id"]: r["count"] for r in rd.stats_by_range(df, asked).collect()}
    assert same == {i: r["count"] for i, r in got.items()}


def test_a_long_range_is_few_cells(spark):
    asked = spark.createDataFrame([(1, "2024-01-01 00:00:30", "2024-12-30 23:59:29"), (2, "2024-01-01 00:00:00", "2024-01-01 00:00:59"), (3, "2024-01-01 00:01:00", "2024-01-01 01:00:00")], "range_id long, start_time string, end_time string")
    parts = {}
    for r in mm._pieces(rd.parse_ranges(asked)).collect():
        parts.setdefault(r["range_id"], {}).setdefault(r["level"], []).append(r["start"])
    assert {k: len(v) for k, v in parts[1].items()} == {"minute": 59 + 59, "hour": 23 + 23, "day": 363} and 2 not in parts
    assert {k: len(v) for k, v in parts[3].items()} == {"minute": 59}


def test_no_readings(spark):
    none = spark.createDataFrame([], "reading_id long, ts timestamp_ntz, target double")
    asked = spark.createDataFrame(ranges(n=3), "range_id long, start_time string, end_time string")
    assert {r["count"] for r in mm.stats_by_cells(none, asked).collect()} == {0, None}
    assert mm.stats_by_cells(none, asked.limit(0)).count() == 0


def test_many_ranges_are_two_rows_each(spark):
    """Runs of minutes, whatever blocks the ends lie in, against the readings; also before 1970, and two rows a range, not a row a cell."""
    data, asked = rows(), ranges()
    old = [(1000 + i, dt.datetime(1969, 12, 31, 22, 0) + dt.timedelta(minutes=i * 7, seconds=i), float(i % 9)) for i in range(60)]
    asked += [(200, "1969-12-31 22:00:00", "1970-01-01 03:00:01"), (201, "1969-12-31 23:59:59", "1970-01-01 00:00:00"), (202, "1969-12-31 00:00:00", "2024-03-01 00:00:00")]
    df = spark.createDataFrame(data + old, "reading_id long, ts timestamp_ntz, target double").repartition(3)
    table = spark.createDataFrame(asked, "range_id long, start_time string, end_time string")
    got = {r["range_id"]: r for r in mm.stats_by_cells(df, table, few=0).collect()}
    assert len(got) == len(asked) and got[150]["status"] == "invalid_time" and got[151]["count"] == 0
    for i, a, b in [x for x in asked if x[0] not in (150, 151)]:
        a, b = dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)
        inside = [x for _, t, x in data + old if t is not None and a <= t <= b]
        some, r = [x for x in inside if x is not None], got[i]
        assert r["count"] == len(inside), (a, b)
        assert (r["target_max"], r["target_min"]) == ((max(some), min(some)) if some else (None, None))
        assert r["target_mean"] == (pytest.approx(statistics.fmean(some), rel=1e-9) if some else None)
        assert r["target_std"] == (pytest.approx(statistics.stdev(some), rel=1e-6, abs=1e-6) if len(some) > 1 else None)
    parsed = rd.parse_ranges(table).filter("start_ts <= end_ts")
    assert mm._asks(parsed).groupBy("range_id").count().filter("count <> 2").count() == 0
