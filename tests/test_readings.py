"""Readings from files: the header, the numbers of rows, and what goes wrong."""

import datetime as dt

import pytest

from plumbline.sources import readings as rs

HEAD = "时间,target,feature1,feature2"


def lines(n, first=0):
    at = dt.datetime(2025, 8, 31)
    return [f"{at + dt.timedelta(seconds=first + i)},{first + i}.5,{i % 7},{'NaN' if i % 5 == 0 else i}" for i in range(n)]


def test_the_header_of_the_data_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("\n".join([HEAD, "2025-08-31 02:00:00,1.5,2.5,3.5", "2025-08-31T02:00:01.25,,NaN,-1", ",7,8,9"]) + "\n", encoding="utf-8")
    df = rs.read_readings(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["reading_id", "ts", "target", "feature1", "feature2"] and dict(df.dtypes)["ts"] == "timestamp_ntz"
    want = [(0, dt.datetime(2025, 8, 31, 2), 1.5, 2.5, 3.5), (1, dt.datetime(2025, 8, 31, 2, 0, 1, 250000), None, None, -1.0), (2, None, 7.0, 8.0, 9.0)]
    assert sorted(map(tuple, df.collect())) == want
    (tmp_path / "o.csv").write_text("feature2,note,ts,target,reading_id,feature10\n1,a,2024-01-01 00:00:00,2,77,3\n", encoding="utf-8")
    df = rs.read_readings(spark, str(tmp_path / "o.csv"), time="ts")  # another order, a column more, ids of its own
    assert df.columns == ["reading_id", "ts", "feature2", "note", "target", "feature10"]
    assert tuple(df.first()) == (77, dt.datetime(2024, 1, 1), 1.0, "a", 2.0, 3.0)


def test_headers_that_do_not_fit(spark, tmp_path):
    for name, head in (("a", "time,target,feature1"), ("b", "时间,feature1"), ("c", "时间,ts,target")):
        (tmp_path / f"{name}.csv").write_text(head + "\n2025-08-31 02:00:00,1,2\n", encoding="utf-8")
        with pytest.raises(ValueError, match="header"):
            rs.read_readings(spark, str(tmp_path / f"{name}.csv"))
    two = tmp_path / "two"
    two.mkdir()
    (two / "a.csv").write_text(HEAD + "\n" + "\n".join(lines(3)), encoding="utf-8")
    (two / "b.csv").write_text("时间,target,feature2,feature1\n" + "\n".join(lines(3)), encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        rs.read_readings(spark, str(two)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rs.read_readings(spark, str(tmp_path / "none.csv"))
    (tmp_path / "t.csv").write_text(HEAD + "\nnot a time,1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a time"):
        rs.read_readings(spark, str(tmp_path / "t.csv")).collect()


def test_numbers_do_not_depend_on_the_split(spark, tmp_path):
    sizes = {"c": 700, "a": 900, "b": 1, "d": 0}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([HEAD, *lines(n, ord(name) * 1000)]) + "\n", encoding="utf-8")
    want = [(i, float(x.split(",")[1])) for i, x in enumerate(x for name in "abcd" for x in lines(sizes[name], ord(name) * 1000))]
    for size in ("128m", "4k", "997", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            df = rs.read_readings(spark, str(tmp_path))
            assert sorted((r["reading_id"], r["target"]) for r in df.select("reading_id", "target").collect()) == want, size
            assert df.filter("feature1 is null").count() == 0 and df.count() == len(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parquet_numbers_by_row(spark, tmp_path):
    df = spark.range(50).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as `时间`", "double(id) as target", "double('NaN') as feature1")
    df.repartitionByRange(3, "target").sortWithinPartitions("target").write.parquet(str(tmp_path / "p"))
    got = rs.read_readings(spark, str(tmp_path / "p"), "parquet").orderBy("reading_id").collect()
    assert [(r["reading_id"], r["target"], r["feature1"]) for r in got] == [(i, float(i), None) for i in range(50)]


def test_days(spark, tmp_path):
    (tmp_path / "r.csv").write_text("reading_id,ts,target,feature1\n1,2024-01-01 00:00:00,1.5,NaN\n2,2024-01-02 10:00:00,2.5,3\n3,2024-01-03 00:00:00,,4\n")
    df = rs.read_readings(spark, str(tmp_path / "r.csv"), time="ts")
    assert [(r["reading_id"], r["target"], r["feature1"]) for r in df.orderBy("reading_id").collect()] == [(1, 1.5, None), (2, 2.5, 3.0), (3, None, 4.0)]
    rs.write_readings(df, str(tmp_path / "days"))
    some = rs.read_days(spark, str(tmp_path / "days"), "2024-01-02 00:00:00", "2024-01-02T23:00:00")
    assert [r["reading_id"] for r in some.collect()] == [2] and some.columns == df.columns
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().toString()
