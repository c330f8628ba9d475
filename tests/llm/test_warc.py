"""Revisits: names of headers, contradictions, columns of clashing names, hot URLs, and the query's SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.llm.oracles import ORACLES

RECORD = "record_id long, page_id long, url string, ts long, kind string, payload string, headers map<string,string>"


def resolved(spark, rows):
    return {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, RECORD)).collect()}


def test_names_of_headers_have_no_case(spark):
    got = resolved(spark, [
        (1, 1, "ex.org/a", 0, "response", "p1", {"ETag": '"a"', "Server": "x", "DATE": "1"}),
        (2, 1, "ex.org/a", 5, "revisit", None, {"etag": 'W/"a"', "Date": "2", "server": "y"}),
        (3, 1, "ex.org/a", 6, "revisit", None, {"ETAG": '"zzz"', "date": "3"}),
        (4, 1, "ex.org/a", 7, "revisit", None, {"ETag": '"zzz"', "eTag": '"a"'}),
        (5, 1, "ex.org/a", 8, "revisit", None, {"etag": "", "Last-Modified": "then"}),
        (6, 1, "ex.org/a", 9, "revisit", None, None),
        (7, None, "ex.org/a", None, "revisit", None, {}), (8, 1, "ex.org/a", 9, None, None, {}), (None, 1, " ", 9, "revisit", None, {}),
    ])
    assert {k: r["status"] for k, r in got.items()} == {2: "resolved", 3: "changed", 4: "resolved", 5: "unverified", 6: "unverified", 7: "no_response", None: "no_url"}
    assert got[2]["headers"] == {"etag": 'W/"a"', "server": "x", "date": "2"} and got[2]["payload"] == "p1"
    assert got[3]["headers"] is None and got[3]["payload"] is None and got[3]["of_record_id"] == 1
    assert got[5]["headers"] == {"etag": "", "server": "x", "date": "1", "last-modified": "then"}


def test_dates_decide_where_a_tag_is_missing(spark):
    got = resolved(spark, [(1, 1, "u", 0, "response", "p", {"Last-Modified": "then"}), (2, 1, "u", 1, "revisit", None, {"last-modified": "then", "etag": '"a"'}), (3, 1, "u", 2, "revisit", None, {"last-modified": "now"})])
    assert got[2]["status"] == "resolved" and got[3]["status"] == "changed"


@pytest.mark.parametrize("parts", ["1", "9"])
def test_a_hot_url_is_the_same_in_any_number_of_ranges(spark, parts):
    rows = [(i, i, "hot.org" if i % 3 else f"u{i % 5}.org", i // 2, "response" if i % 11 == 0 else "revisit", f"p{i}" if i % 11 == 0 else None, {"etag": f'"{i % 2}"'}) for i in range(300)]
    rows += rows[:20]
    want, last = {}, {}
    for i, _, url, ts, kind, *_ in sorted(set((*r[:6],) for r in rows), key=lambda r: (r[3], r[0])):
        if kind == "response":
            last[url] = i
        else:
            want[i] = last.get(url)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = warc.resolve(spark.createDataFrame(rows, RECORD).withColumns({c: F.lit(1) for c in ("far", "near", "of", "key", "part", "__key", "__part", "status", "hour")})).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["record_id"]: r["of_record_id"] for r in out} == want and len(out) == sum(r[4] == "revisit" for r in rows)


def test_the_query_reaches_every_status_and_is_its_sql(spark):
    url = lambda i: {9: None, 11: " ", 3: f"only.org/{i}/index.html"}.get(i % 20, f"http://www.Ex{i % 7}.org:80//a/?b={i % 3}&utm_x=1&a=2#t")
    rows = [(i, url(i), f"<p>{i % 9}</p>") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(ORACLES["op4_warc"])
    out = warc.report(pages)
    got = [tuple(r[c] for c in want.columns) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))
    assert {r[want.columns.index("status")] for r in got} == {"no_url", "no_response", "unverified", "resolved", "changed"}
