"""WARC: resolution of server-not-modified revisits.

A revisit record says that a page had not changed since an earlier fetch and carries no payload. It is resolved to the
latest earlier full response of the same canonical URL (an as-of join), the validators of both are compared, and the
headers that a 304 response may update are merged over those of the full response.

The as-of join works on ranges of the records sorted by URL and time, so that no URL, however often it was fetched, is one
group: inside a range the last full response before each record is carried forward; a revisit with none there takes the last
one of the URL's earlier ranges, of which there is one row each. Payloads stay where they are: records carry digests and ids.

Names of headers are compared without case; they are lower-cased on entry, and of names that differ in case alone the last
one stays. "Earlier" is by (ts, record_id), null first, then kind and payload. Records of null or blank URL are ``no_url``; a
revisit before any full response is ``no_response``; entity tags are compared weakly, and where either side has none (an empty
one is none) last-modified decides, and where that is missing too the revisit is ``unverified`` and takes the response it
points to; a contradiction is ``changed``, and gets neither payload nor headers. Records of other kinds take no part; null
headers are none; null page_id or html give records like any other; repeated rows are records of their own; an empty table
gives an empty result; long bodies are digested whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import materialize

#: Fields that a 304 response may carry to update the stored ones (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that do not change what is fetched.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid)="


def canonical(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters, index file and closing slash go; host is lower-cased, parameters sorted."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    u = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, parts, 1)), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, parts, 2), "/{2,}", "/"), r"/(index\.html?)?$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, parts, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(u != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def from_pages(pages: DataFrame) -> DataFrame:
    """Crawl records of a table of pages: a full response for each row, and a revisit of it a week later.

    record_id, page_id, url, ts (seconds), kind, payload (digest of the body), headers map. Servers differ by page_id modulo
    20: 1 sends other entity tags with the revisit, 2 no validators; of 3 the first fetch was not stored; 4 and 5 write names
    in capitals; 6 and 7 have dates for validators, which 7 changes; of 8 the revisit lost its URL.
    """
    p, kind = pages.select("page_id", "url", "html"), F.pmod(F.col("page_id"), F.lit(20))
    tag, digest, at = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')), F.concat(F.lit("sha1:"), F.sha1("html")), F.col("page_id") * 60
    time = lambda s: F.date_format(F.expr("timestamp_ntz'2023-11-14 22:13:20'") + F.make_dt_interval(secs=s), "yyyy-MM-dd HH:mm:ss")
    head = lambda pairs: F.map_filter(F.create_map(*(x for k, v in pairs for x in (k, v))), lambda _, v: v.isNotNull())
    name = lambda k: F.when(kind.isin(4, 5), F.upper(F.lit(k))).otherwise(F.lit(k))
    dated = kind.isin(6, 7)
    full = head([(name("content-type"), F.lit("text/html; charset=utf-8")), (name("content-length"), F.octet_length("html").cast("string")), (F.lit("etag"), F.when(~dated, tag)), (name("last-modified"), F.when(dated, time(at))), (name("date"), time(at)), (F.lit("cache-control"), F.lit("max-age=600")), (F.lit("server"), F.lit("first"))])
    new_tag = F.when(kind == 1, F.lit('"other"')).when(~dated & (kind != 2), F.concat(F.lit("W/"), tag))
    again = head([(name("etag"), new_tag), (F.lit("last-modified"), F.when(dated, time(at + F.when(kind == 7, 1).otherwise(0)))), (F.lit("date"), time(at + 604_800)), (name("cache-control"), F.lit("max-age=86400")), (F.lit("content-length"), F.lit("0")), (F.lit("server"), F.lit("second"))])
    record = lambda k, i, url, ts, payload, headers: F.struct((F.col("page_id") * 2 + i).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(k).alias("kind"), payload.alias("payload"), headers.alias("headers"))
    first = record("response", 0, F.col("url"), at, digest, full)
    later = record("revisit", 1, F.when(F.coalesce(kind, F.lit(0)) != 8, F.col("url")), at + 604_800, F.lit(None).cast("string"), again)
    both = F.filter(F.array(first, later), lambda r: (F.coalesce(kind, F.lit(0)) != 3) | (r["kind"] != "response"))
    return p.select("page_id", F.explode(both).alias("r")).select("page_id", "r.*")


def plain(headers: Column) -> Column:
    """Headers with lower-cased names; of names that are then equal the last one stays, and null is none."""
    none = F.create_map().cast("map<string,string>")
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"]))
    one_each = F.transform_keys(headers, lambda k, _: F.lower(k))
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return F.when(headers.isNull(), none).when(F.size(F.array_distinct(names)) == F.size(names), one_each).otherwise(F.aggregate(F.map_entries(headers), none, put))


def _agree(a: Column, b: Column) -> Column:
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    tag = lambda h: some(F.regexp_replace(F.trim(h["etag"]), "^W/", ""))
    return F.coalesce(tag(a) == tag(b), some(a["last-modified"]) == some(b["last-modified"]))


def merged(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the update put over them; names are lower-cased."""
    allowed = F.map_filter(update, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with status, the record_id and payload of what they resolve to, and the merged headers."""
    columns = ["record_id", "page_id", "url", "key", "ts", "headers"]
    r = records.select("record_id", "page_id", "url", "ts", "kind", "payload", plain(F.col("headers")).alias("headers"), canonical(F.col("url")).alias("key")).filter("kind in ('response', 'revisit')")
    order = ["ts", "record_id", "kind", "payload"]
    known = r.filter("key is not null").repartitionByRange("key", "ts", "record_id").withColumn("part", F.spark_partition_id())
    known = materialize(known, "warc-records")
    last, full = F.struct("ts", "record_id", "payload", "headers"), F.col("kind") == "response"
    inside = Window.partitionBy("key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last(F.when(full, last), ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    parts = known.groupBy("key", "part").agg(F.max_by(last, F.when(full, F.struct(*order))).alias("full"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = parts.select(F.col("key").alias("__key"), F.col("part").alias("__part"), F.last("full", ignorenulls=True).over(before).alias("far"))
    found = near.join(carried, (F.col("key") == F.col("__key")) & (F.col("part") == F.col("__part")), "left").withColumn("of", F.coalesce("near", "far"))
    lost = r.filter("key is null and kind = 'revisit'").withColumn("of", F.lit(None).cast(found.schema["of"].dataType))
    agree = _agree(F.col("headers"), F.col("of.headers"))
    status = F.when(F.col("key").isNull(), "no_url").when(F.col("of").isNull(), "no_response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("changed")
    out = found.select(*columns, "of").union(lost.select(*columns, "of")).withColumn("status", status)
    good = F.col("status").isin("resolved", "unverified")
    new = F.when(good, merged(F.col("of.headers"), F.col("headers")))
    return out.select("record_id", "page_id", "url", "key", "ts", "status", F.col("of.record_id").alias("of_record_id"), F.when(good, F.col("of.payload")).alias("payload"), new.alias("headers"))


def report(pages: DataFrame) -> DataFrame:
    """pages -> a row for each revisit: page_id, record_id, canonical_url, status, of_record_id, payload, etag, date, n_headers, other_headers."""
    out = resolve(from_pages(pages))
    rest = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("headers", lambda k, _: ~k.isin("etag", "date"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("page_id", "record_id", F.col("key").alias("canonical_url"), "status", "of_record_id", "payload", F.col("headers")["etag"].alias("etag"), F.col("headers")["date"].alias("date"), F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"), rest.alias("other_headers"))
