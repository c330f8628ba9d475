"""Time-range queries and summaries over readings, for one range or a table of ranges."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range tables up to this many rows are broadcast and compared outright; larger ones meet the readings by time bucket.
BROADCAST_RANGES = 64


def feature_columns(df: DataFrame) -> list[str]:
    """Columns named feature<number>, by number."""
    return sorted((c for c in df.columns if re.fullmatch(r"feature\d+", c)), key=lambda c: int(c[7:]))


def parse_time(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, with a blank or a T; null where it is neither."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def time_range_filter(df: DataFrame, start: str, end: str) -> DataFrame:
    """Readings of start <= ts <= end; unparsable ends raise, an empty range is an empty result."""
    a, b = (datetime.fromisoformat(x) for x in (start, end))
    return df.filter(F.col("ts").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))


def project_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Those of the columns that exist, in the order asked for; all if none does."""
    return df.select(*([c for c in columns or [] if c in df.columns] or df.columns))


def format_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) if "ts" in df.columns else df


def recent_range(df: DataFrame, interval: str, anchor: datetime | None = None) -> DataFrame:
    """Readings of the last ``interval`` (as in ``6 hours``) before the anchor, or before the last reading."""
    if anchor is None:
        anchor = df.agg(F.max("ts")).first()[0]
    at = F.lit(anchor).cast("timestamp_ntz")
    return df.filter(F.col("ts").between(at - F.expr(f"interval {interval}"), at))


def stats(c: str = "target") -> list[Column]:
    return [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.stddev_samp(c).alias(f"{c}_std")]


def range_stats(df: DataFrame) -> DataFrame:
    """One row: count and target statistics, null where target is not there; sample deviation."""
    have = stats() if "target" in df.columns else [F.lit(None).cast("double").alias(f"target_{k}") for k in ("mean", "max", "min", "std")]
    return df.agg(F.count(F.lit(1)).alias("count"), *have)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return format_time(df.orderBy("ts", "reading_id").limit(n))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: total, columns, first and last time, target statistics."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(",".join(df.columns)).alias("columns"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"), *stats())


def parse_ranges(ranges: DataFrame) -> DataFrame:
    """(range_id, start_time, end_time) -> with start_ts, end_ts and whether both could be read."""
    r = ranges.withColumns({"start_ts": parse_time(F.col("start_time")), "end_ts": parse_time(F.col("end_time"))})
    return r.withColumn("valid", F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())


def range_join(readings: DataFrame, ranges: DataFrame, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Each reading with each parsed range that holds it, both ends inclusive.

    Buckets are as wide as the ranges are long on average, so that ranges make about two rows each, however long they are.
    """
    good = ranges.filter("start_ts <= end_ts").select("range_id", "start_ts", "end_ts")
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    span = good.agg(F.min("start_ts"), F.max("end_ts"), F.count(F.lit(1)), F.avg(second("end_ts") - second("start_ts"))).first()
    if not span[2]:
        return readings.limit(0).join(good.limit(0)).select("range_id", *readings.columns)
    near = readings.filter(F.col("ts").between(F.lit(span[0]).cast("timestamp_ntz"), F.lit(span[1]).cast("timestamp_ntz")))
    inside = F.col("ts").between(F.col("start_ts"), F.col("end_ts"))
    if span[2] <= broadcast_ranges:
        return near.join(F.broadcast(good), inside).select("range_id", *readings.columns)
    bucket = lambda c: F.floor(second(c) / max(1, int(span[3])))
    dealt = good.withColumn("__bucket", F.explode(F.sequence(bucket("start_ts"), bucket("end_ts"))))
    return near.withColumn("__bucket", bucket("ts")).join(dealt, "__bucket").filter(inside).select("range_id", *readings.columns)


def stats_by_range(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_stats for each row of a range table, with a status: ok or invalid_time. Empty ranges count 0."""
    parsed = parse_ranges(ranges)
    found = range_join(readings, parsed).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), *stats())
    out = parsed.join(found, "range_id", "left")
    return out.select("range_id", F.when(F.col("valid"), "ok").otherwise("invalid_time").alias("status"), F.when(F.col("valid"), F.coalesce("n", F.lit(0))).alias("count"), "target_mean", "target_max", "target_min", "target_std")
