"""Sensor readings from CSV or Parquet: columns by the header's names, and numbers for rows that any split of the files agrees on.

A file has a time column, mostly named ``时间``, ``target`` and ``feature1`` on, in any order, and perhaps other columns,
which stay as text. All files of one reading have the header of the first; another header is an error, not a shift.

``reading_id`` is the place of a row among all rows of all files, files by path. It takes two passes: one counts the rows of
each range of a file that a task reads, and the ranges before add up to the place of a range's first row; the other numbers
the rows inside their range. So it does not depend on how large the ranges are or how many tasks read them. What meets in
one place is a count a file, and a count a range of one file. A file that has ``reading_id`` keeps its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.readings import time_range_filter

TIME = "时间"


def check_header(columns: list[str], time: str) -> None:
    """A header without the time column, without target, or with a name twice is an error that says what it has."""
    need = [c for c in (time, "target") if c not in columns]
    if need or len(set(columns)) < len(columns):
        raise ValueError(f"the header {columns} " + (f"has no {', '.join(need)}" if need else "has a name twice"))
    if time != "ts" and "ts" in columns:
        raise ValueError(f"the header has both {time} and ts")


def readings_schema(columns: list[str], time: str) -> T.StructType:
    """The columns of a header in its order: numbers for target and features, whole ones for reading_id, text for the rest."""
    kind = lambda c: T.LongType() if c == "reading_id" else T.DoubleType() if c == "target" or re.fullmatch(r"feature\d+", c) else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def _time(c: Column) -> Column:
    """A time with a blank or a T, with fractions or without; empty is null, and anything else is an error."""
    return F.when(F.trim(c) != "", F.to_timestamp(F.trim(c)).cast("timestamp_ntz"))


def numbered(rows: DataFrame, place: str, names: list[str]) -> DataFrame:
    """``rows`` of files with ``reading_id``: the rows of the files before, of the file's ranges before, and of the range before.

    ``place`` grows along the rows of a range; ``_metadata`` has the range.
    """
    file, start = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")
    at = rows.select(file, start, F.expr(place).alias("__place"))
    parts = at.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("__first"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.groupBy("__file").agg(F.sum("n").alias("n"))
    earlier = files.select("__file", F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    ranges = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(earlier, "__file").select("__file", "__start", (F.col("__base") + F.col("__before") - F.col("__first")).alias("__offset"))
    found = rows.select(*names, file, start, F.expr(place).alias("__place")).join(ranges, ["__file", "__start"])
    return found.select((F.col("__offset") + F.col("__place")).alias("reading_id"), *names)


def read_readings(spark: SparkSession, path: str, fmt: str = "csv", time: str = TIME) -> DataFrame:
    """Readings of the files under ``path``: reading_id, ts, then the other columns as the header has them.

    NaN becomes null, as comparisons would rank it highest. A missing path is an error; so is a header without the time
    column or target, a file with another header than the first, and a time that is none. Values that are no number are null.
    """
    if fmt == "csv":
        columns = spark.read.option("header", True).csv(path).columns
        check_header(columns, time)
        rows = spark.read.schema(readings_schema(columns, time)).option("header", True).option("enforceSchema", False).csv(path)
    else:
        rows = spark.read.format(fmt).load(path)
        check_header(rows.columns, time)
    columns = [c for c in rows.columns if c != "reading_id"]
    if "reading_id" not in rows.columns:
        rows = numbered(rows, "_metadata.row_index" if fmt == "parquet" else "monotonically_increasing_id()", columns)
    ts = F.col(time) if rows.schema[time].dataType == T.TimestampNTZType() else _time(F.col(time).cast("string"))
    value = lambda f: F.nanvl(f.name, F.lit(None)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
    return rows.select("reading_id", ts.alias("ts"), *(value(rows.schema[c]) for c in columns if c != time))


def write_readings(df: DataFrame, path: str) -> None:
    """Parquet by day, so that a time range reads its days only; a day of many readings goes to several tasks and files."""
    df.withColumn("date", F.to_date("ts")).hint("rebalance", "date").write.partitionBy("date").parquet(path)


def read_days(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Readings of start <= ts <= end from what ``write_readings`` wrote; other days are not read."""
    df = time_range_filter(spark.read.parquet(path), start, end)
    return df.filter(F.col("date").between(*(F.to_date(F.lit(x)) for x in (start, end)))).drop("date")
