"""Ranges on a stream: each range gathers its readings in state, and closes when the watermark has passed its end.

The state of a range is small whatever it has seen: running moments of both statistics, counts of flags, the first anomaly so
far, and, until the watermark has passed that one, the places of the readings before it that the watermark has not passed (all
such readings, while there is no anomaly). Readings come in any order within the watermark, so an earlier anomaly may
still turn up until then; the readings behind the watermark are only counted, as all that can come stand after them. A timer at the end of the range sends out its row, which
is that of the batch, and drops the state. Later readings than the watermark allows are dropped, and count for nothing.

A task sorts what its ranges hold of a micro-batch, which for a range over everything is the whole of it: the size of the
micro-batches bounds its memory. A source should be read with such a bound, and ``replay`` takes stored readings in such pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.model import Model
from plumbline.operators.monitor import score
from plumbline.operators.readings import parse_ranges, range_join
from plumbline.sources.files import _exists as exists

STATS = ("mean", "max", "min", "std")
OUT = "range_id long, total_samples long, anomaly_count long, t2_count long, spe_count long, " + ", ".join(f"{v}_{k} double" for v in ("t2", "spe") for k in STATS) + ", first_ts long, first_reading_id long, position long"
MOMENTS = "n long, anomalies long, t2_flags long, spe_flags long, " + ", ".join(f"{v}_{k} double" for v in ("t2", "spe") for k in ("mean", "m2", "max", "min"))
FIRST = "ts long, id long, position long, settled long, ahead_ts array<long>, ahead_id array<long>"
#: Readings of a micro-batch of a replay, some 140 bytes each in the task that sorts them.
BATCH = 2_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge(a: tuple, b: pd.DataFrame) -> tuple:
    """Moments and counts (or None) with some readings added."""
    n, m = (a[0] if a else 0), len(b)
    out = [n + m, *((a[i] if a else 0) + int(b[c].sum()) for i, c in ((1, "anomaly"), (2, "t2_anomaly"), (3, "spe_anomaly")))]
    for i, v in ((4, "t2"), (8, "spe")):
        x = b[v].to_numpy()
        mean, m2 = float(x.mean()), float(((x - x.mean()) ** 2).sum())
        if a:
            d = mean - a[i]
            mean, m2 = a[i] + d * m / (n + m), a[i + 1] + m2 + d * d * n * m / (n + m)
        out += [mean, m2, float(max(x.max(), a[i + 2] if a else -np.inf)), float(min(x.min(), a[i + 3] if a else np.inf))]
    return tuple(out)


class Ranges(StatefulProcessor):
    """A range's readings (us: its microseconds, reading_id, statistics, flags, end) -> its row, once it is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments, self.first = handle.getValueState("moments", MOMENTS), handle.getValueState("first", FIRST)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        a = tuple(self.moments.get()) if self.moments.exists() else None
        ts, id_, position, settled, ahead_ts, ahead_id = self.first.get() if self.first.exists() else (None, None, None, 0, [], [])
        held_ts, held_id = [np.array(ahead_ts or [], dtype=np.int64)], [np.array(ahead_id or [], dtype=np.int64)]
        for b in rows:
            if not len(b):
                continue
            if a is None:
                self.handle.registerTimer(int(b["end"].iloc[0] // 1000) + 1)
            a = merge(a, b)
            bad = b[b["anomaly"]]
            if len(bad) and position is None:
                one = bad.sort_values(["us", "reading_id"]).iloc[0]
                if ts is None or (int(one["us"]), int(one["reading_id"])) < (ts, id_):
                    ts, id_ = int(one["us"]), int(one["reading_id"])
            if position is None:
                held_ts.append(b["us"].to_numpy(dtype=np.int64))
                held_id.append(b["reading_id"].to_numpy(dtype=np.int64))
                if ts is not None:  # what stands after the first so far stands after any that comes before it
                    t, i = np.concatenate(held_ts), np.concatenate(held_id)
                    before = (t < ts) | ((t == ts) & (i < id_))
                    held_ts, held_id = [t[before]], [i[before]]
        if a is not None:
            self.moments.update(a)
            self.first.update(self._settle(ts, id_, position, settled, np.concatenate(held_ts), np.concatenate(held_id), timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    @staticmethod
    def _settle(ts, id_, position, settled, ahead_ts, ahead_id, passed) -> tuple:
        """The place of the first anomaly if the watermark is past it; else readings behind the watermark become a number."""
        if position is None and ts is not None and ts <= passed:
            position = settled + int(((ahead_ts < ts) | ((ahead_ts == ts) & (ahead_id < id_))).sum())
        if position is not None:
            return ts, id_, position, settled, [], []
        # an anomaly that stands before readings behind the watermark would be behind it itself
        behind = ahead_ts <= passed
        return ts, id_, None, settled + int(behind.sum()), ahead_ts[~behind].tolist(), ahead_id[~behind].tolist()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        a = self.moments.get()
        ts, id_, position, settled, ahead_ts, ahead_id = self.first.get()
        if ts is not None:
            position = self._settle(ts, id_, position, settled, np.array(ahead_ts or [], dtype=np.int64), np.array(ahead_id or [], dtype=np.int64), np.iinfo(np.int64).max)[2]
        stats = [x for i in (4, 8) for x in (a[i], a[i + 2], a[i + 3], float(np.sqrt(max(0.0, a[i + 1]) / a[0])))]
        row = [key[0], *a[:4], *stats, ts, id_, position]
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        out = pd.DataFrame([row], columns=names).astype({"first_ts": "Int64", "first_reading_id": "Int64", "position": "Int64"})
        self.moments.clear()
        self.first.clear()
        yield out

    def close(self) -> None:
        pass


def watch_ranges(readings: DataFrame, ranges: DataFrame, m: Model, late: str = "10 minutes") -> DataFrame:
    """A stream of readings and a table of ranges -> a row for each range with readings, to append when it is over.

    Counts, mean, greatest, least and population deviation of t2 and spe, and the first anomaly with its 0-based place. The state
    store is RocksDB, which timers need.
    """
    spark = readings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # the watermark is that of all readings: it stands before the ranges pick theirs, and their filter is on its column
    live = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    scored = score(live, m).select("ts", "reading_id", "t2", "spe", "t2_anomaly", "spe_anomaly", "anomaly")
    parsed = parse_ranges(ranges)
    joined = range_join(scored, parsed).join(parsed.select("range_id", "end_ts"), "range_id")
    rows = joined.select("range_id", "ts", F.unix_micros("ts").alias("us"), "reading_id", "t2", "spe", "t2_anomaly", "spe_anomaly", "anomaly", F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end"))
    out = rows.groupBy("range_id").transformWithStateInPandas(Ranges(), OUT, "append", "eventTime")
    return out.withColumn("first_ts", F.timestamp_micros("first_ts").cast("timestamp_ntz"))


def replay(readings: DataFrame, ranges: DataFrame, m: Model, folder: str, late: str = "10 minutes", rows: int = BATCH) -> DataFrame:
    """Stored readings through ``watch_ranges`` in order of time, some ``rows`` a micro-batch: the rows of the ranges that are over.

    Micro-batches end between two times, so that no reading comes late. Each is put into the stream's folder when the one before
    it is done, and is a run on the same checkpoint. Readings of null time are in no range.
    """
    spark, schema = readings.sparkSession, readings.schema
    timed, us = readings.filter("ts is not null"), F.unix_micros(F.col("ts").cast("timestamp"))
    n = math.ceil(timed.count() / rows)
    ends = timed.agg(F.percentile_approx(us, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    before = sum((F.when(us > end, 1).otherwise(0) for end in sorted(set(ends))), F.lit(0))
    timed.withColumn("__batch", before).write.partitionBy("__batch").parquet(f"{folder}/batches")
    readings.limit(0).write.parquet(f"{folder}/in")
    out = watch_ranges(spark.readStream.schema(schema).parquet(f"{folder}/in"), ranges, m, late)
    write = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    for at in range(len(set(ends)) + 1 if n else 0):
        own = f"{folder}/batches/__batch={at}"
        if exists(spark, own):  # the last is empty if its end is the last time
            spark.read.schema(schema).parquet(own).write.mode("append").parquet(f"{folder}/in")
            write.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out") if n else spark.createDataFrame([], out.schema)
