"""Live monitoring: the row-wise scoring of a batch on a stream, and windowed statistics under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.model import Model
from plumbline.operators.monitor import anomaly_counts, monitor_stats, score


def anomaly_stream(readings: DataFrame, m: Model) -> DataFrame:
    """Anomalous readings of a stream, to append."""
    return score(readings, m).filter("anomaly").drop("t", "e")


def monitor_stream(readings: DataFrame, m: Model, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics and counts by tumbling window; rows later than the watermark are dropped."""
    scored = score(readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), m)
    out = scored.groupBy(F.window("ts", window)).agg(*monitor_stats(), *anomaly_counts())
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *(c for c in out.columns if c != "window"))
