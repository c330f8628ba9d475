"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session takes a temporary folder, removed at exit; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append(f"file://{folder}")
    return _own[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``materialize`` in buckets of a column, for rows that several joins on it read: they are shuffled once, here."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    writer = df.repartition(n, column).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
    writer.format("parquet").bucketBy(n, column).sortBy(column).saveAsTable(table)
    return spark.table(table)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more. Only for tables that ``materialize`` returned."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark).partition(":")[2] or shared_dir(spark)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if base.lstrip("/") not in folder:
                raise ValueError(f"{folder} is not a materialised table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores: a scan of fewer row groups is dealt out, any other is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
