"""A folder that grows, and its index: only new files are parsed, and a restart neither repeats nor loses one.

Files are a stream; each micro-batch of new ones is parsed, cut and appended to the index. Its chunks go to a folder of the
batch, and what the whole needs anew (totals of terms, vocabulary, packed rows) to a folder of the version, which is named after
the batch and marked when it is complete. A batch that a crash cut short has no mark: the stream runs it again with the same
files under the same number, over what it left. One that has its mark is passed over. Readers take the last version
with a mark and the chunks of the batches up to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators.chunks import assign_chunk_index, chunk_documents
from plumbline.operators.tfidf import append_texts, build_index, unpack
from plumbline.sources.files import COMPLETE, documents_of, parse_text
from plumbline.sources.shared import materialize

FILES = "path string, modificationTime timestamp, length long, content binary"
PARTS = ("terms", "vocabulary", "packed")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of an index, in order."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return []
    named = [re.fullmatch(r"version-(\d+)", x.getPath().getName()) for x in fs.listStatus(at)]
    return sorted(int(m[1]) for m in named if m and fs.exists(_at(spark, f"{path}/{m[0]}/{COMPLETE}")[1]))


def read_growing(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The index as its last version has it, or an earlier one that is still there."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"no complete version{'' if version is None else f' {version}'} in {path}")
    last = have[-1] if version is None else version
    chunks = spark.read.parquet(f"{path}/chunks").filter(F.col("batch") <= last).drop("batch")
    index = {part: spark.read.parquet(f"{path}/version-{last}/{part}") for part in PARTS}
    return index | {"chunks": chunks, "vectors": unpack(index["packed"], index["vocabulary"], "chunk_id")}


def add_batch(files: DataFrame, batch: int, path: str, parser: Callable[[Column, Column], Column], method: str | Callable[[str], Column], params: dict) -> None:
    """Append the files of a batch to the index under ``path``; a batch that is there, or has no chunk, changes nothing."""
    spark = files.sparkSession
    have = versions(spark, path)
    if batch in have:
        return
    docs = materialize(documents_of(files, parser), "folder-documents")
    chunks = materialize(chunk_documents(docs.filter("text <> ''"), method, **params), "folder-chunks")
    if not chunks.limit(1).count():
        return
    old = read_growing(spark, path) if have else None
    first = old["chunks"].count() if old else 0
    own = assign_chunk_index(chunks).withColumn("chunk_index", F.col("chunk_index") + first).withColumn("chunk_id", F.col("chunk_index"))
    own = materialize(own, "folder-numbered")
    index = append_texts(old, own) if old else build_index(own, growable=True)
    own.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
    for part in PARTS:
        index[part].write.mode("overwrite").parquet(f"{path}/version-{batch}/{part}")
    fs, mark = _at(spark, f"{path}/version-{batch}/{COMPLETE}")
    fs.create(mark).close()
    for gone in have[:-1]:  # readers of the version before may still be at work
        fs.delete(_at(spark, f"{path}/version-{gone}")[1], True)


def ingest_folder(spark: SparkSession, folder: str, path: str, checkpoint: str, extensions: tuple[str, ...] = (".pdf", ".txt"), parser: Callable[[Column, Column], Column] = parse_text, method: str | Callable[[str], Column] = "semantic", files_per_batch: int = 1000, once: bool = True, **params) -> StreamingQuery:
    """Index the files of a folder that ``checkpoint`` has not seen: those there now (``once``), or for as long as the query runs."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", False).option("maxFilesPerTrigger", files_per_batch).load(folder)
    wanted = stream.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*extensions)).select("path", "content")
    out = wanted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: add_batch(df, batch, path, parser, method, params))
    return (out.trigger(availableNow=True) if once else out).start()
