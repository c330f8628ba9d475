"""Raw documents, knowledge files, model artifacts and the document index as Spark sources and sinks."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import strip
from plumbline.operators.chunks import assign_chunk_index, chunk_documents, processing_stats
from plumbline.operators.model import Model
from plumbline.operators.tfidf import build_index, unpack
from plumbline.sources.shared import materialize

FEATURE = "name string, description string, unit string, normal_range string, related_to string, anomaly_causes array<string>, impact string"
SOLUTION = "problem string, symptoms array<string>, root_causes array<string>, solutions array<string>, priority string, typical_resolution_time string"
CONCEPT = "term string, definition string, interpretation string, category string"


def list_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".pdf", ".txt")) -> DataFrame:
    """Files directly in a folder by lower-cased extension: path, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
    return files.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*extensions)).select("path", "content")


@F.pandas_udf(T.StringType())
def _gbk(content: pd.Series) -> pd.Series:
    def one(x: bytes | None) -> str | None:
        try:
            return None if x is None else bytes(x).decode("gbk")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def parse_text(content: str | Column, path: str | Column) -> Column:
    """UTF-8, else GBK, stripped; undecodable is empty; another extension than .txt is null."""
    raw = F.col(content) if isinstance(content, str) else content
    name = F.col(path) if isinstance(path, str) else path
    utf8 = F.try_validate_utf8(raw.cast("string"))
    text = F.when(utf8.isNotNull(), utf8).otherwise(_gbk(F.when(utf8.isNull(), raw)))
    return F.when(F.lower(name).endswith(".txt"), F.coalesce(strip(text), F.lit("")))


def documents_of(files: DataFrame, parser: Callable[[Column, Column], Column] = parse_text) -> DataFrame:
    """(path, content) -> doc_id, source_file, file_path, text. A parser makes the text, null where it cannot."""
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("path").alias("file_path"), parser(F.col("content"), F.col("path")).alias("text"))


def read_documents(spark: SparkSession, folder: str, parser: Callable[[Column, Column], Column] = parse_text, extensions: tuple[str, ...] = (".pdf", ".txt")) -> DataFrame:
    """The documents of a folder."""
    return documents_of(list_documents(spark, folder, extensions), parser)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file, or no rows and a warning where it is missing."""
    if not _exists(spark, path):
        warnings.warn(f"no knowledge file {path}: taken as empty", stacklevel=3)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_knowledge(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """features, solutions, concepts, best_practices and tips of a folder; missing files and keys are empty."""
    feats = _json(spark, f"{folder}/features.json", f"features map<string, struct<{_struct(FEATURE)}>>")
    sols = _json(spark, f"{folder}/solutions.json", f"solutions array<struct<{_struct(SOLUTION)}>>")
    domain = _json(spark, f"{folder}/domain_knowledge.json", f"concepts array<struct<{_struct(CONCEPT)}>>, best_practices array<string>, troubleshooting_tips array<string>")
    number = lambda df, column, key: df.select(F.posexplode(column).alias(key, "v")).select(F.col(key).cast("long"), "v.*")
    return {
        "features": feats.select(F.explode("features").alias("feature_name", "v")).select("feature_name", "v.*"),
        "solutions": number(sols, "solutions", "solution_id"),
        "concepts": number(domain, "concepts", "concept_id"),
        "best_practices": domain.select(F.explode("best_practices").alias("text")),
        "tips": domain.select(F.explode("troubleshooting_tips").alias("text")),
    }


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in ddl.split(",")))


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(json.dumps(model.as_dict()),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> Model:
    """The one-row artifact; names default to feature1..J."""
    return Model.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))


#: Written last: a folder without it is no whole index.
COMPLETE = "_COMPLETE"


def write_index(path: str, index: dict[str, DataFrame]) -> None:
    """Texts with their metadata, vocabulary and packed vectors of an index that ``build_index`` made, and its terms if it can grow.

    A mark is written when all of it is there; an index that a crash cut short has none.
    """
    for part in ("chunks", "vocabulary", "packed", "terms"):
        if part in index:
            index[part].write.parquet(f"{path}/{part}")
    spark = index["chunks"].sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMPLETE}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()


def read_index(spark: SparkSession, path: str, key: str = "chunk_id") -> dict[str, DataFrame]:
    """An index as it was written. A missing part or an unfinished index is an error; missing metadata columns are null."""
    for part in ("chunks", "vocabulary", "packed", COMPLETE):
        if not _exists(spark, f"{path}/{part}"):
            raise FileNotFoundError(f"no {part} in {path}")
    parts = ["chunks", "vocabulary", "packed", *(["terms"] if _exists(spark, f"{path}/terms") else [])]
    index = {part: spark.read.parquet(f"{path}/{part}") for part in parts}
    for c in ("source_file", "file_path"):
        if c not in index["chunks"].columns:
            index["chunks"] = index["chunks"].withColumn(c, F.lit(None).cast("string"))
    return index | {"vectors": unpack(index["packed"], index["vocabulary"], key)}


def index_folder(spark: SparkSession, folder: str, path: str, parser: Callable[[Column, Column], Column] = parse_text, method: str | Callable[[str], Column] = "semantic", **params) -> DataFrame:
    """Scan, parse, chunk, fit and write the index of a folder; what became of each document, as ``processing_stats`` has it.

    Documents without text or chunk count as failed and are left out. Chunks are numbered by path and place.
    """
    docs = materialize(read_documents(spark, folder, parser), "documents")
    chunks = materialize(chunk_documents(docs.filter("text <> ''"), method, **params), "chunks")
    numbered = assign_chunk_index(chunks).withColumn("chunk_id", F.col("chunk_index"))
    write_index(path, build_index(numbered))
    return processing_stats(docs, chunks)


def append_index(chunks: DataFrame, vectors: DataFrame, new_chunks: DataFrame, new_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense index plus new texts and vectors; every text needs a vector, every vector a text, and all vectors one dimension."""
    odd = new_chunks.join(new_vectors, "chunk_id", "left_anti").count() + new_vectors.join(new_chunks, "chunk_id", "left_anti").count()
    if odd:
        raise ValueError(f"{odd} texts or vectors without a counterpart")
    sizes = [df.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first() for df in (vectors, new_vectors)]
    have = {n for r in sizes for n in r if n is not None}
    if len(have) > 1:
        raise ValueError(f"dimensions differ: {sorted(have)}")
    return chunks.unionByName(new_chunks, allowMissingColumns=True), vectors.unionByName(new_vectors)
