"""Texts into chunks: fixed windows and paragraph packing, both of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import PARAGRAPHS, split_sentences, strip
from plumbline.sources.shared import materialize


def chunk_fixed(text: str | Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, stripped, blank ones dropped.

    With 2 * overlap >= size the windows stand side by side, and a tail of r characters with step < r < 2 * step gets one
    more window, a step after its start.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    t = F.col(text) if isinstance(text, str) else text
    n, step = F.length(t), size - overlap
    starts = lambda by: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(by))).otherwise(F.array().cast("array<int>"))
    if 2 * overlap >= size:
        r = n % size
        more = F.when((r > step) & (r < 2 * step), F.array(n - r + step)).otherwise(F.array().cast("array<int>"))
        at = F.array_sort(F.concat(starts(size), more))
    else:
        at = starts(step)
    return F.filter(F.transform(at, lambda s: strip(F.substring(t, s + 1, F.lit(size)))), lambda c: c != "")


def chunk_semantic(text: str | Column, most: int = 800, least: int = 100) -> Column:
    """Paragraphs packed up to ``most`` characters; a rest of fewer than ``least`` goes to the chunk before it.

    A fold over the paragraphs with the chunks that are closed and the open one as its state. A paragraph joins the open chunk
    if both and a blank line fit, or if that has not ``least`` characters yet; what is too long then is cut into whole
    sentences, one at least to a piece, and the last piece stays open as it is.
    """
    t = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    state = lambda closed, open_: F.struct(closed.alias("closed"), open_.alias("open"))
    joined = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit("\n\n"), b)).otherwise(F.concat(a, b))

    def cut(closed: Column, chunk: Column) -> Column:
        add = lambda s, x: F.when(F.length(s["open"]) + F.length(x) <= most, state(s["closed"], F.concat(s["open"], x))).otherwise(state(F.concat(s["closed"], F.array(s["open"])), x))
        end = lambda s: state(F.concat(closed, F.filter(F.transform(s["closed"], strip), lambda c: c != "")), s["open"])
        return F.aggregate(split_sentences(chunk), state(none, F.lit("")), add, end)

    def grown(s: Column, p: Column) -> Column:
        full = F.length(s["open"]) >= least
        # a step at a time: what the paragraph closes, then whether the rest is too long
        next_ = F.when(full, state(F.concat(s["closed"], F.array(s["open"])), p)).otherwise(state(s["closed"], joined(s["open"], p)))
        fits = F.length(s["open"]) + F.length(p) + 2 <= most
        after = lambda n: F.when(F.length(n["open"]) > most, cut(n["closed"], n["open"])).otherwise(n)
        return F.when(fits, state(s["closed"], joined(s["open"], p))).otherwise(F.element_at(F.transform(F.array(next_), after), 1))

    def ended(s: Column) -> Column:
        n = F.size(s["closed"])
        back = F.concat(F.slice(s["closed"], 1, n - 1), F.array(joined(F.element_at(s["closed"], -1), s["open"])))
        return F.when((n > 0) & (F.length(s["open"]) < least), back).otherwise(F.filter(F.concat(s["closed"], F.array(s["open"])), lambda c: c != ""))

    paragraphs = F.filter(F.transform(F.split(t, PARAGRAPHS), strip), lambda p: p != "")
    return F.coalesce(F.aggregate(paragraphs, state(none, F.lit("")), grown, ended), none)


CHUNKERS: dict[str, Callable[..., Column]] = {"fixed": chunk_fixed, "semantic": chunk_semantic, "sentences": split_sentences}


def chunk_documents(docs: DataFrame, method: str | Callable[[str], Column] = "semantic", **params) -> DataFrame:
    """(doc_id, source_file, file_path, text) -> a row a chunk, with chunk_pos from 0. A callable is a chunker of one's own."""
    if isinstance(method, str) and method not in CHUNKERS:
        raise ValueError(f"unknown chunker {method}")
    made = (CHUNKERS[method] if isinstance(method, str) else method)("text", **params)
    return docs.select("doc_id", "source_file", "file_path", F.posexplode(made).alias("chunk_pos", "text"))


def assign_chunk_index(chunks: DataFrame) -> DataFrame:
    """Adds chunk_index: 0-based over the corpus, by (file_path, doc_id, chunk_pos).

    Documents are range-sorted, a running count inside each sorted part and the parts' totals give their offsets; only the
    totals, one row a part, meet in one place. The sorted parts are written first, so a lost executor cannot renumber them.
    """
    docs = chunks.groupBy("file_path", "doc_id").agg(F.max("chunk_pos").alias("last"))
    parts = materialize(docs.repartitionByRange("file_path", "doc_id").sortWithinPartitions("file_path", "doc_id").withColumn("part", F.spark_partition_id()), "doc-parts")
    inside = Window.partitionBy("part").orderBy("file_path", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum(F.col("last") + 1).alias("total"))
    offsets = totals.select(F.col("part").alias("__part"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = parts.join(F.broadcast(offsets), F.col("part") == F.col("__part")).select("file_path", "doc_id", (F.col("base") + F.coalesce(F.sum(F.col("last") + 1).over(inside), F.lit(0))).alias("offset"))
    return chunks.join(numbered, ["file_path", "doc_id"]).withColumn("chunk_index", F.col("offset") + F.col("chunk_pos")).drop("offset")


def processing_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: characters, number of chunks, whether it failed (no text or no chunk), its first three chunks."""
    made = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_pos") < 3, F.struct("chunk_pos", "text")))), lambda x: x["text"]).alias("first_chunks"))
    out = docs.select("doc_id", "file_path", F.length("text").alias("chars")).join(made, "doc_id", "left")
    return out.select("doc_id", "file_path", "chars", F.coalesce("n", F.lit(0)).alias("chunks"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("failed"), "first_chunks")


def processing_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed_files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))
