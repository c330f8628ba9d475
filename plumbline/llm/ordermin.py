"""Document fingerprints by Order MinHash (Marcais et al. 2019), sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence in the text, so that repeats count. Each of ``SIZE`` orders picks
the ``LEAST`` smallest numbered k-mers, puts them back in text order and hashes the tuple; a fingerprint is the tuples'
32-bit hashes in hex, and the likeness of two fingerprints the share of equal places.

``report`` also compares each document with an edited text made with the next document, in ascending doc_id. Documents are
sorted by ranges of the whole table, as many as the shuffle has, and each range is worked in one pass over its rows; the last
row of a range meets the first of the next in a small join.

Null is the empty text; an empty text has the fingerprint of zeros, which is like itself only; a text shorter than k is one
k-mer; equal doc_ids follow each other by a hash of their text, repeated rows in any order, as they are alike; null doc_ids
come last; a single document is followed by itself; an empty table gives an empty result; long texts are read whole; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASE, as_bytes, materialize, mix, rolling, text_batches

K, SIZE, LEAST = 6, 32, 2
_ORDERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def numbered(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text, each with the number of its occurrence, in text order."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(max(1, n - k + 1))
    h = rolling(points.astype(np.uint64) + np.uint64(1), starts, np.minimum(starts + k, n))
    low = max(1, int(len(h)).bit_length())  # hash above, place below: one sort brings occurrences together in order
    mask = np.uint64((1 << low) - 1)
    order = np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64))
    at, key = (order & mask).astype(np.int64), order >> np.uint64(low)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    if new.all():
        return h
    place = np.arange(len(h))
    number = np.zeros(len(h), dtype=np.uint64)
    number[at] = place - np.maximum.accumulate(np.where(new, place, 0))
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(h + number * BASE), h)


def fingerprint(text: str, k: int = K, size: int = SIZE, least: int = LEAST) -> np.ndarray:
    """``size`` 32-bit hashes of ordered tuples."""
    h = numbered(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), k)
    if not len(h):
        return np.zeros(size, dtype=np.uint32)
    picked = np.empty((size, min(least, len(h))), dtype=np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(size):
            order = h * _ORDERS[j]
            for i in range(picked.shape[1]):
                picked[j, i] = p = order.argmin()
                order[p] = top
        picked.sort(axis=1)
        out = np.zeros(size, dtype=np.uint64)
        for i in range(picked.shape[1]):
            out = mix(out * BASE + h[picked[:, i]] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def written(fp: np.ndarray) -> bytes:
    return fp.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


FOUND = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, t, part) of a range -> what is found of each but the last; its first (edge 1) and last row (edge 2)."""
    held, part = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*_KINDS, pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=k) for i, k in enumerate(kinds)], names=[*_NAMES, "edge", "part", "t"])

    def edge(doc: int, kind: int, t: bytes) -> tuple:
        return doc, None, None, None, None, None, None, kind, part, t

    for b in batches:
        out = []
        for doc, t, part in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B020
            text = t.decode("utf-8", "replace")
            fp = fingerprint(text)
            out.append(edge(doc, 1, t) if held is None else (*compared(*held[:3], text, fp), 0, part, None))
            held = doc, text, fp, t
        yield made(out)
    if held is not None:
        yield made([edge(held[0], 2, held[3])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, after): the last row of a range and the text that follows it."""
    for b in batches:
        out = []
        for doc, t, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text, other = t.decode("utf-8", "replace"), after.decode("utf-8", "replace")
            out.append(compared(doc, text, fingerprint(text), other, fingerprint(other)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=k) for i, k in enumerate(_KINDS)], names=_NAMES)


def compared(doc: int, text: str, fp: np.ndarray, after: str, after_fp: np.ndarray) -> tuple:
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + after[:quarter]
    other = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited.encode()).digest(), written(fp), written(other), likeness(fp, other), likeness(fp, after_fp)


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), as_bytes().alias("t"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t", F.spark_partition_id().alias("part"))
    found = materialize(dealt.mapInArrow(_follow, f"{FOUND}, edge int, part int, t binary"), "order-found")
    parts = sorted(r["part"] for r in found.filter("edge = 1").select("part").collect())  # a number a range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = found.filter("edge = 2").select("doc_id", "t", "part").join(F.broadcast(follows), "part")  # a row a range
    ends = last.join(found.filter("edge = 1").select(F.col("part").alias("next"), F.col("t").alias("after")), "next")
    out = found.filter("edge = 0").select(*_NAMES).union(ends.select("doc_id", "t", "after").mapInArrow(_ends, FOUND))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
