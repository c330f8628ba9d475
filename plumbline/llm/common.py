"""What the corpus operators share: words, text batches and hidden columns; tables in the shared folder by ``sources.shared``.

Words are runs of characters other than the six ASCII white-space characters, ``[^\\x20\\x09-\\x0D]+``; that is what
``bytes.split()`` returns on UTF-8, so the operators split bytes and never decode a text only to find its words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.shared import bucketed, discard, materialize, spread  # noqa: F401

#: ASCII white space, as ``bytes.split()`` takes it.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Java regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multiplier of the rolling hashes and the finaliser's constants (splitmix64).
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

def text_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Bound the Arrow batches that carry whole texts to Python workers, by rows and by bytes; for the session, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def apart(*own: str) -> Callable:
    """For operators that return the columns of their input: columns other than ``own`` pass under names of no meaning."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **params) -> DataFrame:
            hidden = docs.toDF(*(c if c in own else f"__extra{i}" for i, c in enumerate(docs.columns)))
            return operator(hidden, *args, **params).toDF(*docs.columns)

        return run

    return wrap


def as_bytes(text: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64, memo: dict = {}) -> np.ndarray:  # noqa: B006
    have = memo.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 12, 2 * len(have) if have is not None else 0)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        have = memo[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every slice values[start:end]: equal slices have equal hashes, whatever stands around them."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * _powers(n, base), out=total[1:])
        return mix((total[ends] - total[starts]) * _powers(n + 1, _inverse(base))[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of a UTF-8 text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words; the hash covers the bytes and their number."""
    raw, starts, ends = words_of(data)
    with np.errstate(over="ignore"):
        return rolling(raw + np.uint64(1), starts, ends), starts, ends
