"""What the operators on ``embeddings`` share: whole rows in integers, and blocks of them.

A row is kept if its vector is there and every component is there and finite. The table's dimension is that of the kept row
of the smallest id (of the longest such, if ids repeat); rows of another length are left out, as no product or distance with
them is defined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers stay under this in magnitude, so that sums of squares over thousands of components fit in 64 bits.
LIMIT = 1 << 25


def whole(df: DataFrame) -> DataFrame:
    """Rows of ``embeddings`` whose vector holds nothing null, infinite or not a number, all of one length."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))  # NaN ranks over infinity
    kept = df.filter(F.col("embedding").isNotNull() & finite)
    first = kept.agg(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", -F.size("embedding")))).first()[0]  # one row
    return kept.filter(F.size("embedding") == F.lit(first or 0))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of vectors, one row each."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(scale * flat).reshape(n, -1) if n else np.zeros((0, 0))
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"components must stay under {LIMIT // scale} in magnitude")
    return x.astype(np.int64)


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of ``rows``, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, table.num_rows - rows + 1, rows):
                yield table.slice(at, rows).combine_chunks().to_batches()[0]
            held = table.slice(table.num_rows - table.num_rows % rows).to_batches() if table.num_rows % rows else []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
