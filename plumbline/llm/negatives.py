"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers, ``floor(256 * x)``; a score is the inner product with the anchor. An anchor's positives are its best
``POSITIVES`` other rows of the same label; a positive's negatives are the best ``NEGATIVES`` rows of another label whose score
lies in a window below the positive's, from ``LOW`` to ``HIGH`` per cent of it.

Candidates stand in blocks of ``BLOCK`` rows, sorted by label within each partition, every block with one sorted list of its
rows a dimension. An anchor reads the lists from the end that its component's sign prefers (none where it is zero), all to the
same depth; rows met are scored at random access; and no row that is not met can score more than the threshold, the
product of the anchor with the values at that depth. A window is done with a block once the threshold falls strictly below
its k-th score (a tie could still win by id), which a task carries from block to block, or below the window; depths grow
fourfold, and at the full depth every row has been met, so that results are exact whatever the data.

Up to ``HELD`` anchors (counted first) are sent to every task, which keeps ``k`` rows a window. More meet the blocks in a grid
of cells: anchors in packs, repeated for each cell of blocks, blocks shuffled once, joined on the cell, one pack and one block
at a time. Either way a task's own best meet per anchor and window, and the first of them are the answer.

Rows of a null label or vector, or of a component that is null or not finite, take no part (``vectors.whole`` has the rule on
lengths); rows of null id can be found, after equal scores of any id, but are no anchors; repeated rows are rows of
their own, and as anchors each gives its rows; scores that tie go by smaller id; an anchor without positives gives no row,
nor a positive without negatives; an empty table gives an empty result; columns but vec_id, embedding and label are not
read. Components of 131072 or more in magnitude are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import materialize
from plumbline.llm.vectors import in_blocks, integers, whole

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a block and of a slice of anchors that meet at once; anchors that are broadcast, and blocks of a cell beyond that.
BLOCK, SLICE, HELD, CELL = 4096, 256, 4096, 32
FIRST = 16
#: Stands for a null id: after all others.
LAST = np.iinfo(np.int64).max
PAIR = "row long, win int, ps long, cand long, score long"


class Block:
    """Rows with a sorted list a dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lists: np.ndarray | None = None) -> None:
        self.rows, self.ids, self.labels, self.x = rows, ids, labels, x.astype(np.float64)
        self.lists = np.argsort(x, axis=0, kind="stable").astype(np.int16) if lists is None else lists


class Best:
    """The k best (score, id) of each window of each anchor."""

    def __init__(self, windows: int, k: int) -> None:
        self.k, self.score, self.ids = k, np.full((windows, k), -np.inf), np.full((windows, k), LAST)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows of (window, score, id), each once."""
        touched = np.unique(window)
        had = np.repeat(touched, self.k)
        w = np.concatenate([had, window])
        s, i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        take = (starts[:, None] + np.arange(self.k)).ravel()  # every window has k rows at least
        self.score[touched], self.ids[touched] = s[take].reshape(-1, self.k), i[take].reshape(-1, self.k)


def meet(block: Block, rows: np.ndarray, labels: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, best: Best, at: int) -> int:
    """The threshold algorithm of some anchors (labels, a) with windows (anchors x w) on a block; ``best`` holds windows from ``at * w`` on.

    ``same``: candidates have the anchor's label and are not the anchor itself, else they have another label. Returns the rows met.
    """
    m, w = low.shape
    n, up, down = len(block.rows), np.maximum(a, 0), np.minimum(a, 0)
    own = slice(at * w, (at + m) * w)
    kth = best.kth()[own].reshape(m, w)
    fits = labels[:, None] == block.labels[None]
    if same:
        fits &= rows[:, None] != block.rows[None]
    else:
        fits = ~fits
    open_, met, before, depth = fits.any(axis=1), np.zeros((m, n), dtype=bool), 0, min(FIRST, n)
    columns = np.arange(block.x.shape[1])
    while open_.any():
        ends = (block.lists[n - 1 - max(before - 1, 0)], block.lists[max(before - 1, 0)])  # the last rows read, or the first to be read
        top, bottom = (block.x[e, columns] for e in ends)
        threshold = (up @ top + down @ bottom)[:, None]
        open_ &= ((threshold >= kth) & (threshold >= low)).any(axis=1)
        live = np.flatnonzero(open_)
        if not len(live) or before == n:
            break
        new = np.zeros((len(live), n), dtype=bool)
        if depth == n:
            new[:] = True
        else:
            for j in columns:
                new[np.ix_(a[live, j] > 0, block.lists[n - depth : n - before, j])] = True
                new[np.ix_(a[live, j] < 0, block.lists[before:depth, j])] = True
        new &= ~met[live]
        met[live] |= new
        some = np.flatnonzero(new.any(axis=0))
        score = a[live] @ block.x[some].T
        least = np.maximum(low, kth).min(axis=1)[live]
        i, c = np.nonzero(new[:, some] & fits[np.ix_(live, some)] & (score >= least[:, None]))
        s = score[i, c]
        for v in range(w):  # the windows of an anchor
            into = (s >= low[live, v][i]) & (s <= high[live, v][i]) & (s >= kth[live, v][i])
            if into.any():
                best.add((at + live[i[into]]) * w + v, s[into], block.ids[some[c[into]]])
        kth = best.kth()[own].reshape(m, w)
        before, depth = depth, min(4 * depth, n)
    return int(met.sum())


def _rows(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, x): a number for each row that takes part, its label after the change, and its integers; written."""
    kept = whole(embeddings.select("vec_id", "embedding", "label").filter("label is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("embedding"), SCALE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], type=pa.binary())], names=["row", "vec_id", "label", "x"])

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    numbered = kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    return materialize(numbered.mapInArrow(run, "row long, vec_id long, label long, x binary"), "negatives-rows")


def _numbers(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(len(column), -1)


def blocks_of(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, x) -> (rows, ids, labels, x, lists) a block, as bytes; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, BLOCK):
            x = _matrix(b.column("x"))
            parts = [*_numbers(b, "row", "vec_id", "label"), x, np.argsort(x, axis=0, kind="stable").astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], type=pa.binary()) for p in parts], names=["rows", "ids", "labels", "x", "lists"])

    return materialize(rows.sortWithinPartitions("label", "row").mapInArrow(run, "rows binary, ids binary, labels binary, x binary, lists binary"), "negatives-blocks")


def _block(b: pa.RecordBatch, i: int) -> Block:
    raw = [np.frombuffer(b.column(c)[i].as_py(), dtype=k) for c, k in (("rows", np.int64), ("ids", np.int64), ("labels", np.int64), ("x", np.int32), ("lists", np.int16))]
    n = len(raw[0])
    return Block(*raw[:3], raw[3].reshape(n, -1), raw[4].reshape(n, -1))


class Anchors:
    """Anchors with the scores of their positives (w each, missing: an empty window), or none for the search of positives."""

    def __init__(self, b: pa.RecordBatch, k: int) -> None:
        self.rows, self.labels, self.a = *_numbers(b, "row", "label"), _matrix(b.column("x")).astype(np.float64)
        if "ps" in b.schema.names:
            self.ps = np.full((len(self.rows), POSITIVES), -1, dtype=np.int64)
            held = b.column("ps")
            at = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            place = np.concatenate([np.arange(x) for x in held.value_lengths().to_pylist()]) if len(at) else at
            self.ps[at, place] = held.flatten().to_numpy(zero_copy_only=False)
            self.low, self.high, self.same = np.where(self.ps >= 0, self.ps * LOW / 100, np.inf), self.ps * HIGH / 100, False
        else:
            self.ps = np.zeros((len(self.rows), 1), dtype=np.int64)
            self.low, self.high, self.same = np.full(self.ps.shape, -np.inf), np.full(self.ps.shape, np.inf), True
        self.best = Best(self.ps.size, k)

    def meet(self, block: Block) -> None:
        for s in range(0, len(self.rows), SLICE):
            one = slice(s, s + SLICE)
            meet(block, self.rows[one], self.labels[one], self.a[one], self.low[one], self.high[one], self.same, self.best, s)

    def found(self) -> pa.RecordBatch:
        w, at = self.ps.shape[1], np.repeat(np.arange(self.ps.size), self.best.k)
        score, ids = self.best.score.ravel(), self.best.ids.ravel()
        hit = np.isfinite(score)
        at, score, ids = at[hit], score[hit], ids[hit]
        cols = [self.rows[at // w], (at % w).astype(np.int32), self.ps.ravel()[at], pa.array(ids, mask=ids == LAST), score.astype(np.int64)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["row", "win", "ps", "cand", "score"])


def search(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(row, label, x[, ps]) against the blocks -> (row, win, ps, cand, score, rank) of each window's k best."""
    spark = anchors.sparkSession
    held = anchors.limit(HELD + 1).toArrow().combine_chunks()
    if held.num_rows <= HELD:
        shared = spark.sparkContext.broadcast(held)

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared.value.num_rows:
                mine = Anchors(shared.value.to_batches()[0], k)
                for b in batches:
                    for i in range(b.num_rows):
                        mine.meet(_block(b, i))
                yield mine.found()

        pairs = blocks.mapInArrow(past, PAIR)
    else:
        pairs = _grid(anchors, blocks, k)
    first = Window.partitionBy("row", "win").orderBy(F.desc("score"), F.col("cand").asc_nulls_last())
    return pairs.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _grid(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Packs of anchors, for each cell, and the blocks of the cell: pairs of a pack and a block, those of a pack in a row."""
    spark, names = anchors.sparkSession, anchors.columns
    cells = max(math.ceil(blocks.count() / CELL), spark.sparkContext.defaultParallelism)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, SLICE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([int(_numbers(b, "row")[0][0])]), pa.array([sink.getvalue().to_pybytes()], type=pa.binary())], names=["pack", "held"])

    packs = materialize(anchors.select(*names).mapInArrow(packed, "pack long, held binary"), "negatives-packs")
    left = packs.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = blocks.withColumn("cell", F.pmod(F.xxhash64("rows"), F.lit(cells)).cast("int"))

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for b in batches:
            for i, pack in enumerate(b.column("pack").to_pylist()):
                if pack != now:
                    if mine is not None:
                        yield mine.found()
                    with pa.ipc.open_stream(b.column("held")[i].as_py()) as stream:
                        now, mine = pack, Anchors(stream.read_next_batch(), k)
                mine.meet(_block(b, i))
        if mine is not None:
            yield mine.found()

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    return left.hint("merge").join(right, "cell").mapInArrow(past, PAIR)


def mine(embeddings: DataFrame, anchor: Column | str = "vec_id % 50 = 0") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors that the condition on vec_id picks."""
    rows = _rows(embeddings)
    anchors = rows.filter(F.expr(anchor) if isinstance(anchor, str) else anchor)
    blocks = blocks_of(rows)
    positives = materialize(search(anchors.select("row", "label", "x"), blocks, POSITIVES).select("row", (F.col("rank") - 1).alias("win"), F.col("cand").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    scores = positives.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("win", "positive_score"))), lambda x: x["positive_score"]).alias("ps"))  # POSITIVES each
    found = search(anchors.select("row", "label", "x").join(scores, "row"), blocks, NEGATIVES)
    met = found.select("row", "win", "rank", F.col("cand").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["row", "win"])
    out = met.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    return mine(embeddings)
