"""Vector code compression: codebooks for the parts of vectors by exact k-means over metric trees.

Vectors become integers, ``floor(4096 * x)``, and are cut into ``PARTS`` parts of equal length (the first parts are shorter
where the dimension is no multiple). Every block of ``BLOCK`` rows has one tree a part, built once by the anchors hierarchy
(Moore 2000), from the middle out: some ``sqrt(n)`` anchors are found, each the point farthest from the anchor that owns it,
points going over to a new anchor only where half its distance to their own is less than theirs; large anchors are split the
same way, down to leaves; and the anchors' balls are merged upwards, the pair with the smallest common ball first. Every
ball caches the number and the sum of its points. Trees and rows are one table in the shared folder.

A round broadcasts the codebooks (``PARTS`` x ``ENTRIES`` vectors) and walks every tree from its root with the list of
entries that may own a point. A ball drops what is farther from its centre than the nearest entry is by more than its
diameter, and hands the rest down; where one entry is left the ball is wholly owned, and its cached sum and number count for
it. Leaves compare their points with what is left, in integers. An entry that ties is never dropped, so ties go to the lower
index, and all sums are of integers: results do not depend on blocks or partitions. Rounds, entries and parts are parameters.

Rows of a null vector, or of a component that is null or not finite, are left out (``vectors.whole`` has the rule on lengths);
null ids come last where the first ids start the codebooks; repeated ids are rows of their own, equal ids by vector; fewer
rows than entries give fewer entries; null labels sum together; an empty table gives an empty result; columns but
vec_id, embedding and label are not read. Components of 8192 or more in magnitude are an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize
from plumbline.llm.vectors import in_blocks, integers, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK, LEAF = 4096, 48


def cuts(dimension: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(dimension * i // parts, dimension * (i + 1) // parts) for i in range(parts)]


def anchors(p: np.ndarray, k: int) -> np.ndarray:
    """The owner of each point among up to k anchors; fewer where all points lie on theirs."""
    pivots = [0]
    owner, far = np.zeros(len(p), dtype=np.int64), np.sqrt(((p - p[0]) ** 2).sum(axis=1))
    while len(pivots) < k and far.max() > 0:
        new = int(far.argmax())  # the farthest point of the widest anchor
        between = np.sqrt(((p[pivots] - p[new]) ** 2).sum(axis=1))
        near = np.flatnonzero(2 * far >= between[owner])  # others are surely nearer to their own
        d = np.sqrt(((p[near] - p[new]) ** 2).sum(axis=1))
        won = near[d < far[near]]
        owner[won], far[won] = len(pivots), d[d < far[near]]
        pivots.append(new)
    return owner


class Tree:
    """Balls over the rows of a matrix of integers, as arrays by ball; a ball's rows are ``order[start:end]``, the last ball is the root."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.exact = points.astype(np.float64), points
        self.kids: list[tuple[int, int]] = []
        self.rows: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        if len(points):
            self._grow(np.arange(len(points)))

    def _ball(self, rows: np.ndarray, kids: tuple[int, int] = (-1, -1)) -> int:
        p = self.points[rows]
        centre = p.mean(axis=0)
        self.kids.append(kids)
        self.rows.append(rows)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((p - centre) ** 2).sum(axis=1).max())))
        return len(self.rows) - 1

    def _grow(self, rows: np.ndarray) -> int:
        """The ball of these rows: from the anchors down to leaves, and from the anchors up to one ball."""
        if len(rows) <= LEAF:
            return self._ball(rows)
        owner = anchors(self.points[rows], int(np.ceil(np.sqrt(len(rows)))))
        if not owner.any():  # copies of one point
            return self._ball(rows)
        by = np.argsort(owner, kind="stable")
        tops = [self._grow(rows[g]) for g in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1)]
        return self._merge(tops)

    def _merge(self, tops: list[int]) -> int:
        """Join the two balls whose common ball is the smallest, until one is left."""
        c, r = np.array([self.centre[t] for t in tops]), np.array([self.radius[t] for t in tops])
        at, n = np.array(tops), len(tops)
        wide = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + r[:, None] + r[None]
        np.fill_diagonal(wide, np.inf)
        for _ in range(n - 1):
            i, j = np.unravel_index(int(wide.argmin()), wide.shape)
            at[i] = self._ball(np.concatenate([self.rows[at[i]], self.rows[at[j]]]), (int(at[i]), int(at[j])))
            c[i], r[i], r[j] = self.centre[at[i]], self.radius[at[i]], np.inf
            wide[j], wide[:, j] = np.inf, np.inf
            wide[i] = wide[:, i] = np.sqrt(((c - c[i]) ** 2).sum(axis=1)) + r + r[i]
            wide[i, i] = np.inf
        return int(at[i])

    def pack(self) -> bytes:
        """Arrays of numbers; the order of rows is that of the leaves under the root."""
        n = len(self.rows)
        start, order, at, stack = np.zeros(n, dtype=np.int32), [], 0, [n - 1] if n else []
        while stack:
            b = stack.pop()
            start[b] = at
            if self.kids[b][0] < 0:
                order.append(self.rows[b])
                at += len(self.rows[b])
            else:
                stack += self.kids[b][::-1]
        width = self.exact.shape[1]
        out = {
            "kids": np.array(self.kids, dtype=np.int32).reshape(n, 2),
            "start": start,
            "count": np.array([len(x) for x in self.rows], dtype=np.int64),
            "order": (np.concatenate(order) if order else np.zeros(0)).astype(np.int32),
            "sum": np.array([self.exact[x].sum(axis=0) for x in self.rows], dtype=np.int64).reshape(n, width),
            "centre": np.array(self.centre, dtype=np.float64).reshape(n, width),
            "radius": np.array(self.radius, dtype=np.float64),
        }
        file = io.BytesIO()
        np.savez(file, **out)
        return file.getvalue()


def nearest(points: np.ndarray, book: np.ndarray, allowed: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point among the allowed entries, in integers; ties to the lower index."""
    d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    d = np.where(allowed, d, np.iinfo(np.int64).max)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(points)), best]


def walk(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What becomes of the balls, level by level: (owned balls, their entries, rows of leaves, their entries).

    All balls of a level are held against their candidates at once; each hands its own list to its children.
    """
    level = np.array([len(tree["count"]) - 1]) if len(tree["count"]) else np.zeros(0, dtype=np.int64)
    lists = np.ones((len(level), len(book)), dtype=bool)
    sure = book.astype(np.float64)
    while len(level):
        d = np.where(lists, np.sqrt(((tree["centre"][level][:, None, :] - sure[None]) ** 2).sum(axis=2)), np.inf)
        best, r = d.min(axis=1), tree["radius"][level]
        lists &= d <= (best + 2 * r + 1e-9 * (best + r) + 1e-6)[:, None]  # never drops an entry that ties
        one, leaf = lists.sum(axis=1) == 1, tree["kids"][level, 0] < 0
        owned, open_ = one, leaf & ~one
        at = [np.arange(s, s + n) for s, n in zip(tree["start"][level[open_]], tree["count"][level[open_]], strict=True)]
        rows = tree["order"][np.concatenate(at)] if at else np.zeros(0, dtype=np.int64)
        allowed = np.repeat(lists[open_], tree["count"][level[open_]], axis=0)
        yield level[owned], lists[owned].argmax(axis=1), rows, nearest(points[rows], book, allowed)[0]
        down = ~one & ~leaf
        level, lists = tree["kids"][level[down]].reshape(-1), np.repeat(lists[down], 2, axis=0)


def sums(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) of the points of each entry."""
    total, number = np.zeros(book.shape, dtype=np.int64), np.zeros(len(book), dtype=np.int64)
    for balls, entries, rows, mine in walk(tree, points, book):
        np.add.at(total, entries, tree["sum"][balls])
        np.add.at(number, entries, tree["count"][balls])
        np.add.at(total, mine, points[rows])
        np.add.at(number, mine, 1)
    return total, number


def entries_of(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    out = np.zeros(len(points), dtype=np.int64)
    for balls, entries, rows, mine in walk(tree, points, book):
        for b, e in zip(balls, entries, strict=True):
            out[tree["order"][tree["start"][b] : tree["start"][b] + tree["count"][b]]] = e
        out[rows] = mine
    return out


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return dict(file)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32).reshape(rows, -1).astype(np.int64)


def forest(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, embedding, label) -> blocks (ids, labels, x, trees), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, BLOCK):
            x = integers(b.column("embedding"), SCALE)
            trees = [Tree(x[:, a:z]).pack() for a, z in cuts(x.shape[1], parts)]
            ids, labels = ([b.column(c).to_pylist()] for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.list_(pa.int64())), pa.array(labels, type=pa.list_(pa.int64())), pa.array([x.astype(np.int32).tobytes()], type=pa.binary()), pa.array([trees], type=pa.list_(pa.binary()))], names=["ids", "labels", "x", "trees"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    return materialize(rows.mapInArrow(run, "ids array<long>, labels array<long>, x binary, trees array<binary>"), "code-forest")


def fit(blocks: DataFrame, start: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one a part, from the start rows."""
    spark, books = blocks.sparkSession, [start[:, a:z] for a, z in cuts(start.shape[1], parts)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]  # a task's own sums
            for b in batches:
                for ids, x, trees in zip(b.column("ids"), b.column("x").to_pylist(), b.column("trees").to_pylist(), strict=True):
                    points = _matrix(x, len(ids))
                    for part, (a, z) in enumerate(cuts(points.shape[1], len(books))):
                        s, n = sums(_unpack(trees[part]), points[:, a:z], books[part])
                        total[part][:, :-1] += s
                        total[part][:, -1] += n
            cells = [(p, e, at, int(v)) for p, t in enumerate(total) for e, row in enumerate(t) for at, v in enumerate(row) if row[-1]]
            cols = list(zip(*cells, strict=True)) if cells else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "at", "v"])

        cells = blocks.select("ids", "x", "trees").mapInArrow(run, "part int, entry int, at int, v long")
        got = cells.groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).toPandas()  # a number a component of the codebooks
        shared.unpersist()
        new = []
        for part, book in enumerate(books):
            own, total = got[got["part"] == part], np.zeros((len(book), book.shape[1] + 1), dtype=np.int64)
            total[own["entry"].to_numpy(dtype=int), own["at"].to_numpy(dtype=int)] = own["v"].to_numpy()
            used = total[:, -1:] > 0
            new.append(np.where(used, total[:, :-1] // np.maximum(total[:, -1:], 1), book))
        books = new
    return books


def encode(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (an index a part, in hex), error."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values
                points = _matrix(b.column("x")[i].as_py(), len(ids))
                trees, code, error = b.column("trees")[i].as_py(), np.zeros((len(ids), len(books)), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for part, (a, z) in enumerate(cuts(points.shape[1], len(books))):
                    mine = entries_of(_unpack(trees[part]), points[:, a:z], books[part])
                    code[:, part] = mine
                    error += ((points[:, a:z] - books[part][mine]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code], type=pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``embeddings`` -> (vec_id, label, code, error), written, and the codebooks; up to 256 entries."""
    kept = whole(embeddings.select("vec_id", "embedding", "label"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select(F.col("embedding").cast("array<double>")).toArrow()  # ``entries`` rows
    start = integers(first.column(0).combine_chunks(), SCALE) if first.num_rows else np.zeros((0, parts), dtype=np.int64)
    blocks = forest(kept, parts)
    books = fit(blocks, start, parts, rounds) if len(start) else [start[:, a:z] for a, z in cuts(parts, parts)]
    return materialize(encode(blocks, books), "codes"), books


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress(embeddings)
    by_label = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    met = rows.join(by_label, rows["label"].eqNullSafe(by_label["__label"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
