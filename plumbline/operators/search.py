"""Exact top-k search: sparse (TF-IDF) by cosine and by L2, dense by L2 and by cosine.

A task takes its vectors in slabs and a slab in cells: a few of its vectors are pivots, and every vector belongs to the nearest.
A cell knows its pivot, its radius, and for sparse vectors the greatest weight of each term, so it can say how well any of
its vectors can score at best: by the triangle inequality, a vector is no nearer to a query than the pivot is, less the
radius; and a dot product is at most that with the greatest weights. Each query meets its most promising cell first; other
cells meet only those queries whose k-th hit so far does not beat what the cell can reach. What is skipped cannot be a hit, so
results are exact, and in the worst case all cells meet all queries, in pieces of bounded size.

What leaves a task is the k best of each query. Queries are broadcast if they are one block, whose size is bounded; beyond
that, queries of the same values are searched once. Where there are more than a few queries, so that a vector costs more to score
than to shuffle, vectors of the same values are met once, too (their k least ids are all that can be hits). If the queries are
still more than a block, blocks of queries and slabs of vectors are dealt to a grid of groups of bounded size, which a worker
takes in pieces. Scores are rounded to nine digits before they are ranked, ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.text import strip
from plumbline.operators.tfidf import MAX_FEATURES, pack
from plumbline.sources.shared import materialize, spread

#: Queries of a block: at most 32 MB of a thousand doubles each, which is also what is broadcast at most.
QUERY_BLOCK = 4096
#: Up to so many queries meet the vectors as they come; for more, vectors that are alike are brought together first.
FEW = 512
#: Vectors of a slab in the grid, on average, those that a worker holds at once (and queries of the grid), and of a cell on average.
SLAB, HELD, CELL = 8192, 1024, 128
#: What rounding may add to a score.
SLACK = 2e-9


def blank_query_guard(queries: DataFrame) -> DataFrame:
    return queries.filter(strip("query") != "")


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The k best vectors of each query so far: highest score, then least id. Scores of NaN are no hits."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, np.full((queries, k), -np.inf), np.full((queries, k), None, dtype=object)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``at`` x vectors, and the vectors' ids."""
        row, col = np.nonzero(scores >= self.scores[at, -1:])  # NaN is not
        if not len(row):
            return
        some, starts = np.unique(row, return_index=True)
        for i, pairs in zip(some, np.split(col, starts[1:]), strict=True):
            q = at[i]
            s, names = np.append(self.scores[q], scores[i, pairs]), np.append(self.ids[q], ids[pairs].astype(object))
            have = s > -np.inf
            s, names = s[have], names[have]
            least = np.partition(s, len(s) - self.k)[len(s) - self.k] if len(s) > self.k else -np.inf
            first = sorted(np.flatnonzero(s >= least), key=lambda j: (-s[j], names[j]))[: self.k]
            self.scores[q, : len(first)], self.ids[q, : len(first)] = s[first], names[first]

    def rows(self, queries: np.ndarray, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        some = self.scores > -np.inf
        cols = [pa.array(np.repeat(queries, some.sum(axis=1)), type=pa.int64()), pa.array(self.ids[some].tolist(), type=kind), pa.array(self.scores[some], type=pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=names)


class Euclid:
    """Score 1 / (1 + d2) of dense vectors."""

    values: tuple[str, ...] = ("embedding",)

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        return _dense(columns)

    def space(self, x: np.ndarray) -> np.ndarray:
        """The vectors as points whose distances bound the scores."""
        return x

    def score(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + _d2(q, v))

    def at_best(self, near: np.ndarray, peak: np.ndarray) -> np.ndarray:
        """The best score at a distance of ``near`` or more; ``peak`` bounds the dot product."""
        return 1 / (1 + near * near)


class Cosine(Euclid):
    """Cosine of dense vectors: of unit vectors (or none at all) the dot product is at most 1 - d2 / 2."""

    def space(self, x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)

    def score(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.space(q) @ self.space(v).T

    def at_best(self, near: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return 1 - near * near / 2


class Overlap(Euclid):
    """A rising function of the dot product of packed unit rows; rows without a common term are no hits."""

    values = ("places", "weights")

    def __init__(self, of_dot: Callable[[np.ndarray], np.ndarray]):
        self.of_dot = of_dot

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        return _sparse(columns)

    def score(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        dot = q @ v.T
        return np.where(dot > 0, self.of_dot(dot), np.nan)

    def at_best(self, near: np.ndarray, peak: np.ndarray) -> np.ndarray:
        dot = np.minimum(peak, 1 - near * near / 2)
        return np.where(peak > 0, self.of_dot(np.minimum(dot, 1.0)), -np.inf)


def _d2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T, 0)


def _apart(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before it among a few times as many drawn by a seed."""
    some = points[np.sort(np.random.default_rng(0).permutation(len(points))[: 4 * n])]
    taken, far = [0], np.full(len(some), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, _d2(some, some[taken[-1:]])[:, 0])
        taken.append(int(far.argmax()))
    return some[taken]


class Cells:
    """A slab of vectors by their nearest pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind: Euclid):
        self.ids, self.x, self.kind = ids, x, kind
        points = kind.space(x)
        self.pivots = _apart(points, max(1, len(x) // CELL))
        d2 = _d2(points, self.pivots)
        own = d2.argmin(axis=1)
        by = np.argsort(own, kind="stable")
        self.rows = np.split(by, np.searchsorted(own[by], np.arange(1, len(self.pivots))))
        self.far = float(np.sqrt((points * points).sum(axis=1).max()))
        self.radius = np.array([np.sqrt(d2[r, c].max()) if len(r) else 0.0 for c, r in enumerate(self.rows)])
        self.peaks = np.array([x[r].max(axis=0) if len(r) else np.zeros(x.shape[1]) for r in self.rows])

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Queries x cells: the best score that a vector of the cell can have."""
        points = self.kind.space(q)
        lost = 1e-7 * (1 + self.far + np.sqrt((points * points).sum(axis=1)))  # what rounding may make of a small d2
        near = np.maximum(np.sqrt(_d2(points, self.pivots)) - self.radius[None] - lost[:, None], 0)
        return self.kind.at_best(near, q @ self.peaks.T + 1e-12 if isinstance(self.kind, Overlap) else near) + SLACK

    def meet(self, q: np.ndarray, best: Best) -> int:
        """Adds the hits of all queries; returns how many pairs were scored."""
        if q.shape[1] != self.x.shape[1]:
            raise ValueError("vectors of unlike length")
        reach, scored = self.reach(q), 0
        first = reach.argmax(axis=1)
        for turn in (True, False):
            for c, r in enumerate(self.rows):
                mine = first == c
                at = np.flatnonzero((mine if turn else ~mine) & (reach[:, c] >= best.kth()) & np.isfinite(reach[:, c]))
                if len(at) and len(r):
                    scored += len(at) * len(r)
                    best.add(at, np.round(self.kind.score(q[at], self.x[r]), 9), self.ids[r])
        return scored


def _dense(columns: list[pa.Array]) -> np.ndarray:
    """An array column as a matrix; vectors of unlike length are an error."""
    lengths = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of unlike length")
    return columns[0].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)


def _sparse(columns: list[pa.Array]) -> np.ndarray:
    """Packed rows as a matrix over the vocabulary."""
    out = np.zeros((len(columns[0]), MAX_FEATURES))
    row = np.repeat(np.arange(len(out)), columns[0].value_lengths().to_numpy(zero_copy_only=False))
    out[row, columns[0].flatten().to_numpy(zero_copy_only=False)] = columns[1].flatten().to_numpy(zero_copy_only=False)
    return out


def nearest(queries: DataFrame, vectors: DataFrame, key: str, k: int, kind: Euclid, report: bool = False) -> DataFrame:
    """(query_id, values) against (key, values) -> (query_id, key, score) of each query's k best.

    Rows of a null value or key are left out. ``report``: pairs and scored pairs of each task instead.
    """
    whole = lambda df, name: df.select(name, *kind.values).filter(" and ".join(f"{c} is not null" for c in (name, *kind.values)))
    q, v = whole(queries, "query_id"), whole(vectors, key)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, v.schema[key].dataType), T.StructField("score", T.DoubleType())])
    arrow, names = pa.string() if schema[key].dataType.typeName() == "string" else pa.int64(), ["query_id", key, "score"]
    batch = lambda b: (b.columns[0].to_numpy(zero_copy_only=False), kind.matrix(b.columns[1:]))

    def slabs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                held.append(b.slice(at, HELD))
                if sum(x.num_rows for x in held) >= HELD:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def by_block(v: DataFrame, held: pa.Table) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(held)

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared.value.num_rows:
                return
            ids, m = batch(shared.value.to_batches()[0])
            best, pairs, scored = Best(len(ids), k), 0, 0
            for b in slabs_of(batches):
                names_, rows = batch(b)
                scored, pairs = scored + Cells(names_, rows, kind).meet(m, best), pairs + len(ids) * len(names_)
            if report:
                yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([scored])], names=["pairs", "scored"])
            else:
                yield best.rows(ids, arrow, names)

        if report:
            return v.mapInArrow(past, "pairs long, scored long")
        return top_k(v.mapInArrow(past, schema), key, k).drop("rank")

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([(names[0], pa.int64()), (key, arrow), ("score", pa.float64())]))
        cut = lambda t: t.select([t.schema.names[0], *kind.values]).combine_chunks().to_batches(max_chunksize=HELD)
        asked_ = [(ids_, m, Best(len(ids_), k)) for ids_, m in map(batch, cut(a))]
        for part in cut(b):
            cells = Cells(*batch(part), kind)
            for _, m, best in asked_:
                cells.meet(m, best)
        return pa.Table.from_batches([best.rows(ids_, arrow, names) for ids_, _, best in asked_])

    def by_grid(q: DataFrame, v: DataFrame) -> DataFrame:
        deal = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.lit(5)), F.lit(n)).cast("int")
        blocks, slabs = math.ceil(q.count() / QUERY_BLOCK), math.ceil(v.count() / SLAB)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.withColumn("block", deal("query_id", blocks)).withColumn("slab", each(max(1, slabs)))
        right = v.withColumn("slab", deal(key, max(1, slabs))).withColumn("block", each(blocks))
        return top_k(left.groupBy("block", "slab").cogroup(right.groupBy("block", "slab")).applyInArrow(met, schema), key, k).drop("rank")

    first = lambda q: q.limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    held, back = first(q), lambda df: df
    if report and held.num_rows > QUERY_BLOCK:
        raise ValueError(f"reports are of {QUERY_BLOCK} queries at most")
    if report or held.num_rows <= min(FEW, QUERY_BLOCK):
        return by_block(v, held)
    if held.num_rows > QUERY_BLOCK:
        q = materialize(q, "asked")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in kind.values]
        once = q.groupBy(*kind.values).agg(F.min("query_id").alias("__query"))
        asked = materialize(q.join(once.select("__query", *(F.col(c).alias(f"__{c}") for c in kind.values)), same).select("query_id", "__query"), "asked-alike")
        q = materialize(once.select(F.col("__query").alias("query_id"), *kind.values), "asked-once")
        back = lambda df: df.withColumnRenamed("query_id", "__query").join(asked, "__query").select(*names)
        held = first(q)
    alike = v.withColumn("__n", F.row_number().over(Window.partitionBy(*kind.values).orderBy(key))).filter(F.col("__n") <= k)  # k of a group
    v = materialize(alike.groupBy(*kind.values).agg(F.array_sort(F.collect_list(key)).alias("__ids")).withColumn(key, F.col("__ids")[0]), "vectors-once")
    ids, v = v.select(key, "__ids"), v.select(key, *kind.values)
    pairs = by_block(spread(v), held) if held.num_rows <= QUERY_BLOCK else by_grid(q, v)
    found = pairs.join(ids, key).withColumn(key, F.explode("__ids")).drop("__ids")
    return back(top_k(found, key, k).drop("rank"))


#: Of unit vectors: cosine over (norm + 1e-10) twice, and 1 / (1 + d2) with d2 = 2 - 2 dot.
COSINE, NEAR = Overlap(lambda dot: dot / ((1 + 1e-10) * (1 + 1e-10))), Overlap(lambda dot: 1 / (3.0 - 2 * dot))


def _overlaps(texts: DataFrame, index: dict[str, DataFrame], vectors: DataFrame, key: str, k: int, kind: Overlap) -> DataFrame:
    """The k best documents that share a term with each query, of those in ``vectors``."""
    q = pack(texts.withColumnRenamed("query", "text"), index["vocabulary"], "query_id")
    return materialize(nearest(q, vectors, key, k, kind), "hits")


def pruned(queries: DataFrame, vectors: DataFrame, key: str, k: int, kind: Euclid) -> tuple[int, int]:
    """(pairs, pairs that were scored) of a search: what the cells' bounds save."""
    return tuple(nearest(queries, vectors, key, k, kind, report=True).agg(F.sum("pairs"), F.sum("scored")).first())


def _short(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k hits: all their hits are in ``best``."""
    return queries.select("query_id").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")


def _first(queries: DataFrame, candidates: DataFrame, key: str, n: int) -> DataFrame:
    """The first n candidates for each query: all that any query can need of those that score alike."""
    return queries.join(F.broadcast(candidates.select(key).orderBy(key).limit(n)))  # n rows


def search_cosine(queries: DataFrame, index: dict[str, DataFrame], k: int = 5, key: str = "kb_id", only: Column | None = None) -> DataFrame:
    """(query_id, query) -> query_id, rank, key, score; ``only`` keeps documents before ranking; zero scores fill up the k."""
    docs = index["chunks"] if only is None else index["chunks"].filter(only)
    vectors = index["packed"] if only is None else index["packed"].join(docs.select(key), key, "left_semi")
    best = _overlaps(queries, index, vectors, key, k, COSINE)
    pool = _first(_short(queries, best, k), docs, key, 2 * k)  # fewer than k of them overlap
    rest = pool.join(best.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(rest), key, k)


def search_tfidf_l2(queries: DataFrame, index: dict[str, DataFrame], k: int = 5, key: str = "chunk_id") -> DataFrame:
    """Nearest by squared L2, score 1 / (1 + d2), blank queries dropped.

    Vectors have length 1 or 0, so d2 follows from the dot product. Chunks without a known term are zero vectors (d2 = |q|2)
    and stay candidates, and so do unit chunks without overlap; of either only the first ids can be needed.
    """
    queries = blank_query_guard(queries)
    best = _overlaps(queries, index, index["packed"], key, k, NEAR)
    known = pack(queries.withColumnRenamed("query", "text"), index["vocabulary"], "query_id").select("query_id", F.lit(1.0).alias("qq"))
    norms = queries.select("query_id").join(known, "query_id", "left").select("query_id", F.coalesce("qq", F.lit(0.0)).alias("qq"))
    at = lambda d2: F.round(1 / (1 + d2), 9).alias("score")
    unit = index["packed"].select(key)
    zero = _first(norms, index["chunks"].join(unit, key, "left_anti"), key, k).select("query_id", key, at(F.col("qq")))
    far = _first(norms.join(_short(queries, best, k), "query_id"), unit, key, 2 * k)
    far = far.join(best.select("query_id", key), ["query_id", key], "left_anti").select("query_id", key, at(F.col("qq") + 1))
    return top_k(best.unionByName(zero).unionByName(far), key, k)


def attach_metadata(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with the text and metadata of their own chunk."""
    return chunks.join(hits, key)


def search_by_source(queries: DataFrame, index: dict[str, DataFrame], source: str, k: int = 5, exact: bool = False) -> DataFrame:
    """Hits of one source: the first 5k hits of all are filtered, so fewer than k may remain; ``exact`` filters before."""
    own = F.col("source_file") == F.lit(source)
    if exact:
        chunks = index["chunks"].filter(own)
        index = index | {"chunks": chunks, "packed": index["packed"].join(chunks.select("chunk_id"), "chunk_id", "left_semi")}
        return attach_metadata(search_tfidf_l2(queries, index, k), chunks)
    hits = attach_metadata(search_tfidf_l2(queries, index, 5 * k), index["chunks"]).filter(own)
    return top_k(hits.drop("rank"), "chunk_id", k)


def search_l2(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, embedding) against (vec_id, embedding): query_id, rank, vec_id, score = 1 / (1 + d2). Null vectors are no hits."""
    return top_k(nearest(queries, vectors, "vec_id", k, Euclid()), "vec_id", k)


def search_dense_cosine(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    return top_k(nearest(queries, vectors, "vec_id", k, Cosine()), "vec_id", k)


def cosine(a: str | Column, b: str | Column) -> Column:
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return total(F.zip_with(a, b, lambda x, y: x * y)) / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def similarity_ratio(a: str | Column, b: str | Column) -> Column:
    """One similarity over another, rounded; null where the other is zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.round(F.try_divide(a, b), 9)


def pairwise_cosine(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with cosine and its band: above 0.9, 0.8, 0.7, 0.5, or below."""
    df = pairs.withColumn("cosine", F.round(cosine(a, b), 9))
    band = F.when(F.col("cosine") > 0.9, "0.9").when(F.col("cosine") > 0.8, "0.8").when(F.col("cosine") > 0.7, "0.7").when(F.col("cosine") > 0.5, "0.5").otherwise("low")
    return df.withColumn("band", band)
