"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (A-Z lower-cased, ASCII punctuation a blank), pairs of neighbours, and pairs with one or two
words between them, each counted once: words in one half of ``2^18`` buckets with value 1, pairs in the other with value
``PAIR``. FTRL-proximal (McMahan et al. 2013) gives each coordinate its own rate, and its L1 term leaves most weights exactly
zero, so that what is broadcast is compact.

Training reads a bounded sample of labelled rows, ``per_class`` each at most (a parameter), drawn by a hash of id and text and
dealt to ``SHARDS`` shards by another. A shard takes rows in hashed order until it has ``SHARD_VALUES`` features (a parameter
too: its bound in memory) and is packed into one row of a table, so no split of files or scans can part it, and the
same rows give the same weights. Shards run FTRL each from the common state, and the states, two numbers a bucket and
shard, are averaged after each round; more shards were worse, as each then sees too few toxic rows to lift a word over the L1 term. A fifth of the sample is held back once: with what the rest teaches, the threshold
is put where F1 on that fifth is best, its rows weighted back to the classes' numbers; then the whole sample trains, and the
threshold becomes part of the bias, so that score 0.5 is the cut. Rates, L1 and weights below were chosen in the same way, on
a split inside the training rows. Scoring is one narrow pass over every whole text.

Null and empty texts have no features and get the bias alone; without labelled rows of both classes every score is 0; an id
that the labels contradict teaches nothing; equal places in the training order go by id, then by the features; repeated rows count each time; an empty table gives an empty result; long texts are
read whole, a text being at most ``2^18`` features; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import BASE, as_bytes, materialize, mix, text_batches, word_hashes
from plumbline.llm.langid import crc, sample

BITS = 18
HALF = 1 << (BITS - 1)
PER_CLASS, SHARDS, ROUNDS, EPOCHS = 12_000, 4, 3, 4
#: Features of a shard: 64 MB of buckets, some twice what 6000 rows of the usual length have.
SHARD_VALUES = 1 << 24
ALPHA, BETA, L1, L2, PAIR = 4.0, 1.0, 6.0, 0.1, 0.2
#: Weight of a row of the rarer class 1 in the loss.
POSITIVE = 5.0
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def features(data: bytes) -> np.ndarray:
    """Distinct buckets of a text in order: words below HALF, pairs from there on; bucket 0 is the bias."""
    h = word_hashes(data.translate(_PLAIN))[0]
    shift = np.uint64(64 - BITS + 1)
    with np.errstate(over="ignore"):
        pairs = [(mix(h[:-d] * BASE + h[d:] + np.uint64(d)) >> shift) + np.uint64(HALF) for d in (1, 2, 3) if len(h) > d]
    found = np.concatenate([np.zeros(1, dtype=np.uint64), h >> shift, *pairs])
    if len(found) > 1 << 16:  # as many buckets as values: marking them is quicker than sorting
        seen = np.zeros(1 << BITS, dtype=bool)
        seen[found.astype(np.int64)] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(found).astype(np.int32)


def values(x: np.ndarray) -> np.ndarray:
    return np.where(x < HALF, 1.0, PAIR)


def _featured(rows: DataFrame) -> DataFrame:
    """(doc_id, y, text, mark) -> (doc_id, y, mark, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([features(t) for t in b.columns[-1].to_pylist()], type=pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "x"])

    return rows.select("doc_id", "y", "mark", as_bytes().alias("t")).mapInArrow(run, "doc_id long, y double, mark long, x array<int>")


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[float, np.ndarray]], z: np.ndarray, n: np.ndarray, epochs: int) -> None:
    """Run over (label, distinct buckets in order) rows in order, changing z and n."""
    ready = [(y, x, int(np.searchsorted(x, HALF))) for y, x in rows]  # words before pairs
    for _ in range(epochs):
        for y, x, k in ready:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2)
            w[np.abs(zx) <= L1] = 0.0
            total = w[:k].sum() + PAIR * w[k:].sum()
            g = np.full(len(x), (1 / (1 + np.exp(-min(30.0, max(-30.0, total)))) - y) * (POSITIVE if y else 1.0))
            g[k:] *= PAIR
            more = nx + g * g
            z[x] = zx + g - (np.sqrt(more) - root) / ALPHA * w
            n[x] = more


def pack(rows: DataFrame, values: int = SHARD_VALUES) -> DataFrame:
    """(shard, turn, doc_id, y, back, x) -> (shard, y, back, sizes, x) a shard: its rows in training order, up to ``values`` features; written.

    A shard's group holds a class's bound of rows at most, cut to ``values`` features before they meet.
    """
    before = F.sum(F.size("x")).over(Window.partitionBy("shard").orderBy("turn", "doc_id", "x").rowsBetween(Window.unboundedPreceding, 0))
    some = rows.withColumn("upto", before).filter(F.col("upto") <= values).drop("upto")

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = sorted(range(t.num_rows), key=lambda i, k=t.column("turn").to_pylist(), d=t.column("doc_id").to_pylist(): (k[i], d[i]))
        t = t.take(pa.array(order, type=pa.int64()))
        x = t.column("x").combine_chunks()
        parts = [t.column("y").to_numpy().astype(np.float64), t.column("back").to_numpy().astype(np.int8), x.value_lengths().to_numpy().astype(np.int32), x.flatten().to_numpy().astype(np.int32)]
        return pa.table({"shard": t.column("shard").slice(0, 1).cast(pa.int32()), **{n: pa.array([p.tobytes()], type=pa.binary()) for n, p in zip(("y", "back", "sizes", "x"), parts, strict=True)}})

    return materialize(some.groupBy("shard").applyInArrow(one, "shard int, y binary, back binary, sizes binary, x binary"), "toxic-shards")


def _rows(b: pa.RecordBatch, i: int, back: int | None) -> list[tuple[float, np.ndarray]]:
    """The (label, buckets) rows of a shard: all, or those held back, or not."""
    y, held, sizes, x = (np.frombuffer(b.column(n)[i].as_py(), dtype=k) for n, k in (("y", np.float64), ("back", np.int8), ("sizes", np.int32), ("x", np.int32)))
    ends = np.cumsum(sizes, dtype=np.int64)
    return [(float(y[j]), x[ends[j] - sizes[j] : ends[j]]) for j in range(len(y)) if back is None or held[j] == back]


def fit(shards: DataFrame, back: int | None = None) -> np.ndarray:
    """Packed shards -> weights by bucket; from all their rows, or from those held back (1), or not (0)."""
    spark = shards.sparkSession
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    if held := _rows(b, i, back):
                        z, n = (a.copy() for a in state.value)
                        ftrl(held, z, n, EPOCHS)
                        cols = [b.column("shard").slice(i, 1), *(pa.array([a.astype(np.float32).tobytes()], type=pa.binary()) for a in (z, n))]
                        yield pa.RecordBatch.from_arrays(cols, names=["shard", "z", "n"])

        got = shards.mapInArrow(run, "shard int, z binary, n binary").orderBy("shard").collect()  # a row a shard, of 2^18 pairs
        if got:
            z, n = (np.mean([np.frombuffer(r[c], dtype=np.float32) for r in got], axis=0, dtype=np.float64) for c in ("z", "n"))
        state.unpersist()
    return weights_of(z, n)


def cut_at(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of best weighted F1, halfway between two scores; 0 if a class is missing."""
    if not (0 < y.sum() < len(y)):
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hit, all_ = scores[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stand on one side
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """(doc_id, text) and (doc_id, toxic) -> weights by bucket, the threshold in the bias; all zero if a class is missing."""
    text_batches(docs.sparkSession)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).filter("y = z").select("doc_id", F.col("y").cast("double").alias("y"))
    known = materialize(known, "toxic-labels")
    have = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two classes
    if len(have) < 2:
        return np.zeros(1 << BITS)
    chosen = sample(known, "y", per_class, "doc_id")  # two classes of per_class ids at most
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    if met.select("y").distinct().count() < 2:
        return np.zeros(1 << BITS)
    rows = _featured(sample(met, "y", per_class, "doc_id", "text").withColumn("mark", F.xxhash64("text")))
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("doc_id", "mark", F.lit(41)), F.lit(SHARDS)).cast("int"), "turn": F.xxhash64("doc_id", "mark", F.lit(47)), "back": (F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(5)) == 0).cast("int")})
    shards = pack(rows.drop("mark"))
    held = scored(shards, fit(shards, 0)).toPandas()  # a fifth of the sample, two numbers a row
    y = held["y"].to_numpy()
    weight = np.where(y == 1, have[1.0] / max(1, (y == 1).sum()), have[0.0] / max(1, (y == 0).sum()))
    weights = fit(shards).copy()
    weights[0] -= cut_at(held["s"].to_numpy(), y, weight)
    return weights


def scored(shards: DataFrame, weights: np.ndarray) -> DataFrame:
    """Packed shards -> (y, s) of the rows held back, s being the weighted sum."""
    shared = shards.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = _rows(b, i, 1)
                s = [float((shared.value[x] * values(x)).sum()) for _, x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], type=pa.float64()), pa.array(s, type=pa.float64())], names=["y", "s"])

    return shards.mapInArrow(run, "y double, s double")


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents -> (doc_id, score)."""
    text_batches(docs.sparkSession)
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        full = np.zeros(1 << BITS)
        full[at] = w * values(at)
        for b in batches:
            got = np.array([full[features(t)].sum() for t in b.columns[1].to_pylist()])
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array(1 / (1 + np.exp(-np.clip(got, -30, 30))) if len(at) else np.zeros(len(got)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes().alias("t")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted; learnt from labelled documents that are not held out."""
    held = crc() % 5 == 0
    weights = train(docs, labels.filter(~held))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
