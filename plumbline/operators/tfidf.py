"""TF-IDF: unigrams and bigrams, the most frequent terms, smooth idf with +1, unit rows.

A row is packed: places in the vocabulary, how often each term is there, and its weight, three arrays. All terms of a text
stand in its row, so counting and weighing them needs no shuffle: one pass of Arrow batches looks a batch's terms up in the
vocabulary at once.

The vocabulary is found in two passes that shuffle no table of all terms. In the first each task keeps a Misra-Gries summary
of the terms it meets (mergeable, after Agarwal et al. 2012): ``COUNTERS`` counters that never count too much, and how much
they may count too little. Tokens are numbered a piece at a time, so that pairs are counted as numbers and become words only if they
are kept: of a piece with many terms, those that it has once are not. Added up over the tasks the counters tell which terms can be
among the most frequent; the second pass counts these, exactly. Where the possible error reaches the last place of the vocabulary the summaries do not settle it, and all
terms are counted, combined before the shuffle. Either way the vocabulary is the exact one.

An index that is to grow (``growable``) keeps the totals of all its terms as a table of its own. ``append_texts`` adds those
of the new texts, takes the vocabulary and the weights of the whole from the sums, and reads an old text again only if a term
has come into the vocabulary: what it has of the other terms stands in its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.text import tokenize
from plumbline.sources.shared import materialize

#: A vocabulary has this many terms at most, which bounds what is broadcast.
MAX_FEATURES = 1000
#: Counters of a task's summary. A term's count is at most (terms of the corpus) / COUNTERS too low.
COUNTERS = 50_000
#: Terms that the second pass counts at most.
CANDIDATES = 100_000
#: Tokens that a worker takes apart at once (or one text), and terms whose sums it holds before it hands them on.
PIECE, HELD = 100_000, 200_000


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, text) -> (key, term, tf).

    All terms of a text stand in its row and are counted there; only texts that share a key are shuffled.
    """
    own = texts.select(F.col(key).alias("key"), _tokens(None))
    twice = texts.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 1):
            row, term = _terms(b.column(1))
            coded = term.dictionary_encode()
            n = max(1, len(coded.dictionary))
            cell, tf = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cell // n)), coded.dictionary.take(pa.array(cell % n)), pa.array(tf)], names=["key", "term", "tf"])

    kind = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    count = lambda df: df.mapInArrow(run, kind)
    if not twice.limit(1).count():
        return count(own).withColumnRenamed("key", key)
    twice = materialize(twice.select(F.col("key").alias("other")), "shared-keys")
    same = F.expr("key <=> other")
    shared = count(own.join(twice, same, "left_semi")).groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    return count(own.join(twice, same, "left_anti")).unionByName(shared).withColumnRenamed("key", key)


def _tokens(tokens: str | None):
    return (F.col(tokens) if tokens else tokenize("text")).alias("tokens")


def _terms(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every unigram and bigram of a batch of token lists."""
    flat, row = tokens.flatten(), np.repeat(np.arange(len(tokens)), pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False))
    inside = pa.array(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(flat[:-1].filter(inside), flat[1:].filter(inside), " ")
    return np.concatenate([row, row[1:][row[1:] == row[:-1]]]), pa.chunked_array([flat, pairs.cast(flat.type)]).combine_chunks()


class Places:
    """Terms by place, to be found in token lists: as words, and as pairs of numbers of words, so that no pair is put together."""

    def __init__(self, terms: pa.Array) -> None:
        cut = [t.split(" ") for t in terms.to_pylist()]  # a token has no blank
        self.words = pa.array(sorted({w for t in cut for w in t}), type=pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number) + 1, -1)  # the last is that of unknown words
        self.single[[number[t[0]] for t in cut if len(t) == 1]] = [at for at, t in enumerate(cut) if len(t) == 1]
        pairs = sorted((number[t[0]] * len(number) + number[t[1]], at) for at, t in enumerate(cut) if len(t) == 2)
        self.pairs, self.pair = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))

    def find(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every unigram and bigram of a batch of token lists that is one of the terms."""
        row = _rows(tokens)
        word = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, some = self.single[word], (row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
        both = word[:-1][some] * len(self.words) + word[1:][some]
        near = np.minimum(np.searchsorted(self.pairs, both), max(0, len(self.pairs) - 1))
        hit = self.pairs[near] == both if len(self.pairs) else np.zeros(len(both), dtype=bool)
        return np.concatenate([row[at >= 0], row[1:][some][hit]]), np.concatenate([at[at >= 0], self.pair[near[hit]]])


def _rows(tokens: pa.Array) -> np.ndarray:
    """The row of each token of a batch of token lists."""
    return np.repeat(np.arange(len(tokens)), pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False))


def _counted(tokens: pa.Array, many: int) -> tuple[pa.Table, int]:
    """(term, n) of a batch of token lists. Of more than ``many`` terms those that are there once are left out; and if any is."""
    row, coded = _rows(tokens), tokens.flatten().dictionary_encode()
    word, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    singles, inside = np.bincount(word, minlength=len(words)), row[1:] == row[:-1]
    got = pc.value_counts(pa.array(word[:-1][inside] * len(words) + word[1:][inside]))
    pairs, n = (got.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    least = 2 if len(singles) + len(pairs) > many else 1
    take = lambda at: words.take(pa.array(at))
    kept, often = np.flatnonzero(singles >= least), pairs[n >= least]
    joined = pc.binary_join_element_wise(take(often // max(1, len(words))), take(often % max(1, len(words))), " ")
    terms = pa.chunked_array([take(kept).cast(pa.string()), joined.cast(pa.string())])
    left = len(kept) + len(often) < len(singles) + len(pairs)
    return pa.table({"term": terms, "n": pa.array(np.concatenate([singles[kept], n[n >= least]]).astype(np.int64))}), int(left)


def _small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows with some ``PIECE`` tokens in a column of lists, one row at least: what a worker holds does not grow."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(b.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            yield b.slice(at, upto - at)
            at = upto


class Summary:
    """Misra-Gries counters of terms: counts that are never too high, and ``error``, the most that they can be too low."""

    def __init__(self, counters: int) -> None:
        self.counters, self.error, self.held = counters, 0, []
        self.counts = pa.table({"term": pa.array([], type=pa.string()), "n": pa.array([], type=pa.int64())})

    def add(self, tokens: pa.Array) -> None:
        """The terms of a batch of token lists. They are added up when there are as many as counters."""
        more, missed = _counted(tokens, self.counters // 2)
        self.error += missed
        self.held.append(more)
        if sum(x.num_rows for x in self.held) > self.counters:
            self.merge()

    def merge(self) -> None:
        merged = pa.concat_tables([self.counts, *self.held]).group_by("term").aggregate([("n", "sum")])
        self.counts, self.held = pa.table({"term": merged.column("term"), "n": merged.column("n_sum")}), []
        if self.counts.num_rows > 2 * self.counters:
            self.prune()

    def prune(self) -> None:
        """Take the count of the first counter too many off every counter."""
        n = self.counts.column("n").to_numpy()
        if len(n) > self.counters:
            cut = int(np.partition(n, len(n) - self.counters - 1)[len(n) - self.counters - 1])
            self.error += cut
            left = self.counts.filter(pa.array(n > cut))
            self.counts = pa.table({"term": left.column("term"), "n": pc.subtract(left.column("n"), cut)})


def heavy_terms(texts: DataFrame, tokens: str | None = None, counters: int = COUNTERS) -> DataFrame:
    """(term, low): the sum of the tasks' counters for each term, and one row of null term, by how much they can be too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summary(counters)
        for b in _small(batches, 0):
            s.add(b.column(0))
        s.merge()
        s.prune()
        yield from s.counts.to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.string()), pa.array([s.error], type=pa.int64())], names=["term", "n"])

    return texts.select(_tokens(tokens)).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("low"))


def count_terms(texts: DataFrame, terms: list[str], tokens: str | None = None) -> DataFrame:
    """(term, total, df) of given terms, exactly; the tasks' sums are a row a term."""
    known = pa.array(terms, type=pa.string())
    shared = texts.sparkSession.sparkContext.broadcast((known, Places(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        total, df = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
        for b in _small(batches, 0):
            row, at = places.find(b.column(0))
            total += np.bincount(at, minlength=len(known))
            df += np.bincount(np.unique(row * len(known) + at) % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(some)), pa.array(total[some]), pa.array(df[some])], names=["term", "total", "df"])

    return texts.select(_tokens(tokens)).mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def term_totals(texts: DataFrame, tokens: str | None = None) -> DataFrame:
    """(term, total, df) of all terms. Workers add up what they meet, ``HELD`` terms at a time, before the shuffle."""
    empty = pa.table({"term": pa.array([], type=pa.string()), "total": pa.array([], type=pa.int64()), "df": pa.array([], type=pa.int64())})

    def summed(held: pa.Table) -> pa.Table:
        coded = held.column("term").combine_chunks().dictionary_encode()
        at, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        sums = {c: np.zeros(n, dtype=np.int64) for c in ("total", "df")}
        for c, s in sums.items():
            np.add.at(s, at, held.column(c).to_numpy())
        return pa.table({"term": coded.dictionary} | {c: pa.array(s) for c, s in sums.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = empty
        for b in _small(batches, 0):
            row, term = _terms(b.column(0))
            coded = term.dictionary_encode()
            n, at = max(1, len(coded.dictionary)), coded.indices.to_numpy(zero_copy_only=False)
            sums = np.bincount(at, minlength=len(coded.dictionary)), np.bincount(np.unique(row * n + at) % n, minlength=len(coded.dictionary))
            held = pa.concat_tables([held, pa.table({"term": coded.dictionary.cast(pa.string()), "total": pa.array(sums[0]), "df": pa.array(sums[1])})])
            if held.num_rows > HELD:
                held = summed(held)
                if held.num_rows > HELD // 2:
                    yield from held.combine_chunks().to_batches()
                    held = empty
        yield from summed(held).combine_chunks().to_batches()

    return texts.select(_tokens(tokens)).mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def vocabulary_of(totals: DataFrame, n_texts: int, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, total, df) -> (at, term, total, df, idf) of the most frequent terms, ties by term, ``at`` from 0."""
    top = totals.orderBy(F.desc("total"), "term").limit(max_features)
    place = (F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1).alias("at")  # of max_features rows
    return top.select(place, "term", "total", "df", (F.ln((1 + F.lit(float(n_texts))) / (1 + F.col("df"))) + 1).alias("idf"))


def candidates(texts: DataFrame, max_features: int, tokens: str | None = None, counters: int = COUNTERS, most: int = CANDIDATES) -> list[str] | None:
    """Terms that hold the ``max_features`` most frequent ones, or None where summaries do not settle which these are."""
    low = materialize(heavy_terms(texts, tokens, counters), "heavy-terms")
    error = low.filter("term is null").first()  # one row; none for a table without partitions
    error = error["low"] if error else 0
    top = [r["low"] for r in low.filter("term is not null").orderBy(F.desc("low")).limit(max_features).select("low").collect()]  # max_features rows
    if error and (len(top) < max_features or top[-1] <= error):
        return None  # a term that no summary has may be among them
    least = max(1, top[-1] - error) if len(top) == max_features else 1
    found = [r["term"] for r in low.filter("term is not null").filter(F.col("low") >= least).select("term").limit(most + 1).collect()]  # ``most`` rows
    return found if len(found) <= most else None


def fit_vocabulary(texts: DataFrame, max_features: int = MAX_FEATURES, tokens: str | None = None) -> DataFrame:
    """(at, term, total, df, idf) of the most frequent terms, ties by term, ``at`` from 0. An empty corpus is an error.

    ``tokens`` names a column that has a text's tokens already; else they are written once, for the passes over them.
    """
    if not tokens:
        texts, tokens = materialize(texts.select(_tokens(None)), "tokens"), "tokens"
    n_texts = texts.count()
    if not n_texts:
        raise ValueError("no texts to fit on")
    found = candidates(texts, max_features, tokens)
    return vocabulary_of(term_totals(texts, tokens) if found is None else count_terms(texts, found, tokens), n_texts, max_features)


def _vocabulary(vocabulary: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Terms by place, and their idf."""
    rows = vocabulary.select("at", "term", "idf").toArrow().sort_by("at")  # the vocabulary's bound
    return rows.column("term").combine_chunks().cast(pa.string()), rows.column("idf").to_numpy()


def _lists(row: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Values of sorted rows as lists, one a row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def _packed(keys: pa.Array, row: np.ndarray, at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> pa.RecordBatch:
    """(row, place, tf), sorted -> a batch of packed rows; rows without a term are left out."""
    w = tf * idf[at]
    w = w / np.sqrt(np.bincount(row, w * w, minlength=len(keys)))[row]
    some = pa.array(np.bincount(row, minlength=len(keys)) > 0)
    return pa.RecordBatch.from_arrays([c.filter(some) for c in (keys, *_lists(row, len(keys), at.astype(np.int32), tf.astype(np.int32), w))], names=["key", "places", "tf", "weights"])


def _schema(texts: DataFrame, key: str, *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [("key", texts.schema[key].dataType), ("places", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.IntegerType())), *more]
    return T.StructType([T.StructField(n, t) for n, t in fields])


WEIGHTS = ("weights", T.ArrayType(T.DoubleType()))


def pack(texts: DataFrame, vocabulary: DataFrame, key: str, tokens: str | None = None) -> DataFrame:
    """(key, places, tf, weights), rows of unit length; texts without known terms have no rows. One pass, no shuffle."""
    terms, idf = _vocabulary(vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast((Places(terms), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for b in _small(batches, 1):
            row, at = known.find(b.column(1))
            cell, tf = np.unique(row * max(1, len(idf)) + at, return_counts=True)
            yield _packed(b.column(0), cell // max(1, len(idf)), cell % max(1, len(idf)), tf, idf)

    return texts.select(F.col(key).alias("key"), _tokens(tokens)).mapInArrow(run, _schema(texts, key, WEIGHTS)).withColumnRenamed("key", key)


def reweigh(counted: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Packed rows under another vocabulary: places moved, terms that are gone dropped, weights anew. No text is read."""
    (was, _), (now, idf) = _vocabulary(old), _vocabulary(new)
    move = pc.fill_null(pc.index_in(was, value_set=now), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = counted.sparkSession.sparkContext.broadcast((move, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, idf = shared.value
        for b in batches:
            places, tf = b.column("places"), b.column("tf")
            row = np.repeat(np.arange(b.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
            at, n = move[places.flatten().to_numpy()] if len(row) else row, tf.flatten().to_numpy()
            row, at, n = row[at >= 0], at[at >= 0], n[at >= 0]
            order = np.lexsort((at, row))
            yield _packed(b.column("key"), row[order], at[order], n[order], idf)

    return counted.select(F.col(key).alias("key"), "places", "tf").mapInArrow(run, _schema(counted, key, WEIGHTS)).withColumnRenamed("key", key)


def unpack(packed: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Packed rows in long form: (key, term, weight)."""
    each = packed.select(key, F.explode(F.arrays_zip("places", "weights")).alias("x")).select(key, F.col("x.places").alias("at"), F.col("x.weights").alias("weight"))
    return each.join(F.broadcast(vocabulary.select("at", "term")), "at").select(key, "term", "weight")  # MAX_FEATURES rows


def embed(texts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Texts or queries under a fitted vocabulary, in long form; unknown terms count for nothing."""
    vocabulary = materialize(vocabulary, "vocabulary")
    return unpack(pack(texts, vocabulary, key), vocabulary, key)


def build_index(chunks: DataFrame, max_features: int = MAX_FEATURES, key: str = "chunk_id", growable: bool = False) -> dict[str, DataFrame]:
    """(key, text, ...) -> chunks, vocabulary, packed rows, and the same as vectors in long form; ``terms`` too if it is to grow.

    Texts are cut and tokenised once.
    """
    own = materialize(chunks.withColumn("__tokens", tokenize("text")), "index-chunks")
    index = {"chunks": own.drop("__tokens")}
    if growable:
        n = own.count()
        if not n:
            raise ValueError("no texts to fit on")
        index["terms"] = materialize(term_totals(own, "__tokens"), "index-terms")
        found = vocabulary_of(index["terms"], n, max_features)
    else:
        found = fit_vocabulary(own, max_features, "__tokens")
    index["vocabulary"] = materialize(found, "index-vocabulary")
    index["packed"] = materialize(pack(own, index["vocabulary"], key, "__tokens"), "index-vectors")
    return index | {"vectors": unpack(index["packed"], index["vocabulary"], key)}


def append_texts(index: dict[str, DataFrame], chunks: DataFrame, max_features: int = MAX_FEATURES, key: str = "chunk_id") -> dict[str, DataFrame]:
    """A growable index and new chunks -> the index of both, as ``build_index`` of both would make it. A key that is there is an error.

    Every weight changes, as idf counts the texts, but from the counts in the rows. Old texts are tokenised again only to
    look for terms that have come into the vocabulary, and only the rows that have one are put together anew.
    """
    if "terms" not in index:
        raise ValueError("the index keeps no totals of its terms: build it growable")
    own = materialize(chunks.withColumn("__tokens", tokenize("text")), "index-chunks")
    clash = own.join(index["chunks"].select(key), key, "left_semi").limit(1).count()
    if clash:
        raise ValueError(f"{key} of a new chunk is in the index")
    both = index["terms"].unionByName(term_totals(own, "__tokens")).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    terms = materialize(both, "index-terms")
    n = index["chunks"].count() + own.count()
    vocabulary = materialize(vocabulary_of(terms, n, max_features), "index-vocabulary")
    entered = vocabulary.join(index["vocabulary"].select("term"), "term", "left_anti").select("at", "term", "idf")
    old = reweigh(index["packed"], index["vocabulary"], vocabulary, key)
    if entered.limit(1).count():
        old = _with(old, pack(index["chunks"], entered.withColumn("at", F.row_number().over(Window.orderBy("at")) - 1), key), entered, vocabulary, key)
    packed = materialize(old.unionByName(pack(own, vocabulary, key, "__tokens")), "index-vectors")
    whole = index["chunks"].unionByName(own.drop("__tokens"), allowMissingColumns=True)
    return {"chunks": whole, "terms": terms, "vocabulary": vocabulary, "packed": packed, "vectors": unpack(packed, vocabulary, key)}


def _with(old: DataFrame, more: DataFrame, entered: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Rows with the counts of entered terms that their texts have (``more``, packed over ``entered`` by place); the others pass."""
    more = materialize(more, "index-entered")
    places = [r["at"] for r in entered.orderBy("at").collect()]  # of the vocabulary
    at = F.array(*map(F.lit, places))
    added = more.select(key, F.transform("places", lambda p: F.element_at(at, p + 1)).alias("p"), F.col("tf").alias("n"))
    none = F.array().cast("array<int>")
    join = F.coalesce(F.col("places"), none), F.coalesce(F.col("tf"), none)
    changed = added.join(old.select(key, "places", "tf"), key, "left").select(key, F.concat(join[0], "p").alias("places"), F.concat(join[1], "n").alias("tf"))
    same = old.join(more.select(key), key, "left_anti")
    return same.unionByName(reweigh(changed, vocabulary, vocabulary, key))


def index_stats(index: dict[str, DataFrame]) -> DataFrame:
    """One row: chunks, dimension, stored weights, number of source files and their names."""
    c = index["chunks"].agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("source_file").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("sources"))
    return c.join(index["vocabulary"].agg(F.count(F.lit(1)).alias("dimension"))).join(index["packed"].agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("index_size")))


def sample_chunks(chunks: DataFrame, n: int = 5, seed: int = 0, key: str = "chunk_id") -> DataFrame:
    """n chunks without replacement, all if there are fewer; the same ones for the same seed: the first by a digest of seed and key."""
    return chunks.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
