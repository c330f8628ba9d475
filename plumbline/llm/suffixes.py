"""Passages that repeat across documents, found with a sparse suffix array over content-selected positions.

A passage is ``words`` consecutive words or more that an earlier document, or an earlier place of the same document, has
too. The first occurrence stays, later ones are spans to remove.

1. Retained suffixes: a position is kept where the hash of its next ``kmer`` words is the least (leftmost) in some window
   of ``window`` positions. The choice depends on content alone, so a passage of ``words`` words has the same retained
   position wherever it stands, among its first ``window`` words. Suffixes whose first words - window + 1 words nothing else
   has cannot match and go (by a hash, as a filter only); they are the bulk of a clean corpus.
2. A retained suffix stands for the stretch of words that its passages cover. Equal stretches (128-bit XXH3 of their bytes;
   10^12 of them give a false equal with probability 10^-15) are settled at once, however many copies there are: all but
   the first are repeats, and the first alone goes on.
3. The suffixes left are sorted by their words, those of equal first words together, and each is compared with its neighbours
   word by word. The common prefixes of neighbours say which suffixes agree in their first d words: a run of neighbours
   without a shorter common prefix between them. Inside such runs they are then sorted by the words to their left, read
   backwards, and compared in the same way, which extends the matches to the left. Two suffixes have a passage in common
   that begins j words before them if they are in one run to the left for j words and in one to the right for words - j.
4. The first document of each such pair of runs stays, the passages of the others are covered, and overlapping passages
   merge into spans of full length.

Suffixes are dealt to tasks by their first words, unless more than ``HOT`` have the same ones: these are sorted over ranges
instead. Sort keys end with document and position, so a run of any size is cut into ranges anywhere; what a range needs of the
one before it is the number of its last run at each depth, worked out from the first and last row of every range (two rows a
range of hot suffixes reach the driver, and the hundred sort keys a range by which Spark chooses the ranges). The first of a group is combined before the shuffle and joined back from written tables, so that
adaptive execution can split a group that holds a third of all rows.

Documents are ordered by doc_id, null last, then by a hash of their text; the order decides what is earlier, so ties do not
occur but for repeated rows of equal doc_id and text, which are one document: they are no repeats of each other, and all are
cut alike. Null texts and texts of fewer than ``words`` words have no spans and are the source of none. White space between
words is not compared. An empty table gives an empty result; a long text is read whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import apart, as_bytes, discard, materialize, rolling, text_batches, word_hashes

WORDS, KMER, WINDOW = 50, 8, 24
#: Suffixes of equal first words that one task sorts at most.
HOT = 500_000
#: Place of null doc_ids in the order.
LAST = (1 << 63) - 1
#: More words than any common prefix, where a neighbour is not known yet.
UNKNOWN = 1 << 20
#: Longer rows are compared pair by pair, not as a padded matrix.
WIDE = 4096


def minimisers(hashes: np.ndarray, kmer: int, window: int) -> np.ndarray:
    """Position of the least k-mer, leftmost on ties, among those that start at i .. i + window - 1, for each i."""
    at = np.arange(len(hashes) - kmer + 1)
    order = rolling(hashes, at, at + kmer)
    out = []
    for a in range(0, len(order) - window + 1, 1 << 16):  # long texts in pieces
        part = np.lib.stride_tricks.sliding_window_view(order[a : a + (1 << 16) + window - 1], window)
        out.append(a + np.arange(len(part)) + part.argmin(axis=1))
    return np.concatenate(out)


def retained(hashes: np.ndarray, words: int, kmer: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): retained positions; the passages that begin at first..last have theirs there."""
    n = len(hashes)
    if n < words:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, first = np.unique(minimisers(hashes, kmer, window)[: n - words + 1], return_index=True)
    return at, first, np.append(first[1:], n - words + 1) - 1


def normal(data: bytes) -> tuple[bytes, list[int]]:
    """A text with one blank after each word, and where its words begin; the last entry is the end."""
    parts = data.split()
    return b" ".join(parts) + b" ", np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1))).tolist()


def _named(docs: DataFrame) -> DataFrame:
    """key, mark: what tells documents apart and orders them; t: the text's bytes."""
    return docs.select(*_names(), as_bytes().alias("t"))


def _names() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("mark")


def _suffixes(docs: DataFrame, words: int, kmer: int, window: int) -> DataFrame:
    """Retained suffixes with a hash of their first words and a key of their stretch."""

    def one(t: bytes) -> tuple:
        h = word_hashes(t)[0]
        at, first, last = retained(h, words, kmer, window)
        if not len(at):
            return at, first, last, at, []
        text, begins = normal(t)
        key = xxhash.xxh3_128_digest
        stretch = [key(text[begins[a] : begins[b + words]]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return at, first, last, rolling(h, at, at + words - window + 1).view(np.int64), stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t) for t in b.columns[2].to_pylist()]
            of = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]))
            whole = [np.concatenate([x[i] for x in got]) if got else np.zeros(0, dtype=np.int64) for i in range(4)]
            cols = [b.columns[0].take(of), b.columns[1].take(of), *(pa.array(x.astype(np.int32)) for x in whole[:3]), pa.array(whole[3].astype(np.int64)), pa.array([s for x in got for s in x[4]], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "mark", "at", "first", "last", "prefix", "stretch"])

    return _named(docs).mapInArrow(run, "key long, mark long, at int, first int, last int, prefix long, stretch binary")


def _spelt(rows: DataFrame, words: int, common: int) -> DataFrame:
    """(key, mark, t, parts) -> a row a suffix: a hash of its first words, its words in its stretch, to the right in order and to
    the left backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, mark, t, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, begins = normal(t)
                right = [text[begins[p["at"]] : begins[p["last"] + words]] for p in parts]
                left = [b"".join(w + b" " for w in reversed(text[begins[p["first"]] : begins[p["at"]]].split())) for p in parts]
                number = lambda f: pa.array([f(p) for p in parts], type=pa.int32())
                core = np.array([xxhash.xxh3_64_intdigest(text[begins[p["at"]] : begins[p["at"] + common]]) for p in parts], dtype=np.uint64).view(np.int64)
                cols = [pa.array([key] * len(parts), type=pa.int64()), pa.array([mark] * len(parts), type=pa.int64()), pa.array(core), number(lambda p: p["at"]), number(lambda p: p["at"] - p["last"]), number(lambda p: p["at"] - p["first"]), pa.array(right, type=pa.binary()), pa.array(left, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "mark", "core", "at", "low", "high", "right", "left"])

    return rows.mapInArrow(run, "key long, mark long, core long, at int, low int, high int, right binary, left binary")


def shared_words(rows: list[bytes]) -> np.ndarray:
    """Words that each row but the first has in common with the one before it, from the start; a blank ends each word."""
    if len(rows) < 2:
        return np.zeros(0, dtype=np.int64)
    width = max(1, *map(len, rows))
    if width > WIDE:
        return np.array([_shared(a, b) for a, b in zip(rows, rows[1:], strict=False)], dtype=np.int64)
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)
    differ = m[1:] != m[:-1]
    upto = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return ((m[1:] == 32) & (np.arange(width)[None, :] < upto[:, None])).sum(axis=1)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.frombuffer(a[:n], dtype=np.uint8) != np.frombuffer(b[:n], dtype=np.uint8)
    return a.count(b" ", 0, int(differ.argmax()) if differ.any() else n)


def _digests(row: bytes, depths: list[int]) -> list[bytes | None]:
    ends = [0, *(i + 1 for i, c in enumerate(row) if c == 32)]
    return [xxhash.xxh3_128_digest(row[: ends[d]]) if d < len(ends) else None for d in depths]


def _neighbours(group: str, by: str, depths: list[int], keep: list[str]):
    """A pass over the sorted rows of a task: what each shares with its neighbours of the same group.

    ``ids``: for each depth, the row of the range where the run begins that agrees in so many words; ``most``: the most
    words shared with the row before or after; ``edge``: for the first and last row of a range, a 128-bit digest of its
    first words at each depth, null where it has not so many.
    """
    depth = np.array(depths)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, same, begins, done = None, None, None, 0

        def made(rows: pa.RecordBatch, shared: np.ndarray, ids: np.ndarray, base: int, after: np.ndarray, closed: bool) -> pa.RecordBatch:
            n = rows.num_rows
            at = base + np.arange(n)
            edge = [_digests(rows.column(by)[i].as_py(), depths) if at[i] == 0 or closed and i == n - 1 else None for i in range(n)]
            offsets = pa.array(np.arange(0, n * len(depths) + 1, len(depths), dtype=np.int32))
            cols = [rows.column(c) for c in keep]
            cols += [pa.array(at), pa.ListArray.from_arrays(offsets, pa.array(ids.T.astype(np.int64).ravel())), pa.array(np.maximum(shared, after).astype(np.int32)), pa.array(edge, type=pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=[*keep, "n", "ids", "most", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            common = shared_words(rows.column(by).to_pylist())
            of = rows.column(group).to_numpy()
            common = np.where(of[1:] == of[:-1], common, -1)
            shared = np.concatenate(([UNKNOWN if held is None else same], common))
            at = done + np.arange(rows.num_rows)
            starts = np.where(shared[None, :] < depth, at[None, :], 0)
            starts[:, 0] = 0 if held is None else begins
            ids = np.maximum.accumulate(starts, axis=1)
            yield made(rows.slice(0, rows.num_rows - 1), shared[:-1], ids[:, :-1], done, shared[1:], False)
            held, same, begins, done = rows.slice(rows.num_rows - 1), shared[-1], ids[:, -1], done + rows.num_rows - 1
        if held is not None:
            yield made(held, np.array([same]), begins[:, None], done, np.array([UNKNOWN]), True)

    return run


def _numbered(rows: DataFrame, group: str, by: str, depths: list[int], keep: list[str], kinds: str, name: str) -> DataFrame:
    """Rows sorted by words within their group and numbered by run: ``keep``, ids array<long> by depth, most."""
    order, passed = [group, by, "key", "mark", "at"], ["part", *keep, group]
    schema = f"part int, {kinds}, {group} long, n long, ids array<long>, most int, edge array<binary>"

    def pass_over(dealt: DataFrame) -> DataFrame:
        ready = dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        return materialize(ready.mapInArrow(_neighbours(group, by, depths, passed), schema), name)

    number = lambda x, whole: F.shiftleft(F.col("part").cast("long"), 32) + x + F.lit(whole)
    hot = materialize(rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(F.col(group).alias("__group"), "n"), f"{name}-hot")
    many = hot.agg(F.sum("n")).first()[0] or 0
    calm = rows.join(hot, F.col(group) == F.col("__group"), "left_anti") if many else rows
    out = pass_over(calm.repartition(group)).select(*keep, F.transform("ids", lambda x: number(x, 0)).alias("ids"), "most")
    if not many:
        return out
    ranges = rows.join(hot.select("__group"), F.col(group) == F.col("__group"), "left_semi").repartitionByRange(-(-many // HOT), *order)
    found = pass_over(ranges)
    ends = found.filter("edge is not null").select("part", "n", "ids", "edge", group).collect()  # two rows a range, of numbers and digests
    carry, before, opened = [], None, None
    for r in sorted(ends, key=lambda r: (r["part"], r["n"])):
        own = [(r["part"] << 32) + x + (1 << 62) for x in r["ids"]]
        if r["n"] == 0:
            goes_on = before is not None and r[group] == before[group]
            opened = [opened[i] if goes_on and e is not None and e == before["edge"][i] else own[i] for i, e in enumerate(r["edge"])]
            carry.append((r["part"], opened))
        else:
            opened = [opened[i] if x == 0 else own[i] for i, x in enumerate(r["ids"])]
        before = r
    table = F.broadcast(rows.sparkSession.createDataFrame(carry, "__part int, carry array<long>"))  # a row a range
    whole = F.zip_with("ids", "carry", lambda x, c: F.when(x == 0, c).otherwise(number(x, 1 << 62)))
    return out.union(found.join(table, F.col("part") == F.col("__part")).select(*keep, whole.alias("ids"), "most"))


def _first(rows: DataFrame, keys: list[str], name: str, *more: Column) -> DataFrame:
    """The first (key, mark, at) of the rows of equal keys, where there are several."""
    least = rows.groupBy(*keys).agg(F.min(F.struct("key", "mark", "at")).alias("of"), F.count("*").alias("n"), *more).filter("n > 1").drop("n")
    return materialize(least.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in least.columns if c not in keys)), name)


def spans(docs: DataFrame, words: int = WORDS, kmer: int = KMER, window: int = WINDOW) -> DataFrame:
    """documents -> (key, mark, spans array<struct<start, stop, of>>) in words, for documents that repeat earlier text.

    ``key`` is the doc_id, LAST for null; ``of`` is the least key of a document met along the span that has it earlier.
    """
    if words < window + kmer:
        raise ValueError("words must be at least window + kmer")
    text_batches(docs.sparkSession)
    place = F.struct("key", "mark", "at")
    every = materialize(_suffixes(docs, words, kmer, window), "suffixes")
    alike = materialize(every.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("prefix").alias("__key")), "suffix-prefixes")
    met = materialize(every.join(alike, F.col("prefix") == F.col("__key"), "left_semi"), "suffix-met")
    discard(every, alike)

    equal = _first(met, ["stretch"], "suffix-stretches")
    judged = materialize(met.join(equal, F.col("stretch") == F.col("__stretch"), "left").select("key", "mark", "at", "first", "last", "prefix", F.when(F.col("of") < place, F.col("of")).alias("of")), "suffix-judged")
    settled = judged.filter("of is not null").select("key", "mark", F.col("first").alias("start"), (F.col("last") + words).alias("stop"), F.col("of.key").alias("of"))
    first = judged.filter("of is null").select("key", "mark", "at", "first", "last", "prefix").distinct()
    others = materialize(first.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("prefix").alias("__key")), "suffix-runs")
    open_ = first.join(others, F.col("prefix") == F.col("__key"), "left_semi")
    discard(met, equal)

    parts = open_.groupBy("key", "mark").agg(F.collect_list(F.struct("at", "first", "last")).alias("parts"))  # of one document
    texts = _named(docs).join(parts.withColumnsRenamed({"key": "__key", "mark": "__mark"}).hint("merge"), (F.col("key") == F.col("__key")) & (F.col("mark") == F.col("__mark")))
    spelt = materialize(_spelt(texts.select("key", "mark", "t", "parts"), words, words - window + 1), "suffix-words")
    own, kinds = ["key", "mark", "at", "low", "high"], "key long, mark long, at int, low int, high int"
    right = _numbered(spelt, "core", "right", list(range(words - window + 1, words + 1)), [*own, "left"], f"{kinds}, left binary", "suffix-right")
    right = right.filter(f"{words} - most <= high").select(*own, "left", F.col("ids").alias("rights"), F.element_at("ids", 1).alias("run"), F.greatest("low", words - F.col("most")).alias("from"))
    left = _numbered(right, "run", "left", list(range(window)), [*own, "rights", "from"], f"{kinds}, rights array<long>, from int", "suffix-left")

    j, upto = F.col("j"), F.least("high", "most")
    each = left.filter(F.col("from") <= upto).withColumn("j", F.explode(F.sequence(F.col("from"), upto)))
    each = each.select("key", "mark", (F.col("at") - j).cast("int").alias("at"), j.cast("int").alias("j"), F.element_at("ids", j + 1).alias("l"), F.element_at("rights", window - j).alias("r"))
    each = materialize(each, "suffix-passages")
    same = _first(each, ["j", "l", "r"], "suffix-firsts")
    later = each.join(same, (F.col("j") == F.col("__j")) & (F.col("l") == F.col("__l")) & (F.col("r") == F.col("__r"))).filter(F.col("of") < place)
    covered = later.select("key", "mark", F.col("at").alias("start"), (F.col("at") + words).alias("stop"), F.col("of.key").alias("of")).union(settled)
    ranges = covered.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "stop", "of")).alias("ranges"))  # of one document
    return ranges.mapInArrow(_merge, "key long, mark long, spans array<struct<start: int, stop: int, of: long>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of covered words of a document -> maximal spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("of", pa.int64())]))
    for b in batches:
        out = []
        for ranges in b.columns[2].to_pylist():
            spans: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["start"], r["stop"], r["of"])):
                if spans and r["start"] <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], r["stop"])
                    spans[-1]["of"] = min(spans[-1]["of"], r["of"])
                else:
                    spans.append(dict(r))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, type=kind)], names=["key", "mark", "spans"])


def cut(data: bytes, parts: list[dict]) -> bytes:
    """A text without the words of its spans and the white space that follows them."""
    starts = np.append(word_hashes(data)[1], len(data))
    out, at = [], 0
    for p in parts:
        out.append(data[at : starts[p["start"]]])
        at = int(starts[min(p["stop"], len(starts) - 1)])
    return b"".join([*out, data[at:]])


@apart("doc_id", "text", "n_chars")
def remove(docs: DataFrame, words: int = WORDS, kmer: int = KMER, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages; documents of which no word is left go. n_chars, where there is one, is counted anew."""
    found = materialize(spans(docs, words, kmer, window), "suffix-spans")
    keep = [f.name for f in docs.schema]
    key, mark = _names()
    own = docs.withColumns({"__key": key, "__mark": mark})
    joined = own.join(found.hint("merge"), (F.col("__key") == F.col("key")) & (F.col("__mark") == F.col("mark")), "left").select(*keep, "spans")
    place = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None or not s else cut(t, s) for t, s in zip(b.columns[place].to_pylist(), b.columns[-1].to_pylist(), strict=True)]
            left = pa.array([not s or bool(t.strip()) for t, s in zip(new, b.columns[-1].to_pylist(), strict=True)], type=pa.bool_())
            cols = list(b.columns[:-1])
            cols[place] = pa.array(new, type=pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=keep).filter(left)

    binary = joined.withColumn("text", F.col("text").cast("binary"))
    out = binary.mapInArrow(run, binary.drop("spans").schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*keep)


def report(docs: DataFrame) -> DataFrame:
    """documents -> a row for each repeated span: doc_id, start_word, n_words, first_doc_id; repeated rows give theirs once."""
    each = spans(docs.select("doc_id", "text")).select("key", F.explode("spans").alias("s"))
    id_of = lambda c: F.when(c != LAST, c)
    return each.select(id_of(F.col("key")).alias("doc_id"), F.col("s.start").alias("start_word"), (F.col("s.stop") - F.col("s.start")).alias("n_words"), id_of(F.col("s.of")).alias("first_doc_id"))
