"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Size of a document: its number of words. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; they share
   the corpus' words by weight, a source's target stops at ``cap`` times its size, and the excess goes to the others by
   weight. With sources ordered by the multiplier at which they reach their cap that is one running sum.
2. Documents with words fall into the shards of their source, ``SHARD_DOCS`` a shard on average whatever the source's size,
   by a seeded digest of doc_id and text; a (source, shard) pair is a stream of its documents' words, in the order of that
   digest, cut into blocks of ``block`` words. Blocks are the seats: sources get integer quotas from their targets, then the
   shards of a source get theirs from its quota, both by highest quotients v/(2k+1). Only the seats between the round-down
   and the round-up of the proportional share are ranked (a divisor of V/(S -+ n/2) bounds the result on either side), so
   the ranking holds about two rows a party, not one a seat.
3. A shard takes whole passes over its stream and, for the rest, blocks in seeded order: that of a digest of seed, source,
   shard and block. The digest of the last block taken is found once a stream; which blocks a document overlaps follows
   from its offset, so no row is made per block.

A document is taken at most ``cap`` times its size and a source meets its target to within a block (and what the cap cuts
off in its smallest shards): one whose target is under half a block takes nothing. Null and empty texts have size 0 and are never taken; an empty table gives an empty result;
rows of null or repeated doc_id are documents of their own, and rows of equal doc_id, text and source are interchangeable;
long texts are read whole; equal quotients go to the source or shard that comes first; other columns are not read. Reruns
agree, as every order is by digest and columns. The shuffles carry ids and sizes, never texts. Ranks and running sums are
taken over ranges of a sorted table, so neither sources nor the shards of one source meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, apart, materialize

BLOCK, CAP, SEED = 32, 3, 7
SHARD_DOCS = 256


def size(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over the rows that come before in a total order.

    The table is sorted by ranges; sums run inside each, and the ranges' totals, one row a range, give what precedes them.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    offsets = totals.select(F.col("__part").alias("__of"), *(F.coalesce(F.sum(f"__{k}").over(earlier), zero).alias(f"__{k}") for k in sums))
    out = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # a row a range
    return out.withColumns({k: F.coalesce(F.sum(c).over(inside), zero) + F.col(f"__{k}") for k, c in sums.items()}).drop("__part", "__of", *(f"__{k}" for k in sums))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def _hidden(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"__{k}" for k in keys})


def targets(totals: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, capped, the excess reshared. One row a source."""
    named = [F.col("source").isNull(), F.col("source")]
    w = running(totals.select("source", "source_size"), named, {"place": F.lit(1)}, "mix-order").withColumn("weight", (F.col("place") % 3 + 1).cast("double"))
    w = w.withColumn("until", cap * F.col("source_size") / F.col("weight"))
    w = running(w, [F.col("until"), *named], {"used": cap * F.col("source_size"), "lighter": F.col("weight")}, "mix-caps")
    whole = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(whole[0] or 0) - F.col("used")) / (F.lit(whole[1] or 0.0) - F.col("lighter"))
    level = w.agg(F.min_by(level, F.when(level <= F.col("until"), F.struct("until", *(c.alias(f"s{i}") for i, c in enumerate(named)))))).first()[0] or 0.0
    return w.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the seats of each group go to its parties by the highest votes/(2k+1), k = 0, 1, ...

    ``seats`` is the same in all rows of a group. Ties go to the party that comes first by ``party``. Parties without votes
    get none; a group without votes gives none.
    """
    v, s, keys = F.col(votes).cast("double"), F.col(seats).cast("double"), [*group, *party]
    whole = _hidden(parties.groupBy(*group).agg(F.sum(v).alias("__v"), F.count_if(v > 0).alias("__n")), group)
    p = parties.join(whole, _same(group), "left").drop(*(f"__{k}" for k in group))
    share = lambda shift: F.floor(v * F.greatest(s + shift, F.lit(0.0)) / F.col("__v") + 0.5)
    some = (v > 0) & (s > 0)
    p = p.withColumn("__low", F.coalesce(F.when(some, F.greatest(share(-F.col("__n") / 2.0) - 1, F.lit(0))), F.lit(0)).cast("long"))
    p = p.withColumn("__high", F.coalesce(F.when(some, share(F.col("__n") / 2.0) + 1), F.lit(0)).cast("long")).drop("__v", "__n")
    p = materialize(p, "mix-shares")
    seat = F.explode(F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))).alias("__k")
    ranked = p.select(*keys, v.alias("__votes"), seat).withColumn("__minus", -F.col("__votes") / (2 * F.col("__k") + 1))
    ranked = running(ranked, [F.col(c) for c in (*group, "__minus", *party, "__k")], {"__before": F.lit(1)}, "mix-quotients")
    starts = _hidden(ranked.groupBy(*group).agg(F.min("__before").alias("__start")), group)
    sure = _hidden(p.groupBy(*group).agg(F.sum("__low").alias("__sure")), group)
    won = ranked.join(starts, _same(group)).drop(*(f"__{k}" for k in group)).join(sure, _same(group)).drop(*(f"__{k}" for k in group))
    free = p.select(*group, seats).distinct().withColumnsRenamed({k: f"__{k}" for k in group} | {seats: "__seats"})
    won = won.join(free, _same(group)).drop(*(f"__{k}" for k in group)).filter("__before - __start < __seats - __sure")
    won = _hidden(won.groupBy(*keys).agg(F.count("*").alias("__more")), keys)
    out = p.join(won, _same(keys), "left").withColumn("quota", F.col("__low") + F.coalesce("__more", F.lit(0)))
    return out.drop("__low", "__high", "__more", *(f"__{k}" for k in keys))


def block_key(i: Column, seed: int) -> Column:
    """What orders the blocks of a stream; the number keeps equal digests apart."""
    named = F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("shard").cast("string"), i.cast("string"), F.lit(str(seed)))
    return F.concat(F.md5(named), F.lpad(i.cast("string"), 12, "0"))


def plan(docs: DataFrame, block: int = BLOCK, cap: int = CAP, seed: int = SEED, row: tuple[str, ...] = ()) -> DataFrame:
    """Quotas applied to documents: doc_id, source, size, source_size, target, taken and how the stream is cut.

    passes, begin and takes say which words: each word ``passes`` times, then of each block that the document overlaps the
    first ``takes[block]`` words. ``row`` names columns of ``docs`` that pass through.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    tag = F.md5(F.concat_ws("|", text(F.col("doc_id").cast("string")), text(F.md5("text")), F.lit(str(seed))))
    sized = materialize(docs.select("doc_id", "source", *row, size().alias("size"), tag.alias("tag")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    totals = materialize(totals, "mix-totals")
    dealt = sized.join(_hidden(totals.select("source", F.greatest(F.floor(F.col("docs") / SHARD_DOCS), F.lit(1)).alias("shards")), ["source"]), _same(["source"])).drop("__source")
    dealt = materialize(dealt.withColumn("shard", F.when(F.col("size") > 0, F.conv(F.substring("tag", 1, 8), 16, 10).cast("long") % F.col("shards"))).drop("shards"), "mix-shards")

    sources = targets(totals, cap)
    seats = sources.agg(F.floor(F.sum("target") / block + 0.5).cast("long")).first()[0] or 0
    sources = sainte_lague(sources.withColumn("seats", F.lit(seats)), [], ["source"], "target", "seats")
    sources = materialize(sources.select(F.col("source").alias("__source"), "source_size", "target", F.col("quota").alias("seats")), "mix-sources")

    streams = dealt.filter("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("stream"))
    parts = sainte_lague(streams.join(sources, _same(["source"])).drop("__source", "source_size", "target"), ["source"], ["shard"], "stream", "seats")
    words, stream = F.col("words"), F.col("stream")
    parts = parts.withColumn("words", F.least(F.col("quota") * block, stream * cap)).withColumn("passes", F.expr("words div stream"))
    rest = words - F.col("passes") * stream
    parts = parts.withColumns({"blocks": F.floor(stream / block), "full": F.floor(rest / block), "part": rest % block})
    keys = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: block_key(i, seed)))
    parts = parts.withColumn("last", F.when(F.col("full") < F.col("blocks"), F.get(keys, F.col("full").cast("int"))))
    parts = materialize(parts.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "passes", "blocks", "full", "part", "last"), "mix-parts")

    order = Window.partitionBy("source", "shard").orderBy("tag", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.filter("size > 0").withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(parts, _same(["source", "shard"])).drop("__source", "__shard")
    first, end = F.floor(F.col("begin") / block), F.col("begin") + F.col("size")
    open_ = (F.col("full") > 0) | (F.col("part") > 0)
    placed = placed.withColumn("takes", F.when(open_, F.transform(F.sequence(first, F.floor((end - 1) / block)), lambda i: _words_in(i, block, seed))))
    covered = lambda n, i: F.greatest(F.lit(0).cast("long"), F.least(end, (first + i) * block + n) - F.greatest(F.col("begin"), (first + i) * block))
    extra = F.coalesce(F.aggregate(F.transform("takes", covered), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    placed = placed.withColumn("taken", F.col("passes") * F.col("size") + extra).select("doc_id", "source", *row, "size", "taken", "passes", "begin", "takes")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    empty = dealt.filter("size = 0").select("doc_id", "source", *row, "size", F.lit(0).cast("long").alias("taken"), none("long", "passes"), none("long", "begin"), none("array<long>", "takes"))
    return placed.union(empty).join(sources.drop("seats"), _same(["source"])).drop("__source")


def _words_in(i: Column, block: int, seed: int) -> Column:
    """Words that the last, partial pass takes of block i; the stream's tail comes after all blocks."""
    key, part = block_key(i, seed), F.col("part")
    ordered = F.when(F.col("last").isNull() | (key < F.col("last")), F.lit(block)).when(key == F.col("last"), part).otherwise(0)
    return F.when(i < F.col("blocks"), ordered).when(F.col("full") == F.col("blocks"), part).otherwise(0).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, size, source_size, target, taken."""
    return plan(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@apart("doc_id", "text", "source", "n_chars")
def apply(docs: DataFrame, block: int = BLOCK, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each document once for every whole pass, and once more with the words of its selected blocks.

    Words keep the white space after them. Rows are found again by a number that the written table gives each, so null and
    repeated doc_ids are rows like any other; n_chars, where there is one, is counted anew.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    cut = plan(rows.select("doc_id", "source", "text", "__row"), block, cap, seed, ("__row",)).select("__row", "size", "taken", "passes", "begin", "takes").filter("taken > 0")
    out = rows.join(cut.hint("merge"), "__row")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    first = F.floor(F.col("begin") / block)
    at = lambda j: F.col("begin") + j
    chosen = F.filter(pieces, lambda _, j: at(j) % block < F.get(F.col("takes"), (F.floor(at(j) / block) - first).cast("int")))
    copies = F.when(F.col("passes") > 0, F.array_repeat(F.lit(True), F.col("passes").cast("int"))).otherwise(F.array().cast("array<boolean>"))
    more = F.when(F.col("taken") > F.col("passes") * F.col("size"), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    out = out.withColumn("__whole", F.explode(F.concat(copies, more)))
    out = out.withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(F.array_join(chosen, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
