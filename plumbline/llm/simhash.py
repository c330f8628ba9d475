"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit where more than half of its shingles' hashes have it. Documents of equal fingerprint
collapse to one representative (the fingerprint itself) before anything is compared. Representatives meet in buckets:

* ``blocks``: the fingerprint is cut into radius + 2 blocks; two fingerprints within the radius agree in two blocks at
  least, so a bucket for each pair of blocks finds every link (exact). A bucket of more than ``CHUNK`` fingerprints is dealt
  again by the blocks of its remaining bits, which find every link in it for the same reason; at 64 bits and radius 2 a
  bucket holds 256 at the third deal, as so many differ in the eight bits left. No bucket is compared before it is small;
* ``bands``: buckets are bands of two minimum hashes of the shingles; a pair of Jaccard similarity 0.8 shares one of ten
  bands with probability 0.99996. This serves radii at which blocks would be too short to tell anything apart. Here the
  fingerprint only picks pairs: a pair within the radius is a link if the exact Jaccard similarity of its sets of shingles
  says so, and what collapses beforehand are equal sets.

In a bucket, fingerprints lie vertically: plane j holds bit j of 64 fingerprints a machine word. Comparing a row of queries
against them is one XOR a plane; carry-save counters of a few words add the differing bits of 64 pairs at once, and queries
whose pairs all exceed the radius are abandoned. A bucket sends out a star of links per group, not all its pairs. In a large
bucket of a band, whose sets may all be alike, a few pivots are the queries first, against all rows; only pairs with a row
that the pivots leave outside their main class are compared further, in chunks. Components of the links are found by stars in
``graph``.

Texts: null is the empty text; texts without words have fingerprint zero, linked like any other; fewer words than a shingle
takes make one shingle of all of them. Rows of null doc_id take part and link others like any row, but give a component no
name; one that has only such rows has null. Repeated rows fall together as copies do. An empty table gives an empty
result; long texts are read whole; a group's name is its least doc_id, so ties do not occur; other columns are not read, and
pass ``keep`` unharmed. ``keep`` goes by a number that the written table gives each row instead of doc_id, so null and
repeated ids are documents like any other there.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BASE, apart, as_bytes, bucketed, discard, materialize, mix, text_batches
from plumbline.llm.graph import components

SEED = 42
#: Rows of a bucket compared with each other outright, pivots and rows a chunk of larger ones, and rows compared at once.
CHUNK, PIVOTS, MOST_ROWS, WINDOW = 256, 8, 512, 512
BANDS = 10
#: Additions that a lane of one byte holds.
LANE = 255
#: Bytes of shingle sets that a window holds before it ends.
HELD = 64 << 20


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included: A-Z lower-cased, words joined by one space."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[k - 1 :].tolist()
    return np.array([one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Majority bits, most significant first; beyond 64 bits each further word counts remixed hashes.

    Bits are counted eight to a machine word: a byte lane takes at most 255 additions before it is emptied.
    """
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    count = np.zeros((words, 8, 8), dtype=np.int64)  # word, byte, bit
    salts = np.arange(words, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        for a in range(0, n, LANE * 16):
            part = hashes[a : a + LANE * 16]
            h = np.zeros((words, -(-len(part) // LANE) * LANE), dtype=np.uint64)
            h[:, : len(part)] = part
            if words > 1:
                h[1:, : len(part)] = mix(part[None, :] + salts[1:] * BASE)
            lanes = (h[None] >> np.arange(8, dtype=np.uint64)[:, None, None]) & np.uint64(0x0101010101010101)
            lanes = lanes.reshape(8, words, -1, LANE).sum(axis=3, dtype=np.uint64)
            count += lanes.astype("<u8").view(np.uint8).reshape(8, words, -1, 8).sum(axis=2, dtype=np.int64).transpose(1, 2, 0)
    return np.packbits((2 * count > n).reshape(words, 64)[:, ::-1], axis=1).tobytes()


_MULTIPLIERS = mix(np.arange(1, 2 * 64 + 1, dtype=np.uint64)) | np.uint64(1)


def bands(hashes: np.ndarray, n: int = BANDS) -> list[int]:
    """Keys of n bands of two minimum hashes each; none for a text without words."""
    if not len(hashes):
        return []
    with np.errstate(over="ignore"):
        low = np.array([(hashes * m).min() for m in _MULTIPLIERS[: 2 * n]])
        return mix(low[::2] * BASE + low[1::2] + np.arange(n, dtype=np.uint64)).view(np.int64).tolist()


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """documents -> (doc_id, fp binary)."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, shingle)) for t in b.columns[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array(fps, type=pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes().alias("t")).mapInArrow(run, "doc_id long, fp binary")


def set_keys(rows: DataFrame, shingle: int) -> DataFrame:
    """(__row, text) -> (row, same binary, bands array<long>): ``same`` is a digest of the set of shingles."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, keys = [], []
            for t in b.columns[1].to_pylist():
                grams = np.unique(shingle_hashes(t, shingle))
                same.append(xxhash.xxh128_digest(grams.tobytes(), SEED))
                keys.append(bands(grams))
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array(same, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64()))], names=["row", "same", "bands"])

    return rows.select("__row", as_bytes().alias("t")).mapInArrow(run, "row long, same binary, bands array<long>")


def sets(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """(__row, text) -> (__rep, fp binary, grams binary): the sorted distinct shingle hashes and the fingerprint of that set."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.unique(shingle_hashes(t, shingle)) for t in b.columns[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array([fingerprint(g, words) for g in grams], type=pa.binary()), pa.array([g.tobytes() for g in grams], type=pa.binary())], names=["__rep", "fp", "grams"])

    return rows.select("__row", as_bytes().alias("t")).mapInArrow(run, "__rep long, fp binary, grams binary")


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sorted sets of hashes have that Jaccard similarity or more."""
    m, n = len(a) // 8, len(b) // 8
    if min(m, n) < similarity * max(m, n) - 1e-9 * max(m, n):
        return False
    both = len(np.intersect1d(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), assume_unique=True))
    return both / (m + n - both) >= similarity


def confirmed(linked: np.ndarray, grams: list[bytes], similarity: float) -> np.ndarray:
    """Of the linked pairs, those of that similarity, without the pairs that others connect already."""
    root, out = list(range(len(grams))), np.zeros_like(linked)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(grams)):
        for j in np.flatnonzero(linked[i, :i]).tolist():
            x, y = find(i), find(j)
            if x != y and alike(grams[i], grams[j], similarity):
                root[x] = y
                out[i, j] = out[j, i] = True
    return out


def near(fps: np.ndarray, radius: int) -> np.ndarray:
    """n x bytes fingerprints -> n x n booleans: within the radius, the diagonal excluded."""
    return within(fps, fps, radius, own=True)


def within(queries: np.ndarray, fps: np.ndarray, radius: int, own: bool = False) -> np.ndarray:
    """Fingerprints of q queries and n rows -> q x n booleans: within the radius; ``own``: row i is query i, and no match."""
    q, n = len(queries), len(fps)
    cells = (n + 63) // 64
    bits = np.unpackbits(fps, axis=1)
    wide = np.zeros((bits.shape[1], cells * 64), dtype=np.uint8)
    wide[:, :n] = bits.T
    planes = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
    asked = np.where(np.unpackbits(queries, axis=1).T > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    active = np.arange(q)
    over = np.zeros((q, cells), dtype=np.uint64)
    if own:
        over[active, active // 64] = np.uint64(1) << (active % 64).astype(np.uint64)
    if n % 64:
        over[:, -1] |= np.uint64((0xFFFFFFFFFFFFFFFF << (n % 64)) & 0xFFFFFFFFFFFFFFFF)
    depth = radius.bit_length()
    counters = np.zeros((depth, q, cells), dtype=np.uint64)

    def exceeds() -> np.ndarray:
        more, same = over.copy(), ~over
        for i in reversed(range(depth)):
            if radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        return more

    for j in range(len(planes)):
        carry = planes[j][None, :] ^ asked[j][active][:, None]
        for i in range(depth):
            carry, counters[i] = carry & counters[i], carry ^ counters[i]
        over |= carry
        if j % 8 == 7 and j > radius:
            stay = (exceeds() != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            if not stay.all():
                active, over, counters = active[stay], over[stay], counters[:, stay]
                if not len(active):
                    break
    out = np.zeros((q, n), dtype=bool)
    if len(active):
        out[active] = np.unpackbits((~exceeds()).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


def stars(ids: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (member, least member) of each connected group of a window."""
    left = linked.any(axis=1)
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        left[i] = False
        group, edge = [i], [i]
        while len(edge):
            reach = linked[edge].any(axis=0) & left
            left &= ~reach
            edge = np.flatnonzero(reach)
            group.extend(edge)
        members = ids[group]
        low = members.min()
        yield from ((int(m), int(low)) for m in members if m != low)


def _compare(radius: int, similarity: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def window(ids: list, fps: list, units: list, grams: list) -> pa.RecordBatch:
            found = []
            if len(ids) > 1:
                linked, of = near(np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(ids), -1), radius), np.array(units)
                linked &= of[:, None] == of[None, :]  # what else fell into the window decides nothing
                if similarity is not None:
                    linked = confirmed(linked, grams, similarity)
                found = list(stars(np.array(ids, dtype=np.int64), linked))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

        ids, fps, units, grams, unit, held = [], [], [], [], None, 0
        for b in batches:
            for key, i, j, rep, fp, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != unit:  # a window ends between units, so that a unit is never cut
                    unit = (key, i, j)
                    if len(ids) >= WINDOW or held >= HELD:
                        yield window(ids, fps, units, grams)
                        ids, fps, units, grams, held = [], [], [], [], 0
                    units.append(units[-1] + 1 if units else 0)
                else:
                    units.append(units[-1])
                ids.append(rep)
                fps.append(fp)
                grams += rest
                held += sum(map(len, rest))
        yield window(ids, fps, units, grams)

    return run


def finer(mask: int, radius: int) -> list[int]:
    """The masks that two fingerprints within the radius and equal under ``mask`` are equal under, one at least.

    The bits left fall into radius + 2 blocks, and two of them are equal; where fewer bits are left, there is no finer mask.
    """
    left = [i for i in range(64) if not mask >> i & 1]
    if len(left) < radius + 2:
        return []
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(left, radius + 2)]
    return [mask | x | y for x, y in itertools.combinations(blocks, 2)]


def _block_keys(radius: int):
    """(mask, rep, fp) -> a row for each finer mask, keyed by what the fingerprint is under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            coarse = b.columns[0].to_pylist()
            fps = np.array([int.from_bytes(x, "big") for x in b.columns[2].to_pylist()], dtype=np.uint64)
            for m in set(coarse) - known.keys():
                known[m] = np.array(finer(m & 0xFFFFFFFFFFFFFFFF, radius), dtype=np.uint64)
            masks = np.concatenate([known[m] for m in coarse]) if coarse else np.zeros(0, dtype=np.uint64)
            at = np.repeat(np.arange(len(fps)), [len(known[m]) for m in coarse])
            with np.errstate(over="ignore"):
                keys = mix(mix(fps[at] & masks) + masks * BASE).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(masks.view(np.int64)), b.columns[1].take(pa.array(at)), b.columns[2].take(pa.array(at))], names=["key", "mask", "rep", "fp"])

    return run


def _to_pivots(radius: int, similarity: float):
    """Rows of large buckets -> which of the bucket's pivots they are linked to, as a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, _rep, fp, pivots, grams = (c.to_pylist() for c in b.columns)
            mask = np.zeros(len(key), dtype=np.int32)
            rows: dict[int, list[int]] = {}
            for j, k in enumerate(key):
                rows.setdefault(k, []).append(j)
            for at in rows.values():  # the rows of a bucket have the same pivots
                places = [i for i, p in enumerate(pivots[at[0]]) if p is not None]
                view = lambda fps: np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), -1)
                close = within(view([pivots[at[0]][i]["fp"] for i in places]), view([fp[j] for j in at]), radius)
                for i, found in zip(places, close, strict=True):
                    for j in (at[x] for x in np.flatnonzero(found)):
                        if alike(grams[j], pivots[j][i]["grams"], similarity):
                            mask[j] |= 1 << i
            ids = [[None if p is None else p["rep"] for p in x] for x in pivots]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(mask), pa.array(ids, type=pa.list_(pa.int64()))], names=["key", "rep", "mask", "pivots"])

    return run


def main_pivots(seen: list[tuple[int, int]]) -> int:
    """(mask, rows) of a bucket -> the pivots, as a mask, of the class that most rows belong to.

    Pivots are of one class where a row lies near both, directly or by a chain.
    """
    classes = [1 << i for i in range(PIVOTS)]
    for _ in range(PIVOTS):
        for mask, _n in seen:
            joined = sum({c for c in classes if c & mask}) if mask else 0
            classes = [joined if c & mask else c for c in classes]
    return max(sorted(set(classes)), key=lambda c: sum(n for mask, n in seen if mask & c))


def _large(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(key, n, rep, fp, grams) of large buckets of bands -> links, without comparing all their pairs.

    Rows near a pivot are linked to it. Those that reach the main class of pivots are connected already, so only pairs with
    a row outside it are compared, chunk by chunk; the result is that of all pairs.
    """
    part = F.pmod(F.xxhash64("rep"), F.lit(PIVOTS))
    pivots = rows.groupBy("key").agg(*(F.min_by(F.struct("rep", "fp", "grams"), F.when(part == i, F.col("rep"))).alias(f"p{i}") for i in range(PIVOTS)))
    have = [F.when(F.expr(f"pmod(xxhash64(p{i}.rep), {PIVOTS}) = {i}"), F.col(f"p{i}")) for i in range(PIVOTS)]
    pivots = materialize(pivots.select(F.col("key").alias("__key"), F.array(*have).alias("pivots")), "simhash-pivots")
    marked = rows.join(pivots, F.col("key") == F.col("__key")).select("key", "rep", "fp", "pivots", "grams")
    marked = materialize(marked.mapInArrow(_to_pivots(radius, similarity), "key long, rep long, mask int, pivots array<long>"), "simhash-marked")
    discard(pivots)
    near = marked.select(F.col("rep").alias("a"), F.explode(F.filter(F.transform("pivots", lambda p, i: F.when(F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0, p)), lambda p: p.isNotNull())).alias("b"))

    @F.pandas_udf("int")
    def main(seen: pd.Series) -> pd.Series:
        return pd.Series([main_pivots([(r["mask"], r["c"]) for r in x]) for x in seen], dtype="int32")

    masks = marked.groupBy("key", "mask").agg(F.count("*").alias("c")).groupBy("key").agg(F.collect_list(F.struct("mask", "c")).alias("seen"))  # 2^PIVOTS masks a key at most
    masks = masks.select(F.col("key").alias("__key"), main("seen").alias("main"), "seen")
    outside = F.aggregate("seen", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["mask"].bitwiseAND(F.col("main")) == 0, x["c"]).otherwise(0))
    masks = materialize(masks.withColumn("outside", outside).drop("seen").filter("outside > 0"), "simhash-masks")
    lone = marked.join(masks.select("__key", "main"), F.col("key") == F.col("__key")).filter(F.col("mask").bitwiseAND(F.col("main")) == 0).select(F.col("key").alias("__k"), F.col("rep").alias("__r"))
    left = rows.join(masks.drop("main"), F.col("key") == F.col("__key")).join(lone, (F.col("key") == F.col("__k")) & (F.col("rep") == F.col("__r")), "left")
    parts = lambda c: F.ceil(F.col(c) / MOST_ROWS).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(to(parts("outside")), lambda i: F.struct(i.alias("i"), spot(parts("n")).alias("j")))
    as_rest = F.when(F.col("__r").isNotNull(), F.transform(to(parts("n")), lambda j: F.struct(spot(parts("outside")).alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    unit = left.select("key", "rep", "fp", "grams", F.explode(F.array_union(as_member, as_rest)).alias("u")).select("key", "u.i", "u.j", "rep", "fp", "grams")
    units = unit.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(radius, similarity), "a long, b long")
    return near.union(units)


def _outright(rows: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """(key, rep, fp[, grams]) of small buckets -> links (a, b), all rows of a bucket compared."""
    own = [] if similarity is None else ["grams"]
    units = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "fp", *own)
    return units.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, similarity), "a long, b long")


def _buckets(keyed: DataFrame) -> DataFrame:
    """Keys that several rows have, as (__key, n); of keys with the same rows one stays, as the others would find the same links."""
    each = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("s")).filter("n > 1")
    return materialize(each.groupBy("n", "x", "s").agg(F.min("key").alias("__key")).select("__key", "n"), "simhash-buckets")


def links(reps: DataFrame, radius: int) -> DataFrame:
    """(rep, fp) of distinct fingerprints -> links (a, b) that connect what lies within the radius."""
    rows, out, mask = reps.select(F.lit(0).cast("long").alias("mask"), "rep", "fp"), None, 0
    while True:
        keyed = materialize(rows.mapInArrow(_block_keys(radius), "key long, mask long, rep long, fp binary"), "simhash-keys")
        shared, mask = _buckets(keyed), finer(mask, radius)[0]
        met = keyed.join(shared, F.col("key") == F.col("__key"))
        last = not finer(mask, radius)
        found = materialize(_outright(met if last else met.filter(F.col("n") <= CHUNK), radius), "simhash-links")
        out = found if out is None else out.union(found)
        large = shared.filter(F.col("n") > CHUNK)
        if last or large.isEmpty():
            return out
        rows = keyed.join(large, F.col("key") == F.col("__key"), "left_semi").select("mask", "rep", "fp")


def set_links(rows: DataFrame, reps: DataFrame, shingle: int, similarity: float, words: int) -> DataFrame:
    """(__row, text) and (rep, bands) of distinct sets -> links (a, b) that connect what has that similarity."""
    keyed = materialize(reps.select(F.explode("bands").alias("key"), "rep"), "simhash-keys")
    shared = _buckets(keyed)
    met = materialize(keyed.join(shared, F.col("key") == F.col("__key")).drop("__key"), "simhash-met")
    # only rows that share a key take their fingerprint and set along
    some = rows.join(met.select("rep").distinct().hint("merge"), F.col("__row") == F.col("rep"), "left_semi")
    own = materialize(sets(some, shingle, words), "simhash-sets")
    radius = radius_of(similarity, 64 * words)
    with_sets = lambda part: part.join(own.hint("merge"), F.col("rep") == F.col("__rep")).drop("__rep")
    out = materialize(_outright(with_sets(met.filter(F.col("n") <= CHUNK)), radius, similarity), "simhash-links")
    if not shared.filter(F.col("n") > CHUNK).isEmpty():
        large = materialize(with_sets(met.filter(F.col("n") > CHUNK)), "simhash-large")
        out = materialize(out.union(_large(large, radius, similarity)), "simhash-links")
        discard(large)
    discard(keyed, met, own)
    return out


def group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """documents -> (doc_id, fp, component_id).

    What is linked are fingerprints, each by itself a number; the name of a component is the least doc_id of all its rows.
    """
    fps = materialize(fingerprints(docs, shingle), "simhash-fps")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("rep", F.conv(F.hex("fp"), 16, -10).cast("long")), "simhash-reps")
    found = materialize(components(links(reps, radius)), "simhash-components")
    label = materialize(reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "rep").alias("component")), "simhash-labels")
    least = label.groupBy(F.col("component").alias("__component")).agg(F.min("first").alias("component_id"))
    named = materialize(label.join(least, F.col("component") == F.col("__component")).select(F.col("fp").alias("__fp"), "component_id"), "simhash-names")
    return fps.select("doc_id", "fp").join(named, F.col("fp") == F.col("__fp")).drop("__fp")


@functools.cache
def bit_differs(similarity: float, most: int = 64) -> float:
    """The greatest chance that two sets of that similarity or more differ in a fingerprint's bit.

    Large sets reach acos(2s / (1 + s)) / pi; in small ones the strict majority makes ties, so up to ``most`` common shingles
    the chance is taken outright.
    """
    heads = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in range(most + 1)]
    out = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for s in range(1, most + 1):
        extra = int(s / similarity + 1e-9) - s
        for a, b in ((a, b) for b in range(extra + 1) for a in range(min(b, extra - b) + 1) if a + b):
            one = lambda n, x: sum(heads[n][k] for k in range(n + 1) if 2 * (x + k) > s + n)
            p = ((heads[s][x], one(a, x), one(b, x)) for x in range(s + 1))
            out = max(out, sum(w * (y * (1 - z) + z * (1 - y)) for w, y, z in p))
    return out


def radius_of(similarity: float, bits: int) -> int:
    """Bits in which two sets of that Jaccard similarity or more differ at most, six standard deviations included."""
    p = bit_differs(similarity)
    return int(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, fingerprint, component_id: three-word shingles, two bits."""
    return group(docs.select("doc_id", "text")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@apart("doc_id", "text")
def keep(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 16) -> DataFrame:
    """One row of each group of near-duplicates, repeated rows and null ids included: that of the least doc_id, null last.

    Fingerprints of 1024 bits pick the pairs; links are those of the exact similarity.
    """
    rows = bucketed(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", "simhash-rows")  # joined three times
    keys = materialize(set_keys(rows, shingle), "simhash-same")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark"), F.col("__row").alias("row"))
    keys = keys.join(rows.select("__row", order.alias("first")).hint("merge"), F.col("row") == F.col("__row"))
    reps = materialize(keys.groupBy("same").agg(F.min("first").alias("first"), F.first("bands").alias("bands")).select("first", "bands", F.col("first.row").alias("rep")), "simhash-reps")
    found = materialize(components(set_links(rows.select("__row", "text"), reps, shingle, similarity, words)), "simhash-components")
    label = reps.select("first", "rep").join(found.hint("merge"), F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("component", "rep"))
    stay = materialize(label.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__stay")), "simhash-stay")
    return rows.join(stay.hint("merge"), F.col("__row") == F.col("__stay"), "left_semi").select(*docs.columns)  # rows grow with the corpus: never broadcast
