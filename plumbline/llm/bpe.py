"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the whole vocabulary (hash and displace: n keys, n slots, one displacement per
bucket of four keys): a pre-token that is itself a vocabulary entry costs one hash and one comparison. Tier two takes the
misses: the bytes of the pre-token form a linked list, a heap holds the adjacent pairs that the vocabulary knows by rank,
and the lowest rank merges first, leftmost on ties, as the public tokenizers do. A bounded memo stands before both.

Texts: null is the empty text; empty texts give no ids; a text of any length is handled whole, pre-token by pre-token;
repeated rows are encoded each by itself; ties of rank are merged leftmost; an empty table gives an empty result; other columns
pass through, and the result columns replace columns of the same name. The job is a narrow map: no shuffle, and the broadcast is the vocabulary file (under a few MB by construction).
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import text_batches

MASK = (1 << 64) - 1
#: Pre-tokens that a worker's memo holds before it starts anew, and the characters of the longest one that it keeps.
MEMO, KEPT = 1_000_000, 64


def _place(h: int, d: int, n: int) -> int:
    """Slot of a hash under displacement d."""
    return ((((h ^ (d * 0x9E3779B97F4A7C15)) & MASK) * 0xD6E8FEB86659FD93 & MASK) >> 32) % n


class PerfectHash:
    """Minimal perfect hash from byte strings to slots 0..n-1."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        for seed in range(64):
            if self._build(keys, seed):
                return
        raise ValueError("keys must be distinct")

    def _build(self, keys: list[bytes], seed: int) -> bool:
        self.seed, n = seed, self.n
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k, seed)
            groups[h % self.buckets].append((h, k))
        self.shift, self.keys = [0] * self.buckets, [b""] * n
        full = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = 0
        for b in order:
            group = groups[b]
            if len(group) > 1:
                for d in range(1, 1 << 16):
                    slots = {_place(h, d, n) for h, _ in group}
                    if len(slots) == len(group) and not any(full[s] for s in slots):
                        break
                else:
                    return False
                self.shift[b] = d
                for h, k in group:
                    full[s := _place(h, d, n)] = 1
                    self.keys[s] = k
            elif group:  # a bucket of one names its slot outright
                while full[free]:
                    free += 1
                self.shift[b], self.keys[free], full[free] = -free - 1, group[0][1], 1
        return True

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else _place(h, d, self.n) if d else -1
        return s if s >= 0 and self.keys[s] == key else -1


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token outside the vocabulary: heap of pairs over a linked list of its bytes."""
    n, rank = len(token), ranks.get
    follow, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [r * n + i for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if not (j := follow[i]) or j >= n or rank(token[i : (end := follow[j])]) != r:
            continue  # one of the two has merged with another since
        follow[i], follow[j], before[end] = end, 0, i  # 0: no longer the start of a piece
        if end < n and (r := rank(token[i : follow[end]])) is not None:
            heapq.heappush(heap, r * n + i)
        if i and (r := rank(token[before[i] : end])) is not None:
            heapq.heappush(heap, r * n + before[i])
    out, i = [], 0
    while i < n:
        end = follow[i]
        out.append(ranks[token[i:end]])
        i = end
    return out


class Memo(dict):
    """pre-token -> its ids as packed 32-bit integers; what is missing goes through the two tiers."""

    def __init__(self, tables: Vocabulary):
        self.t = tables

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        s = self.t.hash.slot(raw)
        got = array("i", [self.t.ids[s]] if s >= 0 else merge(raw, self.t.ranks)).tobytes()
        if len(token) <= KEPT:
            if len(self) >= MEMO:
                self.clear()
            self[token] = got
        return got


class Vocabulary:
    """Ranks, the perfect hash over them, and the bytes of every id."""

    def __init__(self, data: bytes, pattern: str, hash: PerfectHash | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.hash = hash or PerfectHash(list(self.ranks))
        self.ids = [self.ranks[k] for k in self.hash.keys]
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memo = Memo(self)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_loaded: dict[int, Vocabulary] = {}


def _tables(shared) -> Vocabulary:
    """One per Python worker and broadcast."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Vocabulary(*shared.value)
    return _loaded[shared.id]


class Shared:
    """A broadcast and a name for it among a worker's tables."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def load(spark: SparkSession, path: str, pattern: str) -> Shared:
    """Read a rank file, build its perfect hash and broadcast both: their size is that of a vocabulary, not of a corpus."""
    with open(path, "rb") as f:
        data = f.read()
    return Shared(spark.sparkContext.broadcast((data, pattern, Vocabulary(data, pattern).hash)))


def _map(df: DataFrame, source: str, columns: list[T.StructField], one) -> DataFrame:
    """``df`` with ``columns`` added, or put in the place of those of their names, by a function from Arrow array to Arrow arrays."""
    new = {c.name for c in columns}
    keep = [f for f in df.schema if f.name not in new]
    schema = T.StructType([*keep, *columns])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *one(b.columns[-1])], names=names)

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.expr(source).alias("__in")).mapInArrow(run, schema)


def encode(df: DataFrame, shared: Shared, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of its text as ``array<int>``; special tokens are ordinary text.

    ``decoded`` names a column for what the ids decode to, made in the same pass.
    """
    text_batches(df.sparkSession)

    def one(texts: pa.Array) -> list[pa.Array]:
        v = _tables(shared)
        packed = [v.encode(t.decode("utf-8", "replace")) for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
        out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))]
        if decoded:
            out.append(pa.array([v.decode(array("i", x)) for x in packed], type=pa.binary()))
        return out

    columns = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return _map(df, f"coalesce(cast(`{text}` as binary), X'')", columns, one)


def decode(df: DataFrame, shared: Shared, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for; null ids give empty bytes."""
    text_batches(df.sparkSession)

    def one(lists: pa.Array) -> list[pa.Array]:
        v = _tables(shared)
        return [pa.array([v.decode(x) for x in lists.to_pylist()], type=pa.binary())]

    return _map(df, f"coalesce(`{ids}`, cast(array() as array<int>))", [T.StructField(out, T.BinaryType())], one)


def digests(ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents -> doc_id and the digests of the ids and of what they decode to."""
    shared = load(docs.sparkSession, path, pattern)
    out = encode(docs.select("doc_id", "text"), shared, decoded="decoded")
    return out.select("doc_id", *digests())
