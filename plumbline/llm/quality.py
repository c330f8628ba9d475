"""Quality rules with thresholds that adapt to language and source.

Every document gets five counts and, from them, four rates. A mergeable quantile sketch of each rate, and of the numbers of
words and characters, is kept per language and source: logarithmic bins (as in DDSketch), so the sketch is a small table of
bin counts, merges by addition, does not depend on the order of the rows, and answers quantiles within a stated relative
error. The upper fence of a group is q75 + spread * max(q75 - q50, unit), where the unit is what the least event makes of the
rate in the group's median document: one symbol, one repeated line, one window of five words that occurs twice, a tenth of
the median word length. It follows the group's own distribution where a fixed cutoff would not, and no label has a part in
it. Groups of fewer than ``min_docs`` documents take the sketch of their language, and languages that small the sketch of all
documents; both are sums of the finer sketches. Documents are then joined to the fences of their group and filtered; a rate
equal to its fence passes.

Texts: null is the empty text (all counts 0); null lang or source is a group of its own; repeated rows count and appear
each time; an empty table gives an empty result; long texts are read whole; columns of the input pass through, and columns
that the operator adds replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import SPACE, apart, as_bytes, materialize, text_batches, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
#: rate -> (SQL over the counts, SQL over the medians of a group: the unit of its fence)
RATES = {
    "symbol_rate": ("n_symbols / word_chars", "1 / q50_word_chars"),
    "repeat_rate": ("n_repeat_words / n_words", "10 / q50_n_words"),
    "dup_line_rate": ("n_dup_lines / n_words", "1 / q50_n_words"),
    "word_length": ("word_chars / n_words", "0.1 * q50_word_length"),
}
SKETCHED = (*RATES, "n_words", "word_chars")
#: Bins grow by this factor: a quantile is right within about 2.5 %.
GAMMA, LEAST = 1.05, 1e-6
SPREAD, MIN_DOCS = 6.0, 50


def count_words(data: bytes) -> tuple[int, int, int, int, int]:
    """The counts of one text, in the order of COUNTS."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    chars = int(np.count_nonzero(~space & ((raw & 0xC0) != 0x80)))
    hashes, starts, _ = word_hashes(data)
    n, repeat = len(hashes), 0
    if n > 5:
        ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]  # ranks of windows of 2, 4 and 5 words, without hashing
        four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
        _, place, seen = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
        again = seen[place] > 1
        if again.any():
            cover = np.zeros(n + 1, dtype=np.int64)
            cover[: n - 4] += again
            cover[5:] -= again[: n - 4]
            repeat = int(np.count_nonzero(np.cumsum(cover)[:n]))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return n, chars, int(SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeat


def count(docs: DataFrame, text: str = "text", whole: bool = True) -> DataFrame:
    """``docs`` with the five counts of their text, and the text itself untouched; not ``whole``: without the text."""
    text_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name not in COUNTS and (whole or f.name != text)]
    schema = T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([count_words(x) for x in b.columns[-1].to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(got[:, i]) for i in range(len(COUNTS)))], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), as_bytes(f"`{text}`").alias("__in")).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates(counted: DataFrame) -> DataFrame:
    return counted.withColumns({k: F.expr(f"coalesce(try_divide(cast({sql.split(' / ')[0]} as double), cast({sql.split(' / ')[1]} as double)), 0d)") for k, (sql, _) in RATES.items()})


def _bin(x):
    return F.when(x < LEAST, 0).otherwise(F.ceil(F.ln(x / LEAST) / float(np.log(GAMMA)))).cast("int")


def _value(b):
    """Middle of a bin."""
    return F.when(b == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), b - 0.5))


def sketch(rated: DataFrame) -> DataFrame:
    """Bin counts by language and source: (lang, source, rate, bin, n)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), _bin(F.col(k)).alias("bin")) for k in SKETCHED))).alias("r")
    return rated.select("lang", "source", each).groupBy("lang", "source", "r.rate", "r.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Coarser sketches: those of equal ``keys`` added up."""
    return sketches.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: docs, and q50 and q75 of everything sketched."""
    upto = Window.partitionBy(*keys, "rate").orderBy("bin")
    whole = Window.partitionBy(*keys, "rate")
    ranked = sketches.select(*keys, "rate", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("docs"))
    quantile = lambda k, q: F.min(F.when((F.col("rate") == k) & (F.col("upto") >= q * F.col("docs")), _value(F.col("bin"))))
    return ranked.groupBy(*keys).agg(F.max("docs").alias("docs"), *(quantile(k, q).alias(f"q{round(100 * q)}_{k}") for k in SKETCHED for q in (0.5, 0.75)))


def fence(rate: str, spread: float):
    """Upper fence of a rate over the quartiles of a group."""
    return F.expr(f"q75_{rate} + {spread}d * greatest(q75_{rate} - q50_{rate}, {RATES[rate][1]})")


def thresholds(rated: DataFrame, spread: float = SPREAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences of every (lang, source) that occurs, small groups by their language or by all documents."""
    fine = materialize(sketch(rated), "quality-sketch")
    names = [f"{q}_{k}" for k in SKETCHED for q in ("q50", "q75")]
    as_ = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    own, lang, every = quartiles(fine, ["lang", "source"]), as_(quartiles(merge(fine, "lang"), ["lang"]), "l"), as_(quartiles(merge(fine), []), "a")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every))  # one row
    pick = lambda c: F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("l_docs") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    picked = joined.select("lang", "source", *(pick(c).alias(c) for c in names))
    return materialize(picked.select("lang", "source", *(fence(k, spread).alias(f"max_{k}") for k in RATES)), "quality-fences")


def judge(docs: DataFrame, spread: float = SPREAD, min_docs: int = MIN_DOCS, whole: bool = True) -> DataFrame:
    """``docs`` with counts, rates, base_failed and kept; not ``whole``: without their text."""
    for c, kind in (("lang", "string"), ("source", "string")):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    rated = rates(materialize(count(docs, whole=whole), "quality-counts")).withColumn("base_failed", base_failed())
    limits = thresholds(rated.filter("not base_failed"), spread, min_docs)
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(f"max_{k}").alias(f"__max_{k}") for k in RATES))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    fits = F.lit(True)
    for k in RATES:
        fits = fits & (F.col(k) <= F.coalesce(F.col(f"__max_{k}"), F.lit(float("inf"))))
    return joined.withColumn("kept", ~F.col("base_failed") & fits).drop("__lang", "__source", *(f"__max_{k}" for k in RATES))


@apart("doc_id", "text", "lang", "source")
def keep(docs: DataFrame, **params) -> DataFrame:
    """The documents that pass, with their own columns, whatever names these have."""
    return judge(docs, **params).filter("kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the counts, base_failed and kept."""
    out = judge(docs.select("doc_id", "text", "lang", "source"), whole=False)
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
