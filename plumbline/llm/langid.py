"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier a bit tells the languages with 1 from those with 0 by the byte
n-grams of the lower-cased text, hashed into ``2^16`` buckets (log-odds of smoothed counts, languages weighted alike). A
text's margins are compared with all codewords under the logistic loss, and the nearest wins; the score is its share of
the weight exp(-loss), and a text whose runner-up is close is flagged ambiguous. Up to seven languages get the exhaustive
code, more get seeded random codewords.

Training counts n-grams over a bounded sample of labelled rows (``per_language`` each at most, a parameter), drawn by a hash of
id and text, so that null and repeated ids are drawn like any other; the model is languages x buckets and so independent
of the corpus. Prediction is one narrow pass over every whole text.

Null texts and texts without a letter are ``und`` with score 0; with no language to learn from, all are. Texts of any
length are read whole, in pieces; repeated rows train and are predicted each by itself; equal losses go to the language that
comes first by name, and make the text ambiguous; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import as_bytes, text_batches

BITS, SIZES = 16, (2, 3)
PER_LANGUAGE, TASKS = 4000, 8
#: n-grams after which a longer text makes the margins no surer, and the factor from mean log-odds to margin.
SURE, SCALE = 200, 0.25
_LETTER = regex.compile(r"\p{L}")


def crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null has 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def grams(data: bytes, bits: int = BITS) -> np.ndarray:
    """Buckets of the byte n-grams of a text, set off by blanks."""
    x = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            g = x[: len(x) - n + 1].copy()
            for j in range(1, n):
                g = (g << np.uint64(8)) | x[j : len(x) - n + 1 + j]
            out.append(((g + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def _lower(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").lower().encode()


def codebook(languages: int, seed: int = 3) -> np.ndarray:
    """languages x bits of -1 and 1."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=languages) if c[0] == 1 and -1 in c]
        return np.array(columns).T
    rng = np.random.default_rng(seed)
    while True:
        code = rng.choice((-1, 1), size=(languages, 10 * int(np.ceil(np.log2(languages)))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        if len(np.unique(code, axis=0)) == languages:
            return code


def sample(rows: DataFrame, label: str, per_label: int, *by: str) -> DataFrame:
    """``per_label`` rows of each label, or all it has: those of the least hash of the columns ``by``, and never more.

    A share of the rows, a quarter more than needed, is drawn by the hash in the scan and only those are ranked; where many
    rows are alike (one id, one text) they draw together, and the rank still bounds what is kept.
    """
    have = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a label
    if all(n <= per_label for n in have.values()):
        return rows
    limit = F.lit(0)
    for k, n in have.items():
        limit = F.when(F.col(label) == F.lit(k), F.lit(int(min(1.0, 1.25 * (per_label + 64) / n) * 1_000_000))).otherwise(limit)
    draw = F.xxhash64(*by, F.lit(11))
    drawn = rows.withColumn("__draw", draw).filter(F.pmod("__draw", F.lit(1_000_000)) < limit)
    first = Window.partitionBy(label).orderBy(F.pmod("__draw", F.lit(1_000_000)), "__draw", *by)
    return drawn.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= per_label).drop("__draw", "__rank")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got = grams(_lower(t))
            if lang not in total:
                total[lang] = np.zeros(1 << BITS, dtype=np.int64)
            if len(got) > 4096:
                total[lang] += np.bincount(got, minlength=1 << BITS)
            else:
                np.add.at(total[lang], got, 1)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labelled (doc_id, text, lang) -> languages, codebook, weights (buckets x bits)."""
    text_batches(docs.sparkSession)
    chosen = sample(docs.filter("text is not null and lang is not null"), "lang", per_language, "doc_id", "text").select("lang", as_bytes().alias("t"))
    counts = chosen.repartition(TASKS).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets
    languages = sorted(rows["lang"].unique())
    n = np.full((len(languages), 1 << BITS), 0.5)
    n[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] += rows["n"].to_numpy()
    p = n / n.sum(axis=1, keepdims=True) if len(languages) else n
    code = codebook(len(languages))
    weights = [np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) if (c < 0).any() else np.zeros(1 << BITS) for c in code.T] if len(languages) else []
    return languages, code, np.array(weights, dtype=np.float32).T.copy()


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, ambiguous."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, code, weights = shared.value
        for b in batches:
            out = []
            for t in b.columns[1].to_pylist():
                text = t.decode("utf-8", "replace")
                if not languages or not _LETTER.search(text):
                    out.append(("und", 0.0, False))
                    continue
                got, total = grams(text.lower().encode()), 0
                for a in range(0, len(got), 1 << 16):
                    total = total + weights[got[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
                margin = total / len(got) * min(len(got), SURE) * SCALE
                loss = np.logaddexp(0, -code * margin).sum(axis=1)
                share = np.exp(loss.min() - loss)
                share /= share.sum()
                best = int(share.argmax())
                out.append((languages[best], float(share[best]), bool(len(share) > 1 and np.sort(share)[-2] > share[best] / 4)))
            yield pa.RecordBatch.from_arrays([b.columns[0], *(pa.array([x[i] for x in out], type=k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes().alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, ambiguous; learnt from the documents that are not held out."""
    model = train(docs.select("doc_id", "text", "lang").filter(crc() % 4 != 2))
    return predict(docs, model).select("doc_id", (crc() % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
