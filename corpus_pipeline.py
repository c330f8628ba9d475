"""From raw documents to token ids: five of the corpus operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it decides holds for the next one. All but the last
return the columns of ``documents``, and further columns of any name pass.

Rows, not ids, are documents: null and repeated doc_ids take part like any other. Null and empty texts, and texts of fewer
than ten words, fail the quality rules. Of repeated rows one stays, as of any copies; which one goes by doc_id, null last, then by a
hash of the text, and so does which passage is the first. Long texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, mixing, quality, simhash, suffixes
from plumbline.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's fences go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays: links of exact similarity, and their components."""
    return simhash.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has are cut out."""
    return suffixes.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the sources' target weights ask for."""
    return mixing.apply(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    shared = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode(docs.select("doc_id", "source", "text"), shared, decoded="decoded")
    return out.select("doc_id", "source", *bpe.digests(), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The sketches' fences, the fingerprints' links and BPE merges have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
