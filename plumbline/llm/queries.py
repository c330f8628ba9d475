"""Queries of the corpus operators, and SQL for those that SQL can say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, codes, kernel, langid, licenses, mixing, negatives, ordermin, quality, simhash, suffixes, toxicity, warc
from plumbline.llm.common import read
from plumbline.llm.oracles import ORACLES  # noqa: F401


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # DataFrame functions only


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op9_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.report(read(spark, sf_dir, "documents"))


def op11_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(read(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op2_bpe, op7_mix, op8_quality, op10_simhash, op6_suffixes, op3_langid, op5_toxicity, op1_licenses, op4_warc, op9_ordermin, op11_kernel, op12_codes, op13_negatives)}
