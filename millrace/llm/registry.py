"""Queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ann, bpe, langid, media, ngramjoin, packing, pii, quality, warc, webtext
from millrace.llm.common import prepare, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(read(spark, sf_dir, "documents"), pcm_rate=16000))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(read(spark, sf_dir, "pages")))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(read(spark, sf_dir, "documents"), lambda: packing.ChunkTokens(path, eos=1), capacity=2048)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(read(spark, sf_dir, "documents"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(read(spark, sf_dir, "pages"))
