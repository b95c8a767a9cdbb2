"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Rejected are documents without letters or of no language with some confidence, documents of low quality, and all but
one document of each group of near duplicates; personal data are replaced; the rest is packed. Rows without doc_id can't
be told apart by id and are never taken for duplicates; a document that is repeated with its id stays once. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, ngramjoin, packing, pii, quality
from millrace.llm.common import prepare, read, stored

#: Least probability of the language predicted, and least quality, of a document that stays.
LEAST_LANGUAGE, LEAST_QUALITY = 0.3, 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned."""
    prepare(spark)
    said = langid.predict(docs, langid.train(docs), keep=docs.columns, names=("__lang", "__score"))
    return said.filter((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE)).drop("__lang", "__score")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of enough quality."""
    prepare(spark)
    judged = quality.judge(docs, keep=docs.columns, names=("__votes", "__posterior", "__quality"))
    return judged.filter(F.col("__quality") >= LEAST_QUALITY).drop("__votes", "__posterior", "__quality")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    prepare(spark)
    named = stored(ngramjoin.near_duplicates(docs.select("doc_id", "text")), "named")
    others = stored(named.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "others")
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    repeated = stored(named.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once)


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    prepare(spark)
    return pii.replace(docs, pii.key_of(spark), count=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, lambda: packing.ChunkTokens(path, eos=1), capacity=2048)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("pii", anonymous), ("packing", packed)]
#: No stage is an SQL expression; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
