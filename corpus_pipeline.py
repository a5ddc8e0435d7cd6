"""The corpus pipeline: each stage calls one operator of ``featsearch.llm``.

Stages take and return the columns of ``documents`` (the last returns the
encoded result); each result is written as Parquet and read as the next docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featsearch.llm import exact_dedup, jaccard, mixing, quality
from featsearch.llm.common import stored, table
from featsearch.llm.queries import tokenized


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.accepted(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs, keep="largest")


def dedup_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the row with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return tokenized(spark, docs)


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", dedup_exact),
    ("ngram_jaccard", dedup_ngrams),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: Byte-level BPE has no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None
