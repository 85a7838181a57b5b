"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import bpe, langid, minhash, mixing, ordinal
from ragspark.llm.common import ready, table

MIX_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language near."""
    ready(spark)
    return langid.accept(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents unlikely to have the best grade (bad or toxic text)."""
    labels = table(spark, sf_dir, "labels")
    return ordinal.accept(docs, ordinal.fit(docs, labels, ordinal.grade_of()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates."""
    ready(spark)
    return minhash.keep_one(docs)


def mixing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 80 % of the tokens, shared over domains, languages and sources by weight."""
    ready(spark)
    return mixing.take(docs, mixing.domain_of(F.col("source")), mixing.target_weights(), MIX_SHARE)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text that is left; one row per document."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(docs, path))
