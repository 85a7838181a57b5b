"""Corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from ragspark.llm import stages
from ragspark.llm.common import ready, snapshot

STAGES = [
    ("language_id", stages.language_id),
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing_),
    ("byte_bpe", stages.byte_bpe),
]

#: The language, quality and signature stages have no SQL form; tests hold
#: each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole ``documents`` table; every stage's result is
    written as Parquet below ``spark.checkpoint.dir`` and read as the next one's input."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
