"""Registered queries of the search, sketch, scoring and mixing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.llm import fptree, grulm, minhash, mixing, normsearch, sketch
from ragspark.llm.common import table


def op7_gru_score(spark, sf_dir):
    """Base and recurrent-network log10 probability of every whole text."""
    return grulm.score(table(spark, sf_dir, "documents"))


def op8_norm_bucket_search(spark, sf_dir):
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return normsearch.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_bottom_k_fingerprint(spark, sf_dir):
    """Bottom-k fingerprints of every whole text and of its edited text."""
    return sketch.report(table(spark, sf_dir, "documents"))


def op11_fp_tree_search(spark, sf_dir):
    """The 20 highest-scoring documents of every benchmark item."""
    return fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_dart_minhash(spark, sf_dir):
    """Near-duplicate class of every document: five-word shingles, similarity 0.8."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_budget_mix(spark, sf_dir):
    """Documents and passes that the tree's token budgets take."""
    rows = mixing.tree_rows(table(spark, sf_dir, "documents"), mixing.domain_of(F.col("source")))
    return mixing.mix(rows, mixing.target_weights(), mixing.SHARE, mixing.MAX_EPOCHS, mixing.SEED)


Q = {"op1_dart_minhash": op1_dart_minhash,
     "op6_budget_mix": op6_budget_mix,
     "op7_gru_score": op7_gru_score,
     "op8_norm_bucket_search": op8_norm_bucket_search,
     "op10_bottom_k_fingerprint": op10_bottom_k_fingerprint,
     "op11_fp_tree_search": op11_fp_tree_search}
SQL: dict[str, str] = {"op6_budget_mix": mixing.SQL, "op8_norm_bucket_search": normsearch.SQL,
                       "op11_fp_tree_search": fptree.SQL}
