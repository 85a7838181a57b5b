"""Registered queries of the per-text operators: language, quality, tokens, pages."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from ragspark.llm import bpe, chatpack, htmltext, langid, ordinal, tokenfiles, wordruns
from ragspark.llm.common import held_out, table

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op2_ecoc_language(spark, sf_dir):
    """Language of every whole text by output codes learnt from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op3_ordinal_quality(spark, sf_dir):
    """Expected grade and probability of the best grade for every whole text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ordinal.predict(docs, ordinal.fit(docs, labels, ordinal.grade_of()))


def op4_token_files(spark, sf_dir):
    """Encode every whole text, write the token files, read them back."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_bpe_round_trip(spark, sf_dir):
    """Encode every whole text by the byte-level ranks, decode the ids, digest both."""
    path = public_tokenizers.path(BYTE_RANKS)
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.round_trip(docs, path))


def op9_block_tree_text(spark, sf_dir):
    """Main text of every whole page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op12_prefix_packs(spark, sf_dir):
    """Every conversation, and one that says control strings, formatted into prefix-shared packs and read back."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chatpack.round_trip(said.unionByName(extra), public_tokenizers.path(BYTE_RANKS))


def op13_word_runs(spark, sf_dir):
    """Periodic runs of every whole text, every tenth text with a periodic tail."""
    return wordruns.digests(wordruns.runs(table(spark, sf_dir, "documents"), change=wordruns.planted))


Q = {"op2_ecoc_language": op2_ecoc_language, "op3_ordinal_quality": op3_ordinal_quality,
     "op4_token_files": op4_token_files,
     "op5_bpe_round_trip": op5_bpe_round_trip, "op9_block_tree_text": op9_block_tree_text,
     "op12_prefix_packs": op12_prefix_packs, "op13_word_runs": op13_word_runs}
SQL: dict[str, str] = {"op12_prefix_packs": chatpack.SQL}
