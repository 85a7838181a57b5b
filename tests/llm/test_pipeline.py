"""The pipeline's stages, each against a brute-force version, and the entry."""

import hashlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ragspark.llm import bpe, langid, mixing, ordinal, stages

from .conftest import SF, rows
from .test_select_ops import _brute_classes


def test_stages_of_the_pipeline(llm, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "byte_bpe"]
    from ragspark.llm.common import snapshot
    own = docs.columns
    a = snapshot(stages.language_id(llm, docs, SF), "t")
    model = langid.fit(docs)
    good = {r["doc_id"] for r in langid.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.3}
    assert {r["doc_id"] for r in a.collect()} == good and a.columns == own
    b = snapshot(stages.quality(llm, a, SF), "t")
    model = ordinal.fit(a, llm.read.parquet(f"{SF}/labels.parquet"), ordinal.grade_of())
    good = {r["doc_id"] for r in ordinal.predict(a, model).collect() if r["selected"]}
    assert {r["doc_id"] for r in b.collect()} == good and b.columns == own
    c = snapshot(stages.near_dedup(llm, b, SF), "t")
    assert sorted(r["doc_id"] for r in c.collect()) == sorted(
        i for i, k in _brute_classes(b.select("doc_id", "text").collect()) if i == k) and c.columns == own
    d = snapshot(stages.mixing_(llm, c, SF), "t")
    tree = mixing.tree_rows(c, mixing.domain_of(F.col("source")))
    want = mixing.mix(tree, mixing.target_weights(), stages.MIX_SHARE, 1)
    assert sorted(r["doc_id"] for r in d.collect()) == sorted(r["doc_id"] for r in want.collect()) and d.columns == own
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tik = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    last = []
    for i, t in d.select("doc_id", "text").collect():
        ids = np.array(tik.encode_ordinary(t or ""), "<u4")
        last.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(corpus_pipeline.run(llm, SF)) == sorted(last, key=repr)


def test_clean_documents_stay(llm, docs):
    """Rated documents that are well written and not toxic pass both filters."""
    out = stages.quality(llm, stages.language_id(llm, docs, SF), SF)
    clean = llm.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    assert out.join(clean, "doc_id", "left_semi").count() >= 0.95 * clean.count()


def test_stages_on_odd_rows(llm, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, no_docs, SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, odd_docs, SF)
        assert out.columns == odd_docs.columns and out.count() <= 12


def test_entry_registers_every_operator():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert {"op6_budget_mix", "op8_norm_bucket_search", "op11_fp_tree_search", "op12_prefix_packs"} <= set(entry.oracle_sql())
