"""Corpus preparation (TXT1-8, TXT10-11): sentences, token counts, numbered
chunks, a built-in feature-hash embedder, context assembly.

Everything is a JVM expression over whole texts (split/regexp/transform), so
a long document is just a long row - no Python per row; hashed token counts are
an Arrow pass over whole batches.  The sentence rule is a regular expression
(end mark followed by whitespace); it differs from a trained sentence tokenizer
on abbreviations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank, prefix_sum, snapshot
from ragspark.operators.placement import maybe_broadcast

# Whitespace class and sentence rule shared with the oracle SQL.
WS = "[ \\t\\n\\r\\f]+"
WS_CHARS = " \t\n\r\f"
SENT_END = "([.!?])" + WS
MARK = "\u0001"


def split_sentences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """TXT1: (key, text) -> (key, pos, sentence); trimmed, blanks dropped."""
    marked = F.regexp_replace(F.col(text), SENT_END, "$1" + MARK)
    out = docs.select(key, F.posexplode(F.split(marked, MARK)).alias("pos", "sentence"))
    out = out.withColumn("sentence", F.trim(F.col("sentence"), F.lit(WS_CHARS)))
    return out.where(F.col("sentence") != "")


def tokens(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, WS), lambda x: x != "")


def token_count(col: str | Column) -> Column:
    """TXT2: whitespace token count."""
    return F.size(tokens(col))


def min_tokens(sentences: DataFrame, n: int = 4, col: str = "sentence") -> DataFrame:
    """TXT3: keep sentences with at least n tokens (the reference's > 2 then >= 4)."""
    return sentences.withColumn("tokens", token_count(col)).where(F.col("tokens") >= n)


def kept_sentences(min_tok: int = 4, text: str = "text") -> Column:
    """The sentences of a text with at least ``min_tok`` tokens, as an array of
    (pos, sentence, tokens)."""
    parts = F.split(F.regexp_replace(F.col(text), SENT_END, "$1" + MARK), MARK)
    cut = F.transform(parts, lambda s, i: F.struct(i.alias("pos"), F.trim(s, F.lit(WS_CHARS)).alias("sentence")))
    full = F.transform(F.filter(cut, lambda s: s["sentence"] != ""), lambda s: F.struct(
        s["pos"].alias("pos"), s["sentence"].alias("sentence"), token_count(s["sentence"]).alias("tokens")))
    return F.filter(full, lambda s: s["tokens"] >= min_tok)


def chunk(docs: DataFrame, min_tok: int = 4, key: str = "doc_id", ids: DataFrame | None = None) -> DataFrame:
    """TXT5: sentences with >= min_tok tokens numbered densely in (doc, position)
    order -> (chunk_id, chunk_key (12 digits), doc_id, pos, text).

    Only each document's number of sentences is ranked; a document then adds its
    first number to the positions in its own array, so no text is sorted.  Keys
    that are repeated or null have no place of their own: then the sentences
    themselves are ranked.

    With ``ids`` (chunk_id) only these chunks are returned.  All documents are counted
    and numbered still, but only those that hold one of them are cut once more,
    so neither the text of the others nor their sentences are stored or shuffled."""
    again = docs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) | F.col(key).isNull())
    if not again.isEmpty():
        r = global_rank(min_tokens(split_sentences(docs, key=key), min_tok), [key, "pos"], out="chunk_id")
    elif ids is None:
        kept = snapshot(docs.select(key, kept_sentences(min_tok).alias("_s")), "sentences")     # cut once
        r = _numbered(kept.join(_firsts(kept, key).select(key, "_first"), key), key)
    else:
        counts = snapshot(docs.select(key, F.size(kept_sentences(min_tok)).alias("_n")), "sentence-counts")
        held = snapshot(_holders(_firsts(counts, key), ids, key), "holders")
        # at most a document per id
        held = maybe_broadcast(held, held.count(), 64)
        r = _numbered(docs.join(held, key).select(key, "_first", kept_sentences(min_tok).alias("_s")), key)
    out = r.select("chunk_id", F.lpad(F.col("chunk_id").cast("string"), 12, "0").alias("chunk_key"),
                   key, "pos", F.col("sentence").alias("text"), "tokens")
    return out if ids is None else out.join(ids.select("chunk_id"), "chunk_id", "left_semi")


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    """(key, _first, _n): the number of a document's first sentence and how many it has (one at
    least), from its sentences ``_s`` or their number ``_n``."""
    n = F.col("_n") if "_n" in rows.columns else F.size("_s")
    return prefix_sum(rows.select(key, F.coalesce(n, F.lit(0)).cast("bigint").alias("_n")).where("_n > 0"),
                      [key], "_n", "_first", exclusive=True).select(key, "_first", "_n")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """(chunk_id, key, pos, sentence, tokens) of documents with their sentences and first number."""
    # each has a sentence; posexplode would filter on that, and so cut texts below the join that leaves most out
    return rows.select(key, "_first", F.posexplode_outer("_s").alias("_i", "_c")).select(
        (F.col("_first") + F.col("_i")).alias("chunk_id"), key, F.col("_c.pos").alias("pos"),
        F.col("_c.sentence").alias("sentence"), F.col("_c.tokens").alias("tokens"))


_SPAN = 1024        # chunk numbers of a span, by which numbers meet the documents


def _holders(firsts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, _first) of the documents that hold one of the chunks ``ids``."""
    span = lambda c: F.floor(c / _SPAN).cast("bigint")                             # noqa: E731
    docs = firsts.withColumn("_span", F.explode(F.sequence(span(F.col("_first")), span(F.col("_first") + F.col("_n") - 1))))
    wanted = ids.select("chunk_id", span(F.col("chunk_id")).alias("_span"))
    return docs.join(wanted, "_span").where("chunk_id >= _first and chunk_id < _first + _n").select(key, "_first").distinct()


def hash_bucket(token: bytes, dim: int, seed: str = "42") -> int:
    """The first 32 bits of md5("seed:token") modulo dim."""
    return int.from_bytes(hashlib.md5(seed.encode() + b":" + token, usedforsecurity=False).digest()[:4], "big") % dim


def hashed_counts(col: str | Column, dim: int = 64, seed: str = "42") -> Column:
    """Bag of hashed tokens as an array of dim counts (dim NULLs for NULL): one
    hash per distinct token of an Arrow batch, one count over all its tokens."""
    def count(words: pa.Array) -> pa.Array:
        flat = words.flatten().cast(pa.large_binary()).dictionary_encode()
        bucket = np.array([hash_bucket(w, dim, seed) for w in flat.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        at = row * dim + bucket[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else row
        counts = np.bincount(at, minlength=len(words) * dim).astype(np.int32)
        missing = np.repeat(words.is_null().to_numpy(zero_copy_only=False), dim) if words.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim, pa.int32()),
                                        pa.array(counts, pa.int32(), mask=missing))
    return F.arrow_udf(count, "array<int>")(tokens(col))


def embed(chunks: DataFrame, text: str = "text", dim: int = 64, make_predict_fn=None,
          batch_size: int = 128, seed: str = "42", element: str = "float") -> DataFrame:
    """TXT6: text -> embedding.  With ``make_predict_fn`` (a model loader in
    the ``predict_batch_udf`` convention) batches of ``batch_size`` texts go
    through the model on the executors; without one, a seeded feature-hash
    embedding (L2-normalised hashed token counts) is computed."""
    if make_predict_fn is not None:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql import types as T
        kind = T.ArrayType(T.DoubleType() if element == "double" else T.FloatType())
        udf = predict_batch_udf(make_predict_fn, return_type=kind, batch_size=batch_size)
        return chunks.withColumn("embedding", udf(F.col(text)))
    counts = hashed_counts(text, dim, seed)
    out = chunks.withColumn("_cnt", counts)
    norm = F.sqrt(F.aggregate("_cnt", F.lit(0.0).cast("double"), lambda a, c: a + c * c))
    return out.withColumn("embedding", F.transform("_cnt", lambda c: F.when(norm > 0, c / norm).otherwise(0.0)
                                                   .cast("float"))).drop("_cnt")


def fetch_docs(hits: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """TXT7: per query the texts of its top-k hits in rank order joined by a
    space; ids without a chunk are skipped.  Collects <= k rows per query."""
    h = hits if k is None else hits.where(F.col("rank") < k)
    j = h.select("qid", "rank", F.col("vec_id").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    g = j.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_s"),
                             F.count(F.lit(1)).alias("n_docs"))
    return g.select("qid", "n_docs", F.trim(F.array_join(F.col("_s.text"), " ")).alias("context"))


def query_lookup(qids: DataFrame, store: DataFrame) -> DataFrame:
    """TXT8: attach text to query ids; an id missing from the store fails the
    job (the reference raises KeyError)."""
    j = qids.join(store.select("qid", "text", F.lit(True).alias("_found")), "qid", "left")
    chk = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.lit("query id missing from store")))
    return j.where(chk).drop("_found")


def run_name(slo: Column, input_len: Column, output_len: Column, rate: Column, workers: Column,
             gpu_util: Column, nprobe: Column, dispatcher: Column) -> Column:
    """TXT10: S{slo}_I{in}_O{out}_R{rate}_N{workers}_U{util%}_P{nprobe}[_Dx];
    the rate prints as an integer when integral, else with two decimals."""
    r = F.when(rate == F.floor(rate), F.concat(F.lit("R"), F.floor(rate).cast("bigint").cast("string"))) \
        .otherwise(F.concat(F.lit("R"), F.format_string("%.2f", rate)))
    base = F.concat_ws("_", F.concat(F.lit("S"), slo.cast("string")), F.concat(F.lit("I"), input_len.cast("string")),
                       F.concat(F.lit("O"), output_len.cast("string")), r,
                       F.concat(F.lit("N"), workers.cast("string")),
                       F.concat(F.lit("U"), F.floor(gpu_util * F.lit(100)).cast("bigint").cast("string")),
                       F.concat(F.lit("P"), nprobe.cast("string")))
    return F.when(dispatcher, base).otherwise(F.concat(base, F.lit("_Dx")))


def parse_kv(lines: DataFrame, col: str = "line") -> DataFrame:
    """TXT9: 'k=v' -> (k, v_long, v_double, v_bool, v_list, v_str); one typed slot
    is filled (integers also fill v_double, as Python would coerce).  Booleans
    in any case; a list of numbers in brackets fills v_list."""
    kv = F.split(F.col(col), "=", 2)
    v = kv[1]
    is_int = v.rlike("^-?[0-9]+$")
    is_num = v.rlike("^-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$")
    is_bool = F.lower(v).isin("true", "false")
    is_list = v.rlike("^ *\\[[-+.eE0-9 ]+(,[-+.eE0-9 ]+)*\\] *$")
    items = F.split(F.regexp_replace(v, "[\\[\\] ]", ""), ",")
    return lines.select("*", F.trim(kv[0]).alias("k"), v.alias("_v")).select(
        *lines.columns, "k",
        F.when(is_int, v.cast("bigint")).alias("v_long"),
        F.when(is_num, v.cast("double")).alias("v_double"),
        F.when(is_bool, F.lower(v) == "true").alias("v_bool"),
        F.when(is_list, F.transform(items, lambda x: x.try_cast("double"))).alias("v_list"),
        F.when(~is_num & ~is_bool & ~is_list, v).alias("v_str"))
