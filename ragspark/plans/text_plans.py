r"""Registered text (TXT*) and sampling (SMP*) queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import sampling as smp
from ragspark.operators import text as tx
from ragspark.operators import vector as V
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp

Q: dict = {}
SQL: dict = {}

WORKERS = 4
DIM = 64
# Fixture: malformed article lines appended to the JSON-lines view of
# ``documents`` (ids below zero).
BAD_LINES = [
    (-1, '{"text": "unterminated'),
    (-2, "not json at all"),
    (-3, '{"other": 1}'),
    (-4, '{"text": ""}'),
    (-5, '{"text": "   "}'),
    (-6, '{"text": "A valid extra article. It has enough words here!"}'),
]


def _reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round_to(c, digits))
    return df


_WS = r"[ \t\n\r\f]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
SENT = rf"""sent0 AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_WS}', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
sent1 AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM sent0),
sent AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(s, {_TRIM}) AS sentence FROM sent1 WHERE trim(s, {_TRIM}) <> ''),
tok AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(sentence, '{_WS}'), lambda x: x <> '')) AS INTEGER) AS tokens FROM sent),
chunks AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS BIGINT) AS chunk_id, doc_id, pos, sentence AS text, tokens
  FROM tok WHERE tokens >= 4)"""


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "text")


@_reg("txt_sentences", f"WITH {SENT} SELECT doc_id, pos, sentence FROM sent")
def txt_sentences(spark, sf):
    """Every document split into trimmed sentences (end mark + whitespace)."""
    return tx.split_sentences(_docs(spark, sf))


@_reg("txt_token_count", f"WITH {SENT} SELECT doc_id, pos, tokens FROM tok")
def txt_token_count(spark, sf):
    """Whitespace token count of every sentence."""
    s = tx.split_sentences(_docs(spark, sf))
    return s.select("doc_id", "pos", tx.token_count("sentence").alias("tokens"))


@_reg("txt_min_tokens", f"WITH {SENT} SELECT doc_id, pos, tokens FROM tok WHERE tokens >= 4")
def txt_min_tokens(spark, sf):
    """Sentences with at least 4 tokens."""
    return tx.min_tokens(tx.split_sentences(_docs(spark, sf))).select("doc_id", "pos", "tokens")


def _article_lines(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("line_id"),
                                                    F.to_json(F.struct("text")).alias("line"))
    bad = spark.createDataFrame(BAD_LINES, "line_id bigint, line string")
    return docs.unionByName(bad)


def _bad_sql():
    return "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in BAD_LINES) + ") AS b(line_id, line)"


_LINES_SQL = f"""lines AS (SELECT doc_id AS line_id, CAST(to_json({{'text': text}}) AS VARCHAR) AS line FROM documents
  UNION ALL SELECT CAST(line_id AS BIGINT), line FROM {_bad_sql()}),
parsed AS (SELECT line_id, line, json_valid(line) AS ok,
  json_extract_string(CASE WHEN json_valid(line) THEN line ELSE '{{}}' END, '$.text') AS text FROM lines),
status AS (SELECT line_id, text, CASE WHEN NOT ok THEN 'corrupt'
  WHEN text IS NULL OR trim(text, {_TRIM}) = '' THEN 'blank' ELSE 'ok' END AS status FROM parsed)"""


def _parse_articles(spark, sf):
    lines = _article_lines(spark, sf)
    p = lines.select("line_id", F.from_json("line", "text string, _corrupt_record string",
                                            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
                     .alias("j"))
    status = (F.when(F.col("j._corrupt_record").isNotNull(), F.lit("corrupt"))
              .when(F.col("j.text").isNull() | (F.trim(F.col("j.text"), F.lit(tx.WS_CHARS)) == ""), F.lit("blank"))
              .otherwise(F.lit("ok")))
    return p.select("line_id", F.col("j.text").alias("text"), status.alias("status"))


@_reg("txt_safe_parse", f"""WITH {_LINES_SQL}
SELECT status, count(*) AS n, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN length(text) END), 0) AS BIGINT) AS chars
FROM status GROUP BY status""")
def txt_safe_parse(spark, sf):
    """JSON-lines articles parsed PERMISSIVE: malformed lines are counted as
    corrupt (not silently lost), empty texts as blank."""
    s = _parse_articles(spark, sf)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(
        F.sum(F.when(F.col("status") == "ok", F.length("text"))), F.lit(0)).cast("bigint").alias("chars"))


@_reg("src_articles", f"""WITH {_LINES_SQL} SELECT line_id, text FROM status WHERE status = 'ok'""")
def src_articles(spark, sf):
    """SRC6: JSON lines -> the text of every well-formed, non-blank line."""
    return _parse_articles(spark, sf).where(F.col("status") == "ok").select("line_id", "text")


@_reg("txt_chunk_ids", f"WITH {SENT} SELECT chunk_id, lpad(CAST(chunk_id AS VARCHAR), 12, '0') AS chunk_key, doc_id, pos FROM chunks")
def txt_chunk_ids(spark, sf):
    """Dense 0-based chunk numbers over all kept sentences, 12-digit keys."""
    return tx.chunk(_docs(spark, sf)).select("chunk_id", "chunk_key", "doc_id", "pos")


@_reg("txt_embed", rf"""WITH {SENT}, b AS (
  SELECT chunk_id, list_transform(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''),
    lambda t: ('0x' || substr(md5('42:' || t), 1, 8))::BIGINT % {DIM}) AS bk FROM chunks),
c AS (SELECT chunk_id, list_transform(range({DIM}), lambda i: len(list_filter(bk, lambda x: x = i))) AS cnt FROM b)
SELECT chunk_id, array_to_string(cnt, ',') AS counts, CAST(list_sum(list_transform(cnt, lambda x: x * x)) AS BIGINT) AS norm2 FROM c""")
def txt_embed(spark, sf):
    """Built-in embedder: hashed token counts per chunk (the embedding is the
    L2-normalised vector; counts are compared exactly)."""
    ch = tx.chunk(_docs(spark, sf))
    cnt = tx.hashed_counts("text", DIM)
    out = ch.select("chunk_id", cnt.alias("_c"))
    return out.select("chunk_id", F.array_join(F.transform("_c", lambda x: x.cast("string")), ",").alias("counts"),
                      F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, x: a + x * x).alias("norm2"))


# Fixed values of the small model below: buckets, dimensions and the weight formula.
_BUCKETS, _DIMS, _W = 4096, 8, "(({b} * 2654435 + {j} * 40503) % 2003 - 1001)"


def _projection_model():
    """Loads a model once per worker: token buckets times a fixed weight table,
    summed per text and scaled to unit length."""
    import hashlib

    import numpy as np
    b, j = np.arange(_BUCKETS)[:, None], np.arange(_DIMS)[None, :]
    weights = (b * 2654435 + j * 40503) % 2003 - 1001

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), _DIMS))
        for i, t in enumerate(texts):
            words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w]
            at = [int(hashlib.md5(b"42:" + w.encode()).hexdigest()[:8], 16) % _BUCKETS for w in words]
            out[i] = weights[at].sum(axis=0) if at else 0
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    return predict


@_reg("txt_embed_model", rf"""WITH {SENT}, b AS (
  SELECT chunk_id, unnest(list_transform(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''),
    lambda t: ('0x' || substr(md5('42:' || t), 1, 8))::BIGINT % {_BUCKETS})) AS b FROM chunks),
s AS (SELECT chunk_id, {', '.join(f"CAST(sum({_W.format(b='b', j=j)}) AS DOUBLE) AS s{j}" for j in range(_DIMS))} FROM b GROUP BY chunk_id),
l AS (SELECT *, sqrt({' + '.join(f's{j} * s{j}' for j in range(_DIMS))}) AS norm FROM s)
SELECT chunk_id, {', '.join(f'round(CASE WHEN norm > 0 THEN s{j} / norm ELSE 0 END, 6) AS e{j}' for j in range(_DIMS))} FROM l""")
def txt_embed_model(spark, sf):
    """TXT6: every chunk through a model that each Python worker loads once
    (``predict_batch_udf``), batches of 128 texts."""
    ch = tx.chunk(_docs(spark, sf)).select("chunk_id", "text")
    out = tx.embed(ch, make_predict_fn=_projection_model, element="double")
    return out.select("chunk_id", *[round_to(F.col("embedding")[j], 6).alias(f"e{j}") for j in range(_DIMS)])


@_reg("txt_fetch_docs", f"""WITH {SENT}, knn AS (
  SELECT qid, rn - 1 AS rank, vec_id FROM (
    SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rn
    FROM (SELECT q.vec_id AS qid, v.vec_id, {sp.l2('q.embedding', 'v.embedding')} AS dist FROM embeddings q, embeddings v) x) y
  WHERE rn <= {fx.TOPK})
SELECT k.qid, count(*) AS n_docs, trim(string_agg(c.text, ' ' ORDER BY k.rank)) AS context
FROM knn k JOIN chunks c ON c.chunk_id = k.vec_id GROUP BY k.qid""")
def txt_fetch_docs(spark, sf):
    """Context of each query: texts of its exact top-10 hits (vector id =
    chunk number) in rank order; ids with no chunk are skipped."""
    hits = V.exact_knn(fx.vectors(spark, sf), fx.queries(spark, sf), fx.TOPK)
    return tx.fetch_docs(hits, tx.chunk(_docs(spark, sf)))


_PERM_SQL = "CAST(row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || CAST({c} AS VARCHAR)), 1, 8))::BIGINT, {c}) - 1 AS BIGINT)"


@_reg("txt_query_lookup", f"""SELECT {_PERM_SQL.format(c='item_id')} AS perm_rank, item_id AS qid, text FROM benchmark""")
def txt_query_lookup(spark, sf):
    """Shuffled benchmark query ids with their text attached (missing id = error)."""
    b = fx.table(spark, sf, "benchmark")
    perm = smp.permute(b.select(F.col("item_id").alias("qid")), "qid")
    return tx.query_lookup(perm, b.select(F.col("item_id").alias("qid"), "text")).select("perm_rank", "qid", "text")


_KV_SQL = f"""WITH {sp.stages_cte()}, runs AS (SELECT DISTINCT mode, rate, ngpu, dispatcher FROM st),
kv AS (SELECT mode, rate, ngpu, dispatcher, unnest([
  'mode=' || mode, 'rate=' || CAST(rate AS VARCHAR), 'ngpu=' || CAST(ngpu AS VARCHAR),
  'dispatcher=' || CASE WHEN dispatcher THEN 'True' ELSE 'false' END, 'gpu_util=0.95', 'tag=main',
  'lengths=[1024, 256]']) AS line FROM runs),
p AS (SELECT *, trim(split_part(line, '=', 1)) AS k, substr(line, strpos(line, '=') + 1) AS v FROM kv)
SELECT mode, rate, ngpu, dispatcher, k,
  CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN CAST(v AS BIGINT) END AS v_long,
  CASE WHEN regexp_full_match(v, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?') THEN CAST(v AS DOUBLE) END AS v_double,
  CASE WHEN lower(v) IN ('true', 'false') THEN lower(v) = 'true' END AS v_bool,
  CASE WHEN v LIKE '[%]' THEN len(string_split(v, ',')) END AS list_items,
  CASE WHEN v LIKE '[%]' THEN list_sum(list_transform(string_split(regexp_replace(v, '[^0-9,]', '', 'g'), ','), lambda x: CAST(x AS DOUBLE))) END AS list_total,
  CASE WHEN NOT regexp_full_match(v, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?') AND lower(v) NOT IN ('true', 'false') AND v NOT LIKE '[%]' THEN v END AS v_str
FROM p"""


@_reg("txt_parse_kv", _KV_SQL)
def txt_parse_kv(spark, sf):
    """Run headers 'k=v' (as written in a summary file) parsed to typed values."""
    req = fx.requests(spark, sf)
    runs = req.select("mode", "rate", "ngpu", "dispatcher").distinct()
    lines = runs.select("*", F.explode(F.array(
        F.concat(F.lit("mode="), F.col("mode")), F.concat(F.lit("rate="), F.col("rate").cast("string")),
        F.concat(F.lit("ngpu="), F.col("ngpu").cast("string")),
        F.concat(F.lit("dispatcher="), F.when(F.col("dispatcher"), F.lit("True")).otherwise(F.lit("false"))),
        F.lit("gpu_util=0.95"), F.lit("tag=main"), F.lit("lengths=[1024, 256]"))).alias("line"))
    out = tx.parse_kv(lines).drop("line")
    total = F.aggregate("v_list", F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"list_items": F.when(F.col("v_list").isNotNull(), F.size("v_list")).cast("bigint"),
                            "list_total": total}).drop("v_list")


_MODES = [("view", "hybrid"), ("click", "cpu"), ("purchase", "all-gpu"), ("error", "ded-gpu"), ("signup", "none")]
_MODES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MODES) + ") AS m(mode, search_mode)"


@_reg("txt_run_name", f"""WITH {sp.stages_cte()}, runs AS (SELECT DISTINCT st.mode, m.search_mode, ngpu, rate, input_len, output_len
  FROM st JOIN {_MODES_SQL} ON m.mode = st.mode),
r AS (SELECT *, CAST(rate AS DOUBLE) * 8.0::DOUBLE / CAST(ngpu AS DOUBLE) AS arate FROM runs)
SELECT mode, ngpu, rate, input_len, output_len,
  concat_ws('_', 'S' || CAST(CASE WHEN search_mode = 'hybrid' THEN 150 ELSE 0 END AS VARCHAR), 'I' || CAST(input_len AS VARCHAR),
    'O' || CAST(output_len AS VARCHAR),
    CASE WHEN arate = floor(arate) THEN 'R' || CAST(CAST(floor(arate) AS BIGINT) AS VARCHAR) ELSE 'R' || printf('%.2f', arate) END,
    'N' || CAST(CASE WHEN search_mode = 'ded-gpu' THEN ngpu - 1 ELSE ngpu END AS VARCHAR), 'U95', 'P2048')
  || CASE WHEN search_mode = 'hybrid' THEN '' ELSE '_Dx' END AS run_name FROM r""")
def txt_run_name(spark, sf):
    """Result-file label of every run (hybrid mode keeps the dispatcher)."""
    req = fx.requests(spark, sf)
    modes = spark.createDataFrame(_MODES, "mode string, search_mode string")
    runs = req.select("mode", "ngpu", "rate", "input_len", "output_len").distinct().join(F.broadcast(modes), "mode")
    vl = F.col("search_mode") == "hybrid"
    arate = F.col("rate").cast("double") * F.lit(8.0) / F.col("ngpu").cast("double")
    workers = F.when(F.col("search_mode") == "ded-gpu", F.col("ngpu") - 1).otherwise(F.col("ngpu"))
    name = tx.run_name(F.when(vl, F.lit(150)).otherwise(F.lit(0)), F.col("input_len"), F.col("output_len"), arate,
                       workers, F.lit(0.95), F.lit(2048), vl)
    return runs.select("mode", "ngpu", "rate", "input_len", "output_len", name.alias("run_name"))


@_reg("txt_worker_assign", f"WITH {sp.requests_cte()} SELECT rid, CAST(rid % {WORKERS} AS INTEGER) AS worker FROM req")
def txt_worker_assign(spark, sf):
    """Request to generation worker by rid mod 4."""
    base = fx.request_base(spark, sf)
    return base.select("rid", F.pmod("rid", F.lit(WORKERS)).cast("int").alias("worker"))


# ------------------------------------------------------------- sampling
_EMB_PERM = f"ep AS (SELECT vec_id, label, embedding, {_PERM_SQL.format(c='vec_id')} AS perm_rank FROM embeddings)"


@_reg("smp_split", f"""WITH {_EMB_PERM}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT vec_id, perm_rank, CASE WHEN perm_rank < CAST(floor(n.n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT)
  THEN 'test' ELSE 'train' END AS split, vec_id AS orig_index FROM ep, n""")
def smp_split(spark, sf):
    """Shuffled train/test split with exact sizes (train 20%)."""
    e = fx.table(spark, sf, "embeddings").select("vec_id")
    return smp.split(e, "vec_id", 0.2).select("vec_id", "perm_rank", "split", "orig_index")


@_reg("smp_train_sample", f"""WITH {_EMB_PERM}
SELECT vec_id, perm_rank FROM ep WHERE perm_rank < 39 * (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM embeddings)""")
def smp_train_sample(spark, sf):
    """Training sample of min(39 x nlist, n) vectors, nlist = floor(sqrt(n))."""
    e = fx.table(spark, sf, "embeddings").select("vec_id")
    nlist = fx.auto_nlist(e).first()["nlist"]
    return smp.train_sample(e, "vec_id", nlist).select("vec_id", "perm_rank")


@_reg("smp_permute", f"""WITH {_EMB_PERM}
SELECT perm_rank, vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS emb_sum FROM ep""")
def smp_permute(spark, sf):
    """Seeded permutation; id, label and vector travel together."""
    e = fx.table(spark, sf, "embeddings")
    p = smp.permute(e, "vec_id")
    return p.select("perm_rank", "vec_id", "label", round_to(F.aggregate(
        "embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 4).alias("emb_sum"))


@_reg("smp_cap", f"WITH {_EMB_PERM} SELECT perm_rank, vec_id FROM ep WHERE perm_rank < ceil(0.5::DOUBLE * (SELECT count(*) FROM embeddings))")
def smp_cap(spark, sf):
    """The first half of the shuffled profiling queries; the share is a parameter."""
    e = fx.table(spark, sf, "embeddings").select("vec_id")
    return smp.cap(e, "vec_id", 0.5).select("perm_rank", "vec_id")


@_reg("smp_cycle", f"""WITH {sp.requests_cte()}, {_EMB_PERM}
SELECT r.rid, ep.vec_id AS qid FROM req r JOIN ep ON ep.perm_rank = r.rid % (SELECT count(*) FROM embeddings)""")
def smp_cycle(spark, sf):
    """Request r searches the shuffled query at r mod nq (queries recycled)."""
    e = fx.table(spark, sf, "embeddings").select("vec_id")
    perm = smp.permute(e, "vec_id")
    nq = e.count()
    base = fx.request_base(spark, sf).select("rid")
    return smp.cycle(base, perm, nq).select("rid", F.col("vec_id").alias("qid"))
