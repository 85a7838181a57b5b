"""Registered streaming queries (STR*): each stages its input derived from
the tables, runs the stream to the end (availableNow) and returns the sink
read back.  The oracle SQL is the batch result the replay must equal."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import snapshot
from ragspark.functions.rounding import round_to
from pyspark.sql import types as T

from ragspark.operators import search as S
from ragspark.operators import text as tx
from ragspark.operators import vector as V
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.plans.index_plans import State
from ragspark.plans.text_plans import SENT
from ragspark.plans.vector_plans import assignment
from ragspark.sources import scratch
from ragspark.streaming import jobs

Q: dict = {}
SQL: dict = {}

WORKERS = 4
SEARCH_SLO = 0.15


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


def _requests(spark, sf) -> DataFrame:
    """Request stream rows: rid, the query it searches (rid mod nq), event time."""
    nq = fx.vectors(spark, sf).count()
    req = fx.requests(spark, sf)
    return req.select("rid", F.pmod("rid", F.lit(nq)).alias("qid"),
                      F.timestamp_seconds(F.col("arrival") + F.lit(fx.EPOCH0_US / 1e6)).alias("arrival_ts"),
                      "start", "callback", "done", "ann_search")


def _stage(spark, df: DataFrame, name: str, batch_files: int | None = None) -> tuple[DataFrame, T.StructType]:
    """``df`` as a file stream.  A micro-batch reads at most ``batch_files`` files;
    by default one per shuffle partition, so a shuffle task meets about a file's rows."""
    path = scratch.new_dir(spark, f"stream-in-{name}")
    each = jobs.stage_files(df, path, "rid", batch_files=batch_files or _partitions(spark))
    return jobs.file_stream(spark, path, df.schema, each), df.schema


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_REQ_SQL = "rq AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS rid FROM events)"
_NQ = "(SELECT count(*) FROM embeddings)"
_SEARCH_SQL = f"""WITH {sp.CENT}, {sp.ASG}, {sp.PROBES}, {sp.FLAT_CAND}, top AS ({sp.topk('cand')}), {_REQ_SQL}"""


def _search_results(spark, sf) -> str:
    """Run STR1 and return the folder holding its results."""
    vecs, cent, asg, blocks = assignment(spark, sf, with_blocks=True)   # centroids collected once
    members = snapshot(asg.select("vec_id", "list_id").join(vecs, "vec_id"), "members")     # not joined again by every batch
    sizes = asg.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    qvecs = fx.queries(spark, sf)
    stream, _ = _stage(spark, _requests(spark, sf).select("rid", "qid", "arrival_ts"), "search")
    out = scratch.new_dir(spark, "stream-search")
    dim = V.vector_dim(cent, "centroid")

    def search_batch(bdf: DataFrame) -> DataFrame:
        qs = bdf.select("qid").distinct().join(qvecs, "qid")
        probes = snapshot(V.nearest(qs, cent, fx.NPROBE, base_id="qid", base_vec="embedding", ref_id="list_id",
                                    ref_vec="centroid", out_base="qid", out_ref="list_id", out_rank="probe_rank",
                                    out_dist="cdist", matrix=blocks), "batch-probes")
        res = S.ivf_search(probes, qvecs, members, fx.TOPK, mode="flat", sizes=sizes, dim=dim)
        return jobs.per_request(bdf.select("rid", "qid"), res)
    jobs.search_stream(stream, search_batch, out, spark)
    return out


@_reg("str_search", f"""{_SEARCH_SQL}
SELECT r.rid, t.qid, t.rank, t.vec_id, t.dist FROM rq r JOIN top t ON t.qid = r.rid % {_NQ}""")
def str_search(spark, sf):
    """Streaming search: each micro-batch of requests is one search batch."""
    out = _search_results(spark, sf)
    back = spark.read.parquet(out).select("rid", "qid", "rank", "vec_id", "dist")
    return rnd(back, 4, "dist")


@_reg("str_docs", f"""{_SEARCH_SQL}, {SENT}, d AS (
  SELECT r.rid, t.rank, c.text FROM rq r JOIN top t ON t.qid = r.rid % {_NQ} JOIN chunks c ON c.chunk_id = t.vec_id)
SELECT rid, CAST(rid % {WORKERS} AS INTEGER) AS worker, count(*) AS n_docs,
  md5(trim(string_agg(text, ' ' ORDER BY rank))) AS ctx_md5 FROM d GROUP BY rid""")
def str_docs(spark, sf):
    """Search results streamed through a stream-static join with the chunk
    store into per-worker folders; contexts assembled from the read-back."""
    res_path = _search_results(spark, sf)
    schema = spark.read.parquet(res_path).schema
    # an epoch wrote a file per shuffle partition: as many make a micro-batch again
    results = jobs.file_stream(spark, res_path, schema, _partitions(spark))
    # chunks are numbered over all documents; the store keeps those that the index can return
    ids = fx.vectors(spark, sf).select(F.col("vec_id").alias("chunk_id"))
    chunks = tx.chunk(fx.table(spark, sf, "documents"), ids=ids)
    out = scratch.new_dir(spark, "stream-docs")
    jobs.docs_stream(results.select("rid", "qid", "rank", "vec_id"), chunks, out, WORKERS, spark)
    back = spark.read.schema(jobs.DOCS_OUT).parquet(out)
    return back.select("rid", "worker", F.size("docs").cast("bigint").alias("n_docs"),
                       F.md5(F.trim(F.array_join(F.col("docs.text"), " "))).alias("ctx_md5"))


@_reg("str_log_join", f"""WITH {sp.requests_cte()}
SELECT rid, round(start, 6) AS start, round(callback, 6) AS callback, round(done, 6) AS done FROM req""")
def str_log_join(spark, sf):
    """Search and generation logs as two streams joined on rid with
    watermarks and an event-time bound."""
    req = _requests(spark, sf)
    # both sides of a micro-batch lie in the join's state: their size follows the cores, not the input
    cores = spark.sparkContext.defaultParallelism
    s_stream, _ = _stage(spark, req.select("rid", "arrival_ts", "start"), "slog", cores)
    g_rows = req.select("rid", F.timestamp_seconds(F.col("done") + F.lit(fx.EPOCH0_US / 1e6)).alias("done_ts"),
                        "callback", "done")
    g_stream, _ = _stage(spark, g_rows, "glog", cores)
    out = scratch.new_dir(spark, "stream-join")
    jobs.join_logs_stream(s_stream, g_stream, out, spark)
    return rnd(spark.read.parquet(out), 6, "start", "callback", "done")


@_reg("str_access", f"""WITH {sp.CENT}, {sp.PROBES}, {_REQ_SQL}
SELECT p.list_id, count(*) AS accesses FROM rq r JOIN probes p ON p.qid = r.rid % {_NQ} GROUP BY p.list_id""")
def str_access(spark, sf):
    """Live access counters per list over the probe stream of all requests."""
    st = State(spark, sf)
    stream, _ = _stage(spark, _requests(spark, sf).select("rid", "qid", "arrival_ts"), "access")
    probes = stream.join(st.probes.select("qid", "list_id"), "qid")
    return jobs.access_stream(probes, scratch.new_dir(spark, "stream-access"), spark).select("list_id", "accesses")


@_reg("str_slo_monitor", f"""WITH {sp.stages_cte()}, b AS (
  SELECT CAST(floor(rid / 1000) AS BIGINT) AS block, count(*) AS n,
         avg(CASE WHEN coalesce(ann_search <= {SEARCH_SLO}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
  FROM st GROUP BY 1)
SELECT block, n, round(share, 6) AS share, share >= 0 AND share < 0.9 AS alert FROM b WHERE n = 1000""")
def str_slo_monitor(spark, sf):
    """Stateful SLO monitor: attainment of every completed block of 1000
    requests, alert below 0.9; equals the batch block report."""
    stream, _ = _stage(spark, _requests(spark, sf).select("rid", "arrival_ts", "ann_search"), "slo")
    out = jobs.slo_monitor_stream(stream, "ann_search", SEARCH_SLO, scratch.new_dir(spark, "stream-slo"), spark)
    return rnd(out.where("kind = 'block' and complete").select("block", "n", "share", "alert"), 6, "share")


@_reg("str_early_emit", f"""{sp.index_ctes(*sp.INDEX_ALL)}, {_REQ_SQL},
cold AS (SELECT DISTINCT qid FROM routed WHERE shard = -1)
SELECT r.rid, r.rid % {_NQ} AS qid, CASE WHEN c.qid IS NULL THEN 'hot' ELSE 'cold' END AS tier
FROM rq r LEFT JOIN cold c ON c.qid = r.rid % {_NQ}""")
def str_early_emit(spark, sf):
    """Requests answerable from the device tier are emitted by their own
    stream; the rest follow; each request appears once."""
    st = State(spark, sf)
    cold = st.routed().where(F.col("shard") == -1).select("qid").distinct()
    stream, _ = _stage(spark, _requests(spark, sf).select("rid", "qid", "arrival_ts"), "early")
    out = scratch.new_dir(spark, "stream-early")
    jobs.early_emit_stream(stream, cold, out, spark)
    return spark.read.parquet(f"{out}/hot").unionByName(spark.read.parquet(f"{out}/cold"))
