"""Registered telemetry queries (TEL*) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import telemetry as tel
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp

Q: dict = {}
SQL: dict = {}

WARMUP = 10          # TEL2 head/tail trimmed
WORKERS = 4          # TEL11 generation workers (rid mod 4)
SEARCH_SLO = 0.15    # TEL12 seconds (wikiall search objective)
SCHED_WARMUP = 4     # TEL15 single-request batches before and after
MAX_BATCH = 32


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


def R(expr: str, d: int = 6) -> str:
    return f"round({expr}, {d})"


@_reg("tel_fanout", f"""WITH {sp.requests_cte()}
SELECT rid, batch_id, {R('arrival')} AS arrival, hit_rate FROM req""")
def tel_fanout(spark, sf):
    """Pack requests into batch records of <= 32 (arrays), then fan them out
    again: rid = record offset + position."""
    base = fx.request_base(spark, sf)
    rec = (base.groupBy("batch_id", F.floor(F.col("rid") / MAX_BATCH).alias("_chunk"))
           .agg(F.min("rid").alias("served"),
                F.array_sort(F.collect_list(F.struct("rid", "arrival", "hit_rate"))).alias("_s"))
           .select("batch_id", "served", F.col("_s.arrival").alias("arrivals"),
                   F.col("_s.hit_rate").alias("hit_rates")))
    out = tel.fanout(rec)
    return rnd(out.select("rid", "batch_id", "arrival", "hit_rate"), 6, "arrival")


@_reg("tel_trim", f"""WITH {sp.requests_cte()}
SELECT rid - {WARMUP} AS rid, rid AS orig_rid, {R('arrival')} AS arrival FROM req
WHERE rid >= {WARMUP} AND rid < (SELECT count(*) FROM req) - {WARMUP}""")
def tel_trim(spark, sf):
    """Warm-up head and tail of the request stream dropped, ids shifted to start at 0."""
    base = fx.request_base(spark, sf).withColumn("orig_rid", F.col("rid"))
    n = base.count()
    out = tel.trim(base, WARMUP, n - 2 * WARMUP)
    return rnd(out.select("rid", "orig_rid", "arrival"), 6, "arrival")


@_reg("tel_join", f"""WITH {sp.requests_cte()}
SELECT rid, batch_id, {R('start')} AS start, {R('callback')} AS callback, {R('done')} AS done FROM req""")
def tel_join(spark, sf):
    """Search and generation logs joined on rid."""
    base = fx.request_base(spark, sf)
    j = tel.join_logs(fx.search_log(base), fx.gen_log(base))
    return rnd(j.select("rid", "batch_id", "start", "callback", "done"), 6, "start", "callback", "done")


@_reg("tel_missing", f"""WITH {sp.requests_cte()}
SELECT rid, batch_id FROM req WHERE done > (SELECT max(arrival) FROM req)""")
def tel_missing(spark, sf):
    """Search rows whose generation record did not arrive within the run
    horizon (gen log cut at the last arrival)."""
    base = fx.request_base(spark, sf)
    horizon = base.agg(F.max("arrival").alias("_h"))
    gen = fx.gen_log(base).crossJoin(F.broadcast(horizon)).where(F.col("done") <= F.col("_h")).drop("_h")
    return tel.missing(fx.search_log(base), gen).select("rid", "batch_id")


_STAGES = ["ann_batch", "ann_pending", "ann_queue", "ann_search", "llm_queue", "prefill",
           "ttft", "e2e", "ann_e2e", "ann_idle"]


@_reg("tel_stages", f"""WITH {sp.stages_cte()}
SELECT rid, {', '.join(f"{R(c)} AS {c}" for c in _STAGES)} FROM st""")
def tel_stages(spark, sf):
    """Stage latencies of every request (batching, pending, queue, search, llm queue, prefill, ttft, e2e, idle)."""
    req = fx.requests(spark, sf)
    return rnd(req.select("rid", *_STAGES), 6, *_STAGES)


@_reg("tel_breakdown", f"""WITH {sp.stages_cte()}
SELECT rid, {R('quantize', 9)} AS quantize, {R('lut_compute', 9)} AS lut_compute, {R('lut_scan', 9)} AS lut_scan FROM st""")
def tel_breakdown(spark, sf):
    """Six-part search timing split into quantize, LUT compute and LUT scan."""
    req = fx.requests(spark, sf)
    return rnd(req.select("rid", "quantize", "lut_compute", "lut_scan"), 9, "quantize", "lut_compute", "lut_scan")


@_reg("tel_tpot", f"""WITH {sp.stages_cte()}
SELECT rid, output_len, {R('tpot', 9)} AS tpot FROM st""")
def tel_tpot(spark, sf):
    """Time per output token = generation time / output length."""
    req = fx.requests(spark, sf)
    return rnd(req.select("rid", "output_len", "tpot"), 9, "tpot")


_MET_UNPIVOT = " UNION ALL ".join(
    f"SELECT mode, rate, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM st" for m in tel.METRICS)


@_reg("tel_summary", f"""WITH {sp.stages_cte()}, lg AS ({_MET_UNPIVOT})
SELECT mode, rate, metric,
  {R('coalesce(avg(value), 0)')} AS avg,
  {R('coalesce(quantile_cont(value, 0.5), 0)')} AS p50,
  {R('coalesce(quantile_cont(value, 0.9), 0)')} AS p90,
  {R('coalesce(quantile_cont(value, 0.95), 0)')} AS p95
FROM lg GROUP BY mode, rate, metric""")
def tel_summary(spark, sf):
    """Mean/P50/P90/P95 of the 15 metrics per run (mode, rate); exact
    percentiles computed distributed (range-partitioned ranks)."""
    req = fx.requests(spark, sf)
    return rnd(tel.summarize(req, ["mode", "rate"]), 6, "avg", "p50", "p90", "p95")


@_reg("tel_avg_batch", f"""WITH {sp.requests_cte()}
SELECT mode, {R('avg(batch_size)')} AS avg_batch_size FROM (SELECT DISTINCT mode, batch_id, batch_size FROM req) d GROUP BY mode""")
def tel_avg_batch(spark, sf):
    """Mean batch size over distinct (batch, size) per mode."""
    base = fx.request_base(spark, sf)
    return rnd(tel.avg_batch(base, ["mode"]), 6, "avg_batch_size")


@_reg("tel_throughput", f"""WITH {sp.stages_cte()}, g AS (
  SELECT mode, rate, count(*) AS n, max_by(done, rid) - min_by(arrival, rid) AS total_time,
         avg(CAST(output_len AS DOUBLE)) AS olen FROM st GROUP BY mode, rate)
SELECT mode, rate, n, {R('total_time')} AS total_time,
  {R('CASE WHEN total_time > 0 THEN n / total_time ELSE 0.0 END', 9)} AS rps,
  {R('CASE WHEN total_time > 0 THEN n / total_time ELSE 0.0 END * olen', 6)} AS tps
FROM g""")
def tel_throughput(spark, sf):
    """Per run: requests, first-arrival-to-last-completion time, requests/s, tokens/s."""
    req = fx.requests(spark, sf)
    out = tel.throughput(req, ["mode", "rate"])
    out = out.withColumn("rps", round_to("rps", 9)).withColumn("tps", round_to("tps", 6))
    return rnd(out.select("mode", "rate", "n", "total_time", "rps", "tps"), 6, "total_time")


@_reg("tel_rolling", f"""WITH {sp.stages_cte()}
SELECT rid, CAST(rid % {WORKERS} AS INTEGER) AS worker,
  {R('avg(tpot) OVER (PARTITION BY rid % ' + str(WORKERS) + ' ORDER BY rid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 9)} AS tpot_rolling,
  count(*) OVER (PARTITION BY rid % {WORKERS} ORDER BY rid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS frame_size
FROM st""")
def tel_rolling(spark, sf):
    """Mean of the last 10 time-per-token values of each worker (rid mod 4)."""
    req = fx.requests(spark, sf)
    out = tel.rolling_mean(req.select("rid", "tpot"), "tpot", WORKERS)
    return rnd(out.select("rid", "worker", "tpot_rolling", "frame_size"), 9, "tpot_rolling")


@_reg("tel_slo_blocks", f"""WITH {sp.stages_cte()}, b AS (
  SELECT CAST(floor(rid / 1000) AS BIGINT) AS block, count(*) AS n,
         avg(CASE WHEN coalesce(ann_search <= {SEARCH_SLO}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
  FROM st GROUP BY 1)
SELECT block, n, {R('share')} AS share, share >= 0 AND share < 0.9 AS alert FROM b WHERE n = 1000""")
def tel_slo_blocks(spark, sf):
    """Search-SLO attainment per full block of 1000 requests, alert below 0.9."""
    req = fx.requests(spark, sf)
    return rnd(tel.slo_blocks(req, "ann_search", SEARCH_SLO), 6, "share")


@_reg("tel_dense_rows", f"""WITH {sp.stages_cte(completed_only=True)}, ids AS (SELECT range AS rid FROM range(0, (SELECT count(*) FROM req)))
SELECT ids.rid, coalesce(st.batch_id, -1) AS batch_id, CAST(coalesce(st.batch_size, -1) AS INTEGER) AS batch_size,
  {R('st.ttft')} AS ttft FROM ids LEFT JOIN st ON st.rid = ids.rid""")
def tel_dense_rows(spark, sf):
    """Dense rid 0..n-1 over the requests that completed within the horizon;
    the others get batch -1 and NULL metrics."""
    req = fx.requests(spark, sf, completed_only=True)
    n = fx.table(spark, sf, "events").count()
    out = tel.dense_rows(req.select("rid", "batch_id", "batch_size", "ttft"), n)
    return rnd(out.select("rid", "batch_id", "batch_size", "ttft"), 6, "ttft")


@_reg("tel_idle", f"""WITH {sp.stages_cte()}
SELECT batch_id, {R('ann_idle')} AS idle FROM bidle""")
def tel_idle(spark, sf):
    """Idle time before each batch: its start minus the previous batch completion (dense batch rank join)."""
    base = fx.request_base(spark, sf)
    return rnd(tel.batch_idle(base).select("batch_id", "idle"), 6, "idle")


@_reg("tel_batch_schedule", f"""WITH {sp.requests_cte()},
p AS (SELECT CAST(floor(((SELECT count(*) FROM req) - {2 * SCHED_WARMUP}) / {MAX_BATCH * (MAX_BATCH + 1) // 2}) AS BIGINT) AS reps),
s0 AS (
  SELECT i AS ord, 1 AS size FROM range(0, {SCHED_WARMUP}) t(i)
  UNION ALL SELECT {SCHED_WARMUP} + i, CAST(floor(i / (SELECT reps FROM p)) + 1 AS INTEGER) FROM range(0, {MAX_BATCH} * (SELECT reps FROM p)) t(i)
  UNION ALL SELECT {SCHED_WARMUP} + {MAX_BATCH} * (SELECT reps FROM p) + i, 1 FROM range(0, {SCHED_WARMUP}) t(i)),
s1 AS (SELECT ord, size, coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_rid FROM s0)
SELECT r.rid, s1.ord AS sched_batch, CAST(s1.size AS INTEGER) AS sched_size
FROM req r LEFT JOIN s1 ON r.rid >= s1.first_rid AND r.rid < s1.first_rid + s1.size""")
def tel_batch_schedule(spark, sf):
    """Profiling schedule over the request stream: reps = (n - 8) // 528."""
    base = fx.request_base(spark, sf)
    n = base.count()
    reps = max(0, (n - 2 * SCHED_WARMUP) // (MAX_BATCH * (MAX_BATCH + 1) // 2))
    out = tel.batch_schedule(base.select("rid"), SCHED_WARMUP, reps, MAX_BATCH)
    return out.select("rid", "sched_batch", F.col("sched_size").cast("int").alias("sched_size"))


# ---------------------------------------------------------------- volume log
_VOL_METRICS = ["search", "e2e", "batch_size"]
_VOL_UNPIVOT = " UNION ALL ".join(
    f"SELECT l_returnflag, l_linestatus, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM vol" for m in _VOL_METRICS)


@_reg("tel_volume_summary", f"""WITH vol AS (
  SELECT l_returnflag, l_linestatus, l_discount + l_tax AS search, l_extendedprice / 1000.0::DOUBLE AS e2e,
         count(*) OVER (PARTITION BY l_orderkey) AS batch_size FROM lineitem),
lg AS ({_VOL_UNPIVOT})
SELECT l_returnflag, l_linestatus, metric, count(*) AS n, {R('avg(value)')} AS avg,
  {R('quantile_cont(value, 0.5)')} AS p50, {R('quantile_cont(value, 0.9)')} AS p90, {R('quantile_cont(value, 0.95)')} AS p95
FROM lg GROUP BY l_returnflag, l_linestatus, metric""")
def tel_volume_summary(spark, sf):
    """TEL8 at volume: lineitem as a request log (batch = order, search =
    discount + tax, e2e = price / 1000); batch size is a grouped count joined
    back (no window), percentiles exact and distributed."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus",
                                                 "l_discount", "l_tax", "l_extendedprice")
    sizes = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("batch_size"))
    vol = (li.join(sizes, "l_orderkey")
           .withColumn("search", F.col("l_discount") + F.col("l_tax"))
           .withColumn("e2e", F.col("l_extendedprice") / F.lit(1000.0)))
    keys = ["l_returnflag", "l_linestatus"]
    from ragspark.functions.stats import percentiles
    got = percentiles(vol, keys, _VOL_METRICS, [0.5, 0.9, 0.95], ["p50", "p90", "p95"])
    return rnd(got, 6, "avg", "p50", "p90", "p95")
