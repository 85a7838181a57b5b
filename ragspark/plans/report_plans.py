"""Registered report queries (RPT*) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.rounding import round_to

from ragspark.operators import reports as rp
from ragspark.plans import fixtures as fx
from ragspark.plans import sqlparts as sp
from ragspark.sources import catalog as cat

Q: dict = {}
SQL: dict = {}

SLO = fx.TTFT_SLO
MODEL, DEVICE = "llama8b", "L40S"


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


def hit_sql(cond: str) -> str:
    return f"CASE WHEN coalesce({cond}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


ST = sp.stages_cte()


@_reg("rpt_select_runs", f"""WITH {ST}
SELECT rid, mode, rate FROM st WHERE ngpu = 8 AND input_len = 1024 AND output_len = 256""")
def rpt_select_runs(spark, sf):
    """Requests of the runs matching GPU count and lengths (semi-join on the run table)."""
    req = fx.requests(spark, sf)
    runs = req.select(*fx.RUN_COLS).distinct()
    out = rp.select_runs(req, runs, ngpu=8, input_len=1024, output_len=256)
    return out.select("rid", "mode", "rate")


@_reg("rpt_union_runs", f"""WITH {ST}
SELECT DISTINCT mode, rate, batch_id, batch_size FROM st WHERE mode = 'view'
UNION ALL SELECT DISTINCT mode, rate, batch_id, batch_size FROM st WHERE mode = 'click'""")
def rpt_union_runs(spark, sf):
    """Batch tables of two modes concatenated and sorted by batch size."""
    req = fx.requests(spark, sf)
    parts = [req.where(F.col("mode") == m).select("mode", "rate", "batch_id", "batch_size").distinct()
             for m in ("view", "click")]
    return rp.union_runs(parts)


@_reg("rpt_slo_attain", f"""WITH {sp.stages_cte(completed_only=True, keep_unmatched=True)}
SELECT mode, rate, count(*) AS n, {R('avg(' + hit_sql(f'ttft <= {SLO}') + ')')} AS attainment FROM st GROUP BY mode, rate""")
def rpt_slo_attain(spark, sf):
    """TTFT attainment at 1800 s per run; requests without a generation record
    (cut at the run horizon) count as misses."""
    req = fx.requests(spark, sf, completed_only=True, keep_unmatched=True)
    return rnd(rp.slo_attainment(req, ["mode", "rate"], "ttft", SLO), 6, "attainment")


_PERF_SQL = cat.values_sql(cat.MODEL_PERF, "model, kind, device, input, output, ngpu, value")


@_reg("rpt_slo_threshold", f"""WITH {ST}, runs AS (SELECT DISTINCT ngpu, input_len, output_len, slo_ms FROM st),
pre AS (SELECT input AS input_len, output AS output_len, ngpu, value AS prefill_slo FROM {_PERF_SQL}
        WHERE kind = 'slo' AND model = '{MODEL}' AND device = '{DEVICE}')
SELECT r.ngpu, r.input_len, r.output_len, r.slo_ms, pre.prefill_slo,
       {R('r.slo_ms / 1000.0::DOUBLE + pre.prefill_slo')} AS threshold
FROM runs r LEFT JOIN pre ON pre.input_len = r.input_len AND pre.output_len = r.output_len AND pre.ngpu = r.ngpu""")
def rpt_slo_threshold(spark, sf):
    """Per run configuration: search objective plus the catalog prefill objective."""
    req = fx.requests(spark, sf)
    runs = req.select("ngpu", "input_len", "output_len", "slo_ms").distinct()
    out = rp.slo_threshold(runs, cat.model_perf(spark), MODEL, DEVICE)
    return rnd(out.select("ngpu", "input_len", "output_len", "slo_ms", "prefill_slo", "threshold"), 6, "threshold")


@_reg("rpt_attain_by_rate", f"""WITH {ST}
SELECT mode, rate, ngpu, count(*) AS n, {R('avg(' + hit_sql(f'ttft <= {SLO}') + ')')} AS attainment
FROM st GROUP BY mode, rate, ngpu""")
def rpt_attain_by_rate(spark, sf):
    """TTFT attainment per (mode, rate, GPU count)."""
    req = fx.requests(spark, sf)
    return rnd(rp.slo_attainment(req, ["mode", "rate", "ngpu"], "ttft", SLO), 6, "attainment")


@_reg("rpt_e2e_by_rate", f"""WITH {ST}
SELECT mode, rate, {R('avg(e2e)')} AS mean_e2e FROM st GROUP BY mode, rate""")
def rpt_e2e_by_rate(spark, sf):
    """Mean end-to-end latency per (mode, rate)."""
    req = fx.requests(spark, sf)
    return rnd(rp.mean_by(req, ["mode", "rate"], ["e2e"]), 6, "mean_e2e")


@_reg("rpt_stage_breakdown", f"""WITH {ST}, m AS (
  SELECT mode, rate, avg(ann_queue) AS mean_ann_queue, avg(ann_search) AS mean_ann_search, avg(prefill) AS mean_prefill
  FROM st GROUP BY mode, rate)
SELECT mode, rate, {R('mean_ann_queue')} AS mean_ann_queue, {R('mean_ann_search')} AS mean_ann_search,
  {R('mean_prefill')} AS mean_prefill, 0.0::DOUBLE AS base_ann_queue, {R('0.0::DOUBLE + mean_ann_queue')} AS base_ann_search,
  {R('0.0::DOUBLE + mean_ann_queue + mean_ann_search')} AS base_prefill FROM m""")
def rpt_stage_breakdown(spark, sf):
    """Mean queue / search / prefill per (mode, rate) with stacked offsets."""
    req = fx.requests(spark, sf)
    out = rp.stage_breakdown(req, ["mode", "rate"])
    cols = ["mean_ann_queue", "mean_ann_search", "mean_prefill", "base_ann_queue", "base_ann_search", "base_prefill"]
    return rnd(out, 6, *cols)


@_reg("rpt_ablation_pivot", f"""WITH {ST}, g AS (
  SELECT rate, dispatcher, avg(ann_search) AS mean, quantile_cont(ann_search, 0.9) AS p90, avg(batch_size) AS batch
  FROM st GROUP BY rate, dispatcher)
SELECT rate,
  {R('max(CASE WHEN dispatcher THEN mean END)')} AS on_mean, {R('max(CASE WHEN dispatcher THEN p90 END)')} AS on_p90,
  {R('max(CASE WHEN dispatcher THEN batch END)')} AS on_batch,
  {R('max(CASE WHEN NOT dispatcher THEN mean END)')} AS off_mean, {R('max(CASE WHEN NOT dispatcher THEN p90 END)')} AS off_p90,
  {R('max(CASE WHEN NOT dispatcher THEN batch END)')} AS off_batch
FROM g GROUP BY rate""")
def rpt_ablation_pivot(spark, sf):
    """Dispatcher on vs off per rate: mean and exact P90 search time, mean batch size."""
    req = fx.requests(spark, sf)
    out = rp.ablation_pivot(req, "rate", "dispatcher", "ann_search", "batch_size")
    return rnd(out, 6, "on_mean", "on_p90", "on_batch", "off_mean", "off_p90", "off_batch")


@_reg("rpt_p90_by_length", f"""WITH {ST}
SELECT 'input' AS kind, input_len AS length, rate, {R('quantile_cont(ttft, 0.9) * 1000.0::DOUBLE', 3)} AS p90_ttft_ms
FROM st WHERE output_len = 256 GROUP BY input_len, rate
UNION ALL
SELECT 'output' AS kind, output_len AS length, rate, {R('quantile_cont(ttft, 0.9) * 1000.0::DOUBLE', 3)} AS p90_ttft_ms
FROM st WHERE input_len = 1024 GROUP BY output_len, rate""")
def rpt_p90_by_length(spark, sf):
    """Exact P90 TTFT (ms) per rate by input length and by output length."""
    req = fx.requests(spark, sf)
    a = rp.quantiles(req.where(F.col("output_len") == 256), ["input_len", "rate"], "ttft", [0.9],
                     ["p90_ttft_ms"], 1000.0).select(F.lit("input").alias("kind"),
                                                     F.col("input_len").alias("length"), "rate", "p90_ttft_ms")
    b = rp.quantiles(req.where(F.col("input_len") == 1024), ["output_len", "rate"], "ttft", [0.9],
                     ["p90_ttft_ms"], 1000.0).select(F.lit("output").alias("kind"),
                                                     F.col("output_len").alias("length"), "rate", "p90_ttft_ms")
    return rnd(a.unionByName(b), 3, "p90_ttft_ms")


@_reg("rpt_quantiles_by_slo", f"""WITH {ST}
SELECT slo_ms, rate, {R('quantile_cont(ttft, 0.5)')} AS p50, {R('quantile_cont(ttft, 0.9)')} AS p90,
  {R('quantile_cont(ttft, 0.95)')} AS p95 FROM st GROUP BY slo_ms, rate""")
def rpt_quantiles_by_slo(spark, sf):
    """Exact P50 / P90 / P95 TTFT per (search objective, rate)."""
    req = fx.requests(spark, sf)
    out = rp.quantiles(req, ["slo_ms", "rate"], "ttft", [0.5, 0.9, 0.95], ["p50", "p90", "p95"])
    return rnd(out, 6, "p50", "p90", "p95")


@_reg("rpt_by_gpus", f"""WITH {ST}
SELECT ngpu, mode, rate, {R(f'{SLO} * ngpu / 8.0::DOUBLE')} AS threshold,
  {R('avg(' + hit_sql(f'ttft <= {SLO} * ngpu / 8.0::DOUBLE') + ')')} AS attainment, {R('avg(e2e)')} AS mean_e2e
FROM st GROUP BY ngpu, mode, rate""")
def rpt_by_gpus(spark, sf):
    """Attainment against a per-GPU-count threshold (1800 s x ngpu / 8) and
    mean end-to-end latency per (ngpu, mode, rate)."""
    req = fx.requests(spark, sf).withColumn("threshold", F.lit(SLO) * F.col("ngpu") / F.lit(8.0))
    att = rp.slo_attainment(req, ["ngpu", "mode", "rate", "threshold"], "ttft", F.col("threshold"))
    e2e = rp.mean_by(req, ["ngpu", "mode", "rate"], ["e2e"])
    out = att.join(e2e, ["ngpu", "mode", "rate"]).drop("n")
    return rnd(out, 6, "threshold", "attainment", "mean_e2e")


@_reg("rpt_rate_range", f"""WITH {ST}
SELECT mode, ngpu, min(rate) AS min_rate, max(rate) AS max_rate FROM st GROUP BY mode, ngpu""")
def rpt_rate_range(spark, sf):
    """Smallest and largest arrival rate per (mode, GPU count)."""
    req = fx.requests(spark, sf)
    return rp.rate_range(req, ["mode", "ngpu"])


@_reg("rpt_duplicates", f"""WITH {ST}
SELECT mode, rate, ngpu, count(DISTINCT run_day) AS n_runs, max(run_day) AS kept FROM st
GROUP BY mode, rate, ngpu HAVING count(DISTINCT run_day) > 1""")
def rpt_duplicates(spark, sf):
    """Run key (mode, rate, ngpu) recorded on several days: later day wins."""
    req = fx.requests(spark, sf)
    runs = req.select("mode", "rate", "ngpu", "run_day").distinct()
    return rp.duplicates(runs, ["mode", "rate", "ngpu"], "run_day")
