"""Request telemetry (TEL1-15): search and generation logs -> per-request
stage latencies -> summaries, throughput, SLO blocks.

All operators are column arithmetic, equi-joins on ``rid`` and grouped
aggregates.  The ones that look sequential in the reference (rolling mean per
worker, idle time between batches, batch schedules) are rewritten as
equi-joins on computed keys so that no un-partitioned window is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank, prefix_sum
from ragspark.functions.stats import join_null_safe, percentiles

# The 15 metrics of a run summary, in the reference's order.
METRICS = ["ann_queue", "ann_batch", "ann_pending", "ann_idle", "ann_search", "ann_e2e",
           "quantize", "lut_compute", "lut_scan", "hit_rate",
           "llm_queue", "prefill", "tpot", "ttft", "e2e"]


def fanout(records: DataFrame, offset: str = "served", arrays: Sequence[str] = ("arrivals", "hit_rates"),
           names: Sequence[str] = ("arrival", "hit_rate")) -> DataFrame:
    """TEL1: one batch record -> one row per request; rid = offset + position."""
    z = F.arrays_zip(*[F.col(a) for a in arrays])
    keep = [c for c in records.columns if c not in arrays]
    out = records.select(*keep, F.posexplode(z).alias("_pos", "_z"))
    for a, n in zip(arrays, names):
        out = out.withColumn(n, F.col(f"_z.{a}"))
    return out.withColumn("rid", (F.col(offset) + F.col("_pos")).cast("bigint")).drop("_z", "_pos")


def trim(log: DataFrame, warmup: int, total: int) -> DataFrame:
    """TEL2: drop warm-up head and tail, shift ids to start at 0."""
    return (log.where((F.col("rid") >= warmup) & (F.col("rid") < warmup + total))
            .withColumn("rid", F.col("rid") - F.lit(warmup)))


def join_logs(search: DataFrame, gen: DataFrame) -> DataFrame:
    """TEL3: inner join of both logs on rid."""
    return search.join(gen, "rid", "inner")


def missing(search: DataFrame, gen: DataFrame) -> DataFrame:
    """TEL4: search rows with no generation row (must be empty in a valid run)."""
    return search.join(gen.select("rid"), "rid", "left_anti")


def stages(joined: DataFrame, output_len: str | int = "output_len") -> DataFrame:
    """TEL5-7: stage latencies, breakdown split and time per output token."""
    olen = F.col(output_len) if isinstance(output_len, str) else F.lit(output_len)
    queue = F.col("start") - F.col("arrival")
    search = F.col("callback") - F.col("start")
    llm_queue = F.col("submit") - F.col("callback")
    prefill = F.col("first_token") - F.col("submit")
    b = F.col("breakdown")
    return (joined
            .withColumn("ann_batch", F.col("last_arrival") - F.col("arrival"))
            .withColumn("ann_pending", F.col("start") - F.col("last_arrival"))
            .withColumn("ann_queue", queue)
            .withColumn("ann_search", search)
            .withColumn("llm_queue", llm_queue)
            .withColumn("prefill", prefill)
            .withColumn("generate", F.col("done") - F.col("first_token"))
            .withColumn("ttft", queue + search + llm_queue + prefill)
            .withColumn("e2e", F.col("done") - F.col("arrival"))
            .withColumn("ann_e2e", search + queue)
            .withColumn("quantize", b[0])
            .withColumn("lut_compute", b[1] + b[2])
            .withColumn("lut_scan", b[3] + b[4] + b[5])
            .withColumn("tpot", F.col("generate") / olen.cast("double")))


def unpivot_metrics(requests: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide per-request metrics -> long (keys..., metric, value); NaN -> NULL."""
    long = requests.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def summarize(requests: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS,
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """TEL8: mean, P50, P90, P95 per (keys, metric); a metric with no values
    yields zeros, as in the reference.  Percentiles are exact by default: sketch
    brackets, then exact counts inside them (``stats.percentiles``), over the wide
    rows.  ``approx=True`` takes the sketches' values, and the output says which
    was used (``exact`` column)."""
    if approx:
        present = unpivot_metrics(requests, keys, metrics).where(F.col("value").isNotNull())
        q = F.percentile_approx("value", [0.5, 0.9, 0.95], accuracy)
        got = present.groupBy(*keys, "metric").agg(F.avg("value").alias("avg"), q.alias("_q")).select(
            *keys, "metric", "avg", F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p90"), F.col("_q")[2].alias("p95"))
        # (run, metric) domain from the distinct runs
        domain = requests.select(*keys).distinct().withColumn(
            "metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
        out = join_null_safe(domain, got, [*keys, "metric"], "left")
    else:
        out = percentiles(requests, keys, metrics, [0.5, 0.9, 0.95], ["p50", "p90", "p95"]).drop("n")
    for c in ("avg", "p50", "p90", "p95"):
        out = out.withColumn(c, F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)))
    return out.withColumn("exact", F.lit(not approx)) if approx else out


def avg_batch(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TEL9: mean batch size over distinct (batch id, size)."""
    return (requests.select(*keys, "batch_id", "batch_size").dropDuplicates([*keys, "batch_id", "batch_size"])
            .groupBy(*keys).agg(F.avg("batch_size").alias("avg_batch_size")))


def throughput(requests: DataFrame, keys: Sequence[str], output_len: str = "output_len") -> DataFrame:
    """TEL10: total = completion of the last rid - arrival of the first rid;
    rps = n / total; tps = rps * mean output length; zeros when total <= 0."""
    g = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max_by("done", "rid") - F.min_by("arrival", "rid")).alias("total_time"),
        F.avg(F.col(output_len).cast("double")).alias("_olen"))
    rps = F.when(F.col("total_time") > 0, F.col("n") / F.col("total_time")).otherwise(F.lit(0.0))
    return g.withColumn("rps", rps).withColumn("tps", F.col("rps") * F.col("_olen")).drop("_olen")


def rolling_mean(df: DataFrame, value: str, workers: int, window: int = 10) -> DataFrame:
    """TEL11: mean of the last ``window`` values seen by the same worker
    (worker = rid mod workers, so its previous requests are rid - workers, ...).

    Each row is sent to the ``window`` later rids whose frame contains it and
    averaged there: an equi-grouping on a computed key, no global window.
    """
    spread = df.select(F.col("rid").alias("_src"), F.col(value).alias("_v"),
                       F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("_j"))
    spread = spread.withColumn("rid", F.col("_src") + F.col("_j") * F.lit(workers))
    agg = spread.groupBy("rid").agg(F.avg("_v").alias(f"{value}_rolling"),
                                    F.count(F.lit(1)).alias("_cnt"),
                                    F.max(F.when(F.col("_j") == 0, 1)).alias("_self"))
    return (agg.where(F.col("_self") == 1).drop("_self")
            .withColumn("worker", F.pmod("rid", F.lit(workers)).cast("int"))
            .withColumnRenamed("_cnt", "frame_size"))


def slo_blocks(requests: DataFrame, latency: str, slo: float, block: int = 1000) -> DataFrame:
    """TEL12: share of requests meeting the SLO per full block of ``block``
    consecutive rids; ``alert`` when 0 <= share < 0.9."""
    g = (requests.groupBy(F.floor(F.col("rid") / block).cast("bigint").alias("block"))
         .agg(F.count(F.lit(1)).alias("n"),
              F.avg(F.when(F.coalesce(F.col(latency) <= F.lit(slo), F.lit(False)), 1.0).otherwise(0.0)).alias("share")))
    return (g.where(F.col("n") == block)
            .withColumn("alert", (F.col("share") >= 0) & (F.col("share") < 0.9)))


def dense_rows(requests: DataFrame, n: int) -> DataFrame:
    """TEL13: one row per rid in 0..n-1; absent ids get batch -1 / size -1 and
    NULL metrics."""
    spark = requests.sparkSession
    ids = spark.range(0, n).withColumnRenamed("id", "rid")
    out = ids.join(requests, "rid", "left")
    return (out.withColumn("batch_id", F.coalesce(F.col("batch_id"), F.lit(-1).cast("bigint")))
            .withColumn("batch_size", F.coalesce(F.col("batch_size"), F.lit(-1))))


def batch_idle(requests: DataFrame, start: str = "start", complete: str = "callback") -> DataFrame:
    """TEL14: idle time before each batch = its start - the previous batch's
    completion.  Batches are densely ranked (distributed) and joined to their
    predecessor on rank - 1; the first batch has NULL idle."""
    b = requests.groupBy("batch_id").agg(F.min(start).alias("b_start"), F.max(complete).alias("b_done"))
    b = global_rank(b, ["batch_id"], out="_bn")
    prev = b.select((F.col("_bn") + 1).alias("_bn"), F.col("b_done").alias("_prev_done"))
    return (b.join(prev, "_bn", "left")
            .withColumn("idle", F.col("b_start") - F.col("_prev_done"))
            .select("batch_id", "b_start", "b_done", "idle"))


def batch_schedule(requests: DataFrame, warmup: int, reps: int, max_size: int = 32) -> DataFrame:
    """TEL15: profiling schedule - ``warmup`` batches of 1, then sizes
    1..max_size each repeated ``reps`` times, then ``warmup`` batches of 1 -
    filled in rid order.  The schedule is generated by Spark (bounded by the
    configuration), prefix-summed, and matched to rids by a bucketed equi-join
    (a batch spans at most two buckets of width max_size).  Requests past the
    schedule keep NULL batch columns."""
    spark = requests.sparkSession
    head = spark.range(0, warmup).select(F.col("id").alias("_ord"), F.lit(1).alias("size"))
    mid = (spark.range(0, max_size * reps)
           .select((F.col("id") + warmup).alias("_ord"),
                   (F.floor(F.col("id") / reps) + 1).cast("int").alias("size")))
    tail = (spark.range(0, warmup)
            .select((F.col("id") + warmup + max_size * reps).alias("_ord"), F.lit(1).alias("size")))
    sched = head.unionByName(mid).unionByName(tail)
    sched = prefix_sum(sched, ["_ord"], "size", "first_rid", exclusive=True)
    sched = (sched.withColumnRenamed("_ord", "sched_batch")
             .withColumn("end_rid", F.col("first_rid") + F.col("size")))
    width = max_size
    buckets = sched.withColumn("_bk", F.explode(F.sequence(
        F.floor(F.col("first_rid") / width), F.floor((F.col("end_rid") - 1) / width))))
    buckets = buckets.select(F.col("_bk").alias("_sbk"), "sched_batch", F.col("size").alias("sched_size"),
                             "first_rid", "end_rid")
    req = requests.withColumn("_bk", F.floor(F.col("rid") / width))
    cond = ((F.col("_bk") == F.col("_sbk")) & (F.col("rid") >= F.col("first_rid")) & (F.col("rid") < F.col("end_rid")))
    return req.join(buckets, cond, "left").drop("_bk", "_sbk")
