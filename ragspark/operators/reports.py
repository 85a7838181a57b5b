"""Figure numbers (RPT1-13) as grouped aggregates over the request table.

``requests`` is the wide per-request table; run attributes are columns of
it (or of a ``runs`` table joined on the run key).  Percentiles are exact and
distributed (``ragspark.functions.stats``); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.stats import exact_percentiles


def hit(cond: Column) -> Column:
    """1.0 when the condition holds, 0.0 when it fails or is unknown (NULL)."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def select_runs(requests: DataFrame, runs: DataFrame, **match) -> DataFrame:
    """RPT1: requests of runs whose attributes equal ``match``."""
    cond = F.lit(True)
    for k, v in match.items():
        cond = cond & (F.col(k) == F.lit(v))
    keys = [c for c in runs.columns if c in requests.columns]
    return requests.join(runs.where(cond).select(*keys).distinct(), keys, "left_semi")


def union_runs(frames: Sequence[DataFrame], order: str = "batch_size") -> DataFrame:
    """RPT2: concatenate run tables (schemas aligned by name), sorted."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(order)


def slo_attainment(requests: DataFrame, keys: Sequence[str], latency: str, slo: Column | float) -> DataFrame:
    """RPT3: share of requests with latency <= slo; missing latency is a miss."""
    thr = slo if isinstance(slo, Column) else F.lit(float(slo))
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                       F.avg(hit(F.col(latency) <= thr)).alias("attainment"))


def slo_threshold(runs: DataFrame, perf: DataFrame, model: str, device: str) -> DataFrame:
    """RPT4: threshold = search slo / 1000 + prefill objective of the model on
    the device for the run's (input, output, ngpu); NULL if the catalog has none."""
    pre = (perf.where((F.col("kind") == "slo") & (F.col("model") == model) & (F.col("device") == device))
           .select(F.col("input").alias("input_len"), F.col("output").alias("output_len"), "ngpu",
                   F.col("value").alias("prefill_slo")))
    return (runs.join(F.broadcast(pre), ["input_len", "output_len", "ngpu"], "left")
            .withColumn("threshold", F.col("slo_ms") / F.lit(1000.0) + F.col("prefill_slo")))


def mean_by(requests: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """RPT6 and friends: mean of each column per group."""
    return requests.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def stage_breakdown(requests: DataFrame, keys: Sequence[str],
                    stages: Sequence[str] = ("ann_queue", "ann_search", "prefill")) -> DataFrame:
    """RPT7: mean per stage plus the stacked offset where each bar starts."""
    out = mean_by(requests, keys, stages)
    acc = F.lit(0.0)
    for s in stages:
        out = out.withColumn(f"base_{s}", acc)
        acc = acc + F.col(f"mean_{s}")
    return out


def ablation_pivot(requests: DataFrame, key: str, flag: str, value: str, size: str) -> DataFrame:
    """RPT8: per key, mean and P90 of ``value`` and mean ``size`` with the
    flag on and off side by side (a pivot on the boolean flag)."""
    stats = requests.groupBy(key, flag).agg(F.avg(value).alias("mean"), F.avg(size).alias("batch"))
    p90 = exact_percentiles(requests, [key, flag], value, [0.9], ["p90"])
    both = stats.join(p90, [key, flag], "left")
    aggs = []
    for on, tag in ((True, "on"), (False, "off")):
        for c in ("mean", "p90", "batch"):
            aggs.append(F.max(F.when(F.col(flag) == F.lit(on), F.col(c))).alias(f"{tag}_{c}"))
    return both.groupBy(key).agg(*aggs)


def quantiles(requests: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
              names: Sequence[str], scale: float = 1.0) -> DataFrame:
    """RPT9/RPT10: exact percentiles of ``value`` (times ``scale``) per group."""
    out = exact_percentiles(requests, keys, value, ps, names)
    for n in names:
        out = out.withColumn(n, F.col(n) * F.lit(scale))
    return out


def rate_range(requests: DataFrame, keys: Sequence[str], rate: str = "rate") -> DataFrame:
    """RPT12: smallest and largest arrival rate per group."""
    return requests.groupBy(*keys).agg(F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))


def duplicates(runs: DataFrame, key: Sequence[str], instance: str) -> DataFrame:
    """RPT13: keys recorded by more than one run instance; the latest wins."""
    return (runs.groupBy(*key).agg(F.countDistinct(instance).alias("n_runs"), F.max(instance).alias("kept"))
            .where(F.col("n_runs") > 1))
