"""Access skew and hit rate (HIT1-7, HIT11).

Frequencies are a grouped count; the hot order is a distributed dense rank;
the CDF is a distributed prefix sum; target lookups are one conditional
aggregate per target set (no join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import prefix_sum


def frequency(probes: DataFrame, centroids: DataFrame) -> DataFrame:
    """HIT1: accesses per list over all probes, zeros kept."""
    c = probes.groupBy("list_id").agg(F.count(F.lit(1)).alias("freq"))
    return (centroids.select("list_id").join(c, "list_id", "left")
            .withColumn("freq", F.coalesce(F.col("freq"), F.lit(0)).cast("bigint")))


def cdf(freq: DataFrame, total_probes: int) -> DataFrame:
    """HIT2-3: hot order (freq desc, id asc) and running share of probes."""
    f = freq.withColumn("_neg", -F.col("freq"))
    out = prefix_sum(f, ["_neg", "list_id"], "freq", "_cum", rank_out="hot_rank")
    return out.withColumn("cdf", F.col("_cum") / F.lit(float(total_probes))).drop("_neg", "_cum")


def half_set(cdf_tab: DataFrame, point: float = 0.5) -> DataFrame:
    """HIT4: lists strictly before the CDF first reaches ``point``."""
    first = cdf_tab.where(F.col("cdf") >= point).agg(F.min("hot_rank").alias("_cut"))
    return cdf_tab.crossJoin(F.broadcast(first)).where(F.col("hot_rank") < F.col("_cut")).drop("_cut")


def per_query(probes: DataFrame, hot: DataFrame, nprobe: int) -> DataFrame:
    """HIT5: share of each query's probes that land in the hot set."""
    h = hot.select("list_id").withColumn("_hot", F.lit(1.0))
    j = probes.join(h, "list_id", "left")  # hot set <= nlist rows: AQE decides
    return j.groupBy("qid").agg((F.sum(F.coalesce(F.col("_hot"), F.lit(0.0))) / F.lit(float(nprobe))).alias("hit_rate"))


def moments(hit: DataFrame) -> DataFrame:
    """HIT6: mean and population variance of per-query hit rates."""
    return hit.agg(F.avg("hit_rate").alias("mean"), F.var_pop("hit_rate").alias("var"))


def beta_params(means: DataFrame, var: float | str) -> DataFrame:
    """HIT7: variance model 4 v m (1 - m) and Beta(alpha, beta) with
    c = m(1-m)/var_m - 1 = 1/(4v) - 1, alpha = m c, beta = (1 - m) c."""
    v = F.col(var) if isinstance(var, str) else F.lit(float(var))
    m = F.col("m")
    est = F.lit(4.0) * v * m * (F.lit(1.0) - m)
    common = m * (F.lit(1.0) - m) / est - F.lit(1.0)
    return (means.withColumn("est_var", est).withColumn("c", common)
            .withColumn("alpha", m * F.col("c")).withColumn("beta", (F.lit(1.0) - m) * F.col("c")))


def prefix_for_targets(cdf_tab: DataFrame, targets: Sequence[float], nlist: int | None = None) -> DataFrame:
    """HIT11: smallest hot prefix whose CDF reaches each target (0 -> 0 lists,
    1 -> all lists), as one conditional aggregate over the CDF table."""
    aggs = [F.min(F.when(F.col("cdf") >= F.lit(float(t)), F.col("hot_rank"))).alias(f"t{i}")
            for i, t in enumerate(targets)]
    aggs.append(F.count(F.lit(1)).alias("_nlist"))
    row = cdf_tab.agg(*aggs)
    spark = cdf_tab.sparkSession
    tgt = spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "_i int, target double")
    cols = F.array(*[F.col(f"t{i}") for i in range(len(targets))])
    out = row.select(cols.alias("_a"), "_nlist").crossJoin(F.broadcast(tgt))
    found = F.element_at("_a", F.col("_i") + 1)
    n = F.when(F.col("target") <= 0, F.lit(0)).when(F.col("target") >= 1, F.col("_nlist")) \
        .otherwise(found + 1)
    return out.select("target", n.cast("bigint").alias("prefix_len"))
