"""Expected minimum hit rate of a batch (HIT8-10, HIT12) as a table job.

For hit rates ~ Beta(alpha, beta) with alpha = m c, beta = (1 - m) c, the
expected minimum of n draws is  E = int_0^1 (1 - F(x))^n dx.  On the logit axis
t (x = 1 / (1 + e^-t), dx = x (1 - x) dt) the density mass of node j is
w_j = x^alpha (1 - x)^beta dt; tails beyond |t| = 30 are integrated
analytically (e^{-30 alpha} / alpha and e^{-30 beta} / beta).  F at a node is
the normalised running sum (midpoint rule), a window over the 1201 nodes of
one mean - a config-sized partition.  All n are summed in one aggregate.
m = 0 and m = 1 pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

T0, DT, NODES = -30.0, 0.05, 1201


def nodes_expr():
    j = F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("j")
    return j


def tail(means: DataFrame, ns: Sequence[int]) -> DataFrame:
    """means(m, c, ...) -> (m, n, tail) for every n in ``ns``."""
    keys = [c for c in means.columns if c not in ("c",)]
    inner = means.where((F.col("m") > 0) & (F.col("m") < 1))
    g = inner.select(*keys, "c", nodes_expr())
    t = F.lit(T0) + F.col("j").cast("double") * F.lit(DT)
    g = (g.withColumn("_t", t)
         .withColumn("_x", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_t"))))
         .withColumn("_lnx", -F.log(F.lit(1.0) + F.exp(-F.col("_t"))))
         .withColumn("_ln1mx", -F.log(F.lit(1.0) + F.exp(F.col("_t"))))
         .withColumn("_a", F.col("m") * F.col("c"))
         .withColumn("_b", (F.lit(1.0) - F.col("m")) * F.col("c"))
         .withColumn("_w", F.exp(F.col("_a") * F.col("_lnx") + F.col("_b") * F.col("_ln1mx")) * F.lit(DT))
         .withColumn("_L", F.exp(F.lit(T0) * F.col("_a")) / F.col("_a"))
         .withColumn("_R", F.exp(F.lit(T0) * F.col("_b")) / F.col("_b")))
    part = Window.partitionBy(*keys)
    run = part.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    g = (g.withColumn("_cum", F.sum("_w").over(run))
         .withColumn("_Z", F.col("_L") + F.sum("_w").over(part) + F.col("_R"))
         .withColumn("_F", (F.col("_L") + F.col("_cum") - F.col("_w") / F.lit(2.0)) / F.col("_Z"))
         .withColumn("_g", F.col("_x") * (F.lit(1.0) - F.col("_x")) * F.lit(DT)))
    aggs = [F.sum(F.pow(F.lit(1.0) - F.col("_F"), F.lit(float(n))) * F.col("_g")).alias(f"_n{n}") for n in ns]
    wide = g.groupBy(*keys).agg(*aggs)
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(int(n)).alias("n"), F.col(f"_n{n}").alias("tail"))
                                                  for n in ns])).alias("_s")).select(*keys, "_s.n", "_s.tail")
    edge = (means.where((F.col("m") <= 0) | (F.col("m") >= 1))
            .select(*keys, F.explode(F.array(*[F.lit(int(n)) for n in ns])).alias("n"))
            .withColumn("tail", F.when(F.col("m") >= 1, F.lit(1.0)).otherwise(F.lit(0.0))))
    return long.unionByName(edge)


def tail_empirical(hits: DataFrame, ns: Sequence[int]) -> DataFrame:
    """HIT9: the same quantity from observed per-query hit rates:
    sum_i h_(i) [((N-i+1)/N)^n - ((N-i)/N)^n] with h sorted ascending."""
    from ragspark.functions.ranks import global_rank
    n_all = hits.count()
    r = global_rank(hits.select("hit_rate"), ["hit_rate"], out="_i").withColumn("_i", F.col("_i") + 1)
    N = F.lit(float(n_all))
    aggs = [F.sum(F.col("hit_rate") * (F.pow((N - F.col("_i") + 1) / N, F.lit(float(n)))
                                      - F.pow((N - F.col("_i")) / N, F.lit(float(n))))).alias(f"_n{n}") for n in ns]
    wide = r.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(int(n)).alias("n"), F.col(f"_n{n}").alias("tail"))
                                           for n in ns])).alias("_s")).select("_s.n", "_s.tail")


def required_mean(tail_tab: DataFrame, targets: Sequence[float]) -> DataFrame:
    """HIT10: per (n, target) the smallest grid mean whose tail reaches the
    target; targets outside (0, 1) are returned unchanged (as the reference)."""
    aggs = [F.min(F.when(F.col("tail") >= F.lit(float(t)), F.col("m"))).alias(f"_t{i}") for i, t in enumerate(targets)]
    wide = tail_tab.groupBy("n").agg(*aggs)
    long = wide.select("n", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias("_m"))
                                                for i, t in enumerate(targets)])).alias("_s"))
    return long.select("n", "_s.target", F.when((F.col("_s.target") <= 0) | (F.col("_s.target") >= 1),
                                                F.col("_s.target")).otherwise(F.col("_s._m")).alias("mean"))
