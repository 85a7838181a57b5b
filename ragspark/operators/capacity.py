"""Capacity analytics (CAP1-14): the reference's single-machine bisections
and walks become scenario tables.

A *scenario* is a small row set (model, device, ngpu, index parameters,
rate ceiling, objective) from the catalog; the data enter through the hot
order and list sizes of our index, the fitted latency segments and the fitted
hit-rate variance.  Grids (prefix fraction p, batch size n) are generated
with ``sequence``/``explode``; walks that stop at the first non-improvement are
windows (``lag`` + first stop); fixed points are ``min(p)`` over feasible grid
points.  Everything is config-sized; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.operators.asof import interval_join

GIB = float(1024 ** 3)
OTHERS_GB = 2.0
# Arrival-rate ladder as fractions of the rate ceiling.
LADDER = [8 / 16, 10 / 16, 12 / 16, 13 / 16, 27 / 32, 14 / 16, 29 / 32, 15 / 16, 31 / 32, 1.0, 33 / 32]


# ------------------------------------------------------------- memory (CAP1-3)
def prefix_vectors(cdf_tab: DataFrame, sizes: DataFrame) -> DataFrame:
    """CAP1: vectors held by the first L lists in hot order, L = 1..nlist."""
    from ragspark.functions.ranks import prefix_sum
    t = cdf_tab.select("hot_rank", "list_id").join(sizes, "list_id")
    out = prefix_sum(t, ["hot_rank"], "n", "n_vectors")
    return out.select((F.col("hot_rank") + 1).alias("prefix_len"), F.col("n_vectors").cast("bigint").alias("n_vectors"))


def grid(spark, steps: int, name: str = "p", upto: float = 1.0) -> DataFrame:
    """p = k / steps for k = 0..steps*upto."""
    last = int(round(steps * upto))
    return spark.range(0, last + 1).select((F.col("id").cast("double") / F.lit(float(steps))).alias(name))


def with_share(points: DataFrame, pv: DataFrame, nlist: int, ntotal: int) -> DataFrame:
    """Share of all vectors held by the hot prefix covering fraction p of our
    lists: L = floor(p * nlist), share = vectors(L) / ntotal (0 for L = 0)."""
    pts = points.withColumn("_L", F.floor(F.col("p") * F.lit(float(nlist))).cast("bigint"))
    j = pts.join(pv.withColumnRenamed("prefix_len", "_L"), "_L", "left")
    return j.withColumn("share", F.coalesce(F.col("n_vectors"), F.lit(0)).cast("double") / F.lit(float(ntotal))) \
        .drop("_L", "n_vectors")


def memory(df: DataFrame, p: str = "p") -> DataFrame:
    """CAP2: index memory (GiB) at prefix fraction p for the scenario's index:
    centroids d*L*4, codes n*M/2, ids n*4, codebook M*msub*ksub*4, + 2 GB;
    whole / split over ngpu / dedicated to ``n_ded`` devices (centroids whole)."""
    nnlist = F.floor(F.col(p) * F.col("nlist_cat")).cast("bigint")
    nntotal = F.col("ntotal_cat").cast("double") * F.col("share")
    cen = (F.col("d") * nnlist * F.lit(4)).cast("double") / F.lit(GIB)
    inv = nntotal * F.col("m_sub").cast("double") * F.lit(0.5) / F.lit(GIB)
    ids = nntotal * F.lit(4.0) / F.lit(GIB)
    pq = (F.col("m_sub") * F.col("msub") * F.col("ksub") * F.lit(4)).cast("double") / F.lit(GIB)
    return (df.withColumn("mem_centroids", cen).withColumn("mem_codes", inv).withColumn("mem_ids", ids)
            .withColumn("mem_pq", pq)
            .withColumn("mem_whole", F.col("mem_centroids") + F.col("mem_pq") + F.col("mem_codes") + F.col("mem_ids")
                        + F.lit(OTHERS_GB))
            .withColumn("mem_split", F.col("mem_pq") + F.lit(OTHERS_GB)
                        + (F.col("mem_centroids") + F.col("mem_codes") + F.col("mem_ids")) / F.col("ngpu"))
            .withColumn("mem_dedicated", F.col("mem_pq") + F.lit(OTHERS_GB) + F.col("mem_centroids")
                        + (F.col("mem_codes") + F.col("mem_ids")) / F.col("n_ded")))


def tput_scaled(df: DataFrame) -> DataFrame:
    """CAP3: rate = ceiling * (kv0 - mem_split) / kv0 with kv0 = device - model
    memory; points where the index leaves no KV memory are dropped."""
    kv0 = F.col("gpu_mem") - F.col("model_mem")
    kv = kv0 - F.col("mem_split")
    return (df.withColumn("kv0", kv0).withColumn("kv", kv).where(F.col("kv") > 0)
            .withColumn("rate", F.col("ceiling") * (F.col("kv") / F.col("kv0"))))


# --------------------------------------------------- required hit (CAP4-6)
def latency_lines(cpu_segments: DataFrame, ns: DataFrame) -> DataFrame:
    """t(n) = lut(n) + quantize(n) and lut(n) at miss rate 1 from the host
    segments (closed, later wins); sizes no segment covers use slope 0 and
    intercept 0, as the reference does."""
    from ragspark.operators.latency import predict
    p = predict(ns, cpu_segments.where(F.col("component").isin("quantize", "lut")), "closed_last", "n")
    w = p.groupBy("n").agg(F.max(F.when(F.col("component") == "lut", F.col("pred"))).alias("lut_t"),
                           F.max(F.when(F.col("component") == "quantize", F.col("pred"))).alias("cq_t"))
    out = ns.join(w, "n", "left").fillna(0.0, ["lut_t", "cq_t"])
    return out.withColumn("search_t", F.col("lut_t") * F.lit(1.0) + F.col("cq_t"))


def clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def _need(num: Column, den: Column) -> Column:
    """clip(num / den, 0, 1); a zero LUT time gives 1 when time is short, else 0
    (the reference's clip of +-inf; its NaN case counts as 0)."""
    return F.when(den > 0, clip01(num / den)).otherwise(F.when(num > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def required_hit(points: DataFrame, lines: DataFrame, max_n: int) -> DataFrame:
    """CAP4: for every point (with ``rate`` and target time ``T``) and batch
    size n = 1..max_n, the tail hit rate needed to meet the fixed time T
    (``need_ceil``) and to keep up with the rate, n / rate (``need_floor``)."""
    pts = points.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max_n))))
    j = pts.join(F.broadcast(lines.select("n", "lut_t", "cq_t", "search_t")), "n")
    return (j.withColumn("need_ceil", _need(F.col("search_t") - F.col("T"), F.col("lut_t")))
            .withColumn("need_floor", _need(F.col("search_t") - F.col("n") / F.col("rate"), F.col("lut_t"))))


def lookup_mean(needs: DataFrame, tail_tab: DataFrame, need: str, out: str, keys: Sequence[str]) -> DataFrame:
    """HIT10 applied to computed needs: smallest grid mean whose tail at the
    same n reaches the need; needs outside (0, 1) pass through; a need above
    every tail gives 1.0.  Per n the grid's running best tail makes a staircase
    of intervals, one per mean that raises it, and a need looks up its step."""
    up = Window.partitionBy("n").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)      # the means of one n: the grid
    steps = (tail_tab.select("n", F.col("m").alias("_best"), F.col("tail").alias("_to"),
                             F.greatest(F.coalesce(F.max("tail").over(up), F.lit(0.0)), F.lit(0.0)).alias("_from"))
             .where(F.col("_to") > F.col("_from")))
    inner = needs.where((F.col(need) > 0) & (F.col(need) < 1)).select(*keys, "n", need)
    got = interval_join(inner, steps, need, "_from", "_to", keys=["n"], closed="right").select(*keys, "_best")
    res = needs.join(got, list(keys), "left")
    v = F.when((F.col(need) <= 0) | (F.col(need) >= 1), F.col(need)).otherwise(F.coalesce(F.col("_best"), F.lit(1.0)))
    return res.withColumn(out, v).drop("_best")


def walk_best(df: DataFrame, keys: Sequence[str], step: str, mean: str, n: str, need: str) -> DataFrame:
    """CAP5: walk rows ordered by ``step`` (0, 1, ...); the running best mean
    starts at 1.0 and the walk stops at the first step whose mean does not
    fall below it.  Returns per key the last improving step (or the start
    with mean 1.0 when the first step does not improve)."""
    w = Window.partitionBy(*keys).orderBy(step)
    flagged = df.withColumn("_prev", F.coalesce(F.lag(mean).over(w), F.lit(1.0))) \
        .withColumn("_stop", F.col(mean) >= F.col("_prev"))
    first_stop = flagged.where("_stop").groupBy(*keys).agg(F.min(step).alias("_k"))
    last_step = flagged.groupBy(*keys).agg(F.max(step).alias("_kmax"), F.min_by(n, step).alias("_n0"))
    cut = last_step.join(first_stop, list(keys), "left") \
        .withColumn("_k", F.coalesce(F.col("_k"), F.col("_kmax") + 1))
    pick = flagged.join(cut, list(keys)).where(F.col(step) == F.col("_k") - 1) \
        .select(*keys, F.col(n).alias("best_n"), F.col(mean).alias("best_mean"), F.col(need).alias("best_need"))
    start = cut.where(F.col("_k") == 0).select(*keys, F.col("_n0").alias("best_n"),
                                                F.lit(1.0).alias("best_mean"), F.lit(1.0).alias("best_need"))
    return pick.unionByName(start)


def ladder(ceiling: Column) -> Column:
    """CAP11: the 11 rates; integers (round half to even) for ceilings >= 16."""
    raw = [ceiling * F.lit(f) for f in LADDER]
    return F.when(ceiling >= 16, F.array(*[F.bround(r, 0) for r in raw])).otherwise(F.array(*raw))
