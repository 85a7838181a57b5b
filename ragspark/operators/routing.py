"""Per-query routing of probes to shards (RTE1-9).

Probes stay in long form ``(qid, probe_rank, list_id)``; routing is a join
with the full lookup table (nlist rows, broadcast when under the cap) and the
per-shard positions are a window over (qid, shard) - at most nprobe rows each.
Dense padded arrays exist only at the edge (``padded``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.operators.placement import maybe_broadcast
from ragspark.operators.vector import merge_topk


def route(probes: DataFrame, lut: DataFrame, nlist: int) -> DataFrame:
    """RTE1-2: (qid, probe_rank, list_id) -> + shard, local_id, pos, where pos
    is the 0-based position among the query's probes on that shard."""
    m = probes.join(maybe_broadcast(lut.select("list_id", "shard", "local_id"), nlist, 24), "list_id")
    w = Window.partitionBy("qid", "shard").orderBy("probe_rank")
    return m.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def _shard_order(col: str = "shard"):
    """Shard -1 (cold, host side) sorts after every device shard."""
    return F.when(F.col(col) < 0, F.lit(1 << 30)).otherwise(F.col(col))


def shard_starts(routed: DataFrame) -> DataFrame:
    """RTE3: rows per shard and the exclusive prefix offset (cold shard last).
    One row per shard: a config-bounded window."""
    g = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("_o", _shard_order())
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint")).drop("_o")


def widths(routed: DataFrame, shard_ids: Sequence[int]) -> DataFrame:
    """RTE4: per shard, the largest number of probes any query sends there;
    shards nobody probes report 0."""
    per_q = routed.groupBy("shard", "qid").agg(F.count(F.lit(1)).alias("_c"))
    w = per_q.groupBy("shard").agg(F.max("_c").alias("width"))
    spark = routed.sparkSession
    all_s = spark.createDataFrame([(int(s),) for s in shard_ids], "shard bigint")
    return all_s.join(w, "shard", "left").withColumn("width", F.coalesce(F.col("width"), F.lit(0)).cast("bigint"))


def padded(routed: DataFrame, queries: DataFrame, shard_ids: Sequence[int]) -> DataFrame:
    """RTE5: for every (query, shard) a dense array of local ids in probe
    order padded with -1 to the shard's width (also for queries with none)."""
    wid = widths(routed, shard_ids)
    lists = (routed.groupBy("qid", "shard")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "local_id"))).alias("_s"))
             .select("qid", "shard", F.col("_s.local_id").alias("ids")))
    grid = queries.select("qid", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in shard_ids])).alias("shard"))
    out = (grid.join(lists, ["qid", "shard"], "left").join(F.broadcast(wid), "shard")
           .withColumn("ids", F.coalesce(F.col("ids"), F.array().cast("array<bigint>"))))
    pad = F.array_repeat(F.lit(-1).cast("bigint"), (F.col("width") - F.size("ids")).cast("int"))
    return out.withColumn("padded", F.concat(F.col("ids"), pad)).drop("ids")


def misses(routed: DataFrame, nprobe: int) -> DataFrame:
    """RTE6: cold probes per query and the hit rate (nprobe - miss) / nprobe."""
    g = routed.groupBy("qid").agg(F.count_if(F.col("shard") == -1).alias("misses"))
    return g.withColumn("hit_rate", (F.lit(nprobe) - F.col("misses")) / F.lit(float(nprobe)))


def hot_only(routed: DataFrame) -> DataFrame:
    """RTE7: queries with no cold probe - answerable from the device tier."""
    cold = routed.where(F.col("shard") == -1).select("qid")
    return routed.select("qid").distinct().join(cold, "qid", "left_anti")


def access_counts(probes: DataFrame) -> DataFrame:
    """RTE8: accesses per list."""
    return probes.groupBy("list_id").agg(F.count(F.lit(1)).alias("accesses"))


def hot_then_cold(candidates_hot: DataFrame, candidates_cold: DataFrame, k: int) -> DataFrame:
    """RTE9: merge the device-tier and host-tier top-k candidates."""
    return merge_topk(candidates_hot.unionByName(candidates_cold), k)
