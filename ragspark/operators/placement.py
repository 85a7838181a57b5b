"""Inverted lists as tables: sizes, hot-list placement over shards, the full
lookup table, extraction of shard sub-indexes (IVF1-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import sizing
from ragspark.functions.ranks import global_rank


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast a lookup table only when its measured size is under the cap."""
    return F.broadcast(df) if sizing.fits(df.sparkSession, rows, bytes_per_row) else df


def list_sizes(centroids: DataFrame, assignment: DataFrame) -> DataFrame:
    """IVF1: vectors per list, empty lists kept with n = 0."""
    counts = assignment.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return (centroids.select("list_id").join(counts, "list_id", "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")))


def size_stats(sizes: DataFrame) -> DataFrame:
    """IVF2: nlist, ntotal, mean / max / min list size (one row)."""
    return sizes.agg(F.count(F.lit(1)).alias("nlist"), F.sum("n").alias("ntotal"),
                     F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"))


def place(hot: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """IVF3-4: hot lists by (size, id) ascending, dealt round-robin:
    shard = position mod shards, local_id = position div shards."""
    h = hot.select("list_id").join(sizes, "list_id")
    ranked = global_rank(h, ["n", "list_id"], out="_pos")
    return (ranked.withColumn("shard", (F.col("_pos") % shards).cast("bigint"))
            .withColumn("local_id", F.floor(F.col("_pos") / shards).cast("bigint"))
            .select("list_id", "n", "shard", "local_id"))


def shard_summary(placement: DataFrame) -> DataFrame:
    return placement.groupBy("shard").agg(F.count(F.lit(1)).alias("n_lists"), F.sum("n").alias("n_vectors"))


def full_lut(centroids: DataFrame, placement: DataFrame, nlist: int | None = None) -> DataFrame:
    """IVF7: every list -> (shard, local id); unplaced lists are shard -1 and
    keep their own id.  Entries pointing outside the list range fail the job."""
    nl = nlist if nlist is not None else centroids.count()
    p = placement.select("list_id", "shard", "local_id")
    out = (centroids.select("list_id").join(p, "list_id", "left")
           .withColumn("shard", F.coalesce(F.col("shard"), F.lit(-1).cast("bigint")))
           .withColumn("local_id", F.coalesce(F.col("local_id"), F.col("list_id")))
           .withColumn("_ok", F.when((F.col("local_id") >= 0) & (F.col("local_id") < F.lit(nl)), F.lit(True))
                       .otherwise(F.raise_error(F.lit("placement entry out of range")))))
    # the filter keeps the check alive through column pruning
    return out.where(F.col("_ok")).drop("_ok")


def extract(ivf: DataFrame, placement: DataFrame, nlist: int) -> DataFrame:
    """IVF5: members of placed lists with their shard and local list id (a
    writer partitions this by shard and sorts by local_id)."""
    p = maybe_broadcast(placement.select("list_id", "shard", "local_id"), nlist, 24)
    return ivf.join(p, "list_id")


def extract_single(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """IVF6: one-shard variant: size-ordered renumbering, id -1 skipped."""
    return place(hot.where(F.col("list_id") != -1), sizes, 1).drop("shard")


def hot_share(sizes: DataFrame, hot: DataFrame) -> DataFrame:
    """IVF8: hot lists and their vectors as counts and percent of all."""
    h = sizes.join(hot.select("list_id").withColumn("_hot", F.lit(1)), "list_id", "left")
    is_hot = F.col("_hot").isNotNull()
    g = h.agg(F.sum(F.when(is_hot, 1).otherwise(0)).cast("bigint").alias("hot_lists"),
              F.count(F.lit(1)).alias("all_lists"),
              F.sum(F.when(is_hot, F.col("n")).otherwise(0)).cast("bigint").alias("hot_vectors"),
              F.sum("n").cast("bigint").alias("all_vectors"))
    return (g.withColumn("pct_lists", F.col("hot_lists") * 100.0 / F.col("all_lists"))
            .withColumn("pct_vectors", F.col("hot_vectors") * 100.0 / F.col("all_vectors")))


def all_hot(sizes: DataFrame, hot: DataFrame) -> DataFrame:
    """IVF9: whether every list is hot (then the index stays unsplit)."""
    s = hot_share(sizes, hot)
    return s.select("hot_lists", "all_lists", (F.col("hot_lists") == F.col("all_lists")).alias("all_hot"))
