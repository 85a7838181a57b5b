"""Distributed dense ranks and prefix sums without a single-partition window.

``global_rank`` range-partitions on the ordering, numbers rows inside each
partition and adds the row count of all earlier partitions.  The per-partition
counts are at most ``num_partitions`` rows, so broadcasting them is bounded by
configuration, not by data.

Spark seeds the range partitioner's sampling with the RDD id, so two
evaluations of the same range exchange (two branches of one plan, or a
recomputation after executor loss) may cut different boundaries.  The ranged,
locally numbered rows are therefore written once as a Parquet table in the
shared ``spark.checkpoint.dir`` (one computation, columnar, no lineage);
counts and ranks both read that snapshot, and lost executors re-read files
instead of re-sampling.  The partition id and in-partition position travel
as a column, so the read-back layout does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row_in_partition


def snapshot(df: DataFrame, name: str = "snap") -> DataFrame:
    """Materialise ``df`` as a Parquet table under the checkpoint folder."""
    from ragspark.sources.scratch import new_dir
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _num_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.repartitionByRange(_num_parts(df, num_partitions), *cols).sortWithinPartitions(*cols)


def _offsets(local: DataFrame, weight: str | None) -> DataFrame:
    """Exclusive prefix over partitions of row counts (and of ``weight``)."""
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if weight is not None:
        aggs.append(F.sum(weight).alias("_wsum"))
    per_part = local.groupBy("_pid").agg(*aggs)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    out = per_part.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if weight is not None:
        out = out.withColumn("_woff", F.coalesce(F.sum("_wsum").over(before), F.lit(0)))
    # at most num_partitions rows: safe to broadcast
    return F.broadcast(out.drop("_cnt", "_wsum"))


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Append a dense 0-based BIGINT rank following ``order`` (end it with a
    unique key; equal keys otherwise get an arbitrary but consistent order)."""
    ranged = _ranged(df, order, num_partitions)
    snap = snapshot(ranged.withColumn("_mid", F.monotonically_increasing_id()), "rank")
    local = (snap.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
             .withColumn("_lrn", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    offs = _offsets(local, None)
    return (local.join(offs, "_pid", "left")
            .withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint"))
            .drop("_mid", "_pid", "_lrn", "_off"))


def _local_cumsum_kernel(value: str, out_type: T.DataType):
    np_type = np.float64 if isinstance(out_type, T.DoubleType) else np.int64

    def run(batches):
        running = np_type(0)
        for batch in batches:
            vals = batch.column(value).to_numpy(zero_copy_only=False).astype(np_type)
            csum = np.cumsum(vals) + running
            if len(csum):
                running = csum[-1]
            yield batch.append_column("_lcsum", pa.array(csum))
    return run


def prefix_sum(df: DataFrame, order: Sequence[Column | str], value: str, out: str,
               exclusive: bool = False, num_partitions: int | None = None,
               rank_out: str | None = None) -> DataFrame:
    """Running sum of ``value`` along ``order`` (inclusive unless ``exclusive``).

    The in-partition running sum is an Arrow pass over the range-sorted
    partition (no extra shuffle); partition offsets come from the bounded
    per-partition table.  ``value`` must be non-null.
    """
    ranged = _ranged(df, order, num_partitions).withColumn("_pid", F.spark_partition_id())
    vtype = ranged.schema[value].dataType
    out_type = T.DoubleType() if isinstance(vtype, (T.DoubleType, T.FloatType, T.DecimalType)) else T.LongType()
    schema = T.StructType(ranged.schema.fields + [T.StructField("_lcsum", out_type, False)])
    local = ranged.mapInArrow(_local_cumsum_kernel(value, out_type), schema)
    if rank_out:
        local = (local.withColumn("_mid", F.monotonically_increasing_id())
                 .withColumn("_lrn", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    local = snapshot(local, "prefix")
    offs = _offsets(local, value)
    res = local.join(offs, "_pid", "left").withColumn(out, F.col("_woff") + F.col("_lcsum"))
    if exclusive:
        res = res.withColumn(out, F.col(out) - F.col(value))
    if rank_out:
        res = res.withColumn(rank_out, (F.col("_off") + F.col("_lrn")).cast("bigint")).drop("_mid", "_lrn")
    return res.drop("_pid", "_lcsum", "_off", "_woff")
