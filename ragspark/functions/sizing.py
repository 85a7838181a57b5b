"""Size guards for anything we broadcast or hold in one task.

Every broadcast in the library passes through here: the side is measured
(row count x bytes per row) before it is shipped, and callers fall back to a
blocked or shuffled plan above the cap.  Caps are session settings so a
cluster can raise or lower them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

CAP_KEY = "ragspark.broadcast.capBytes"
BLOCK_KEY = "ragspark.kernel.blockBytes"
DEFAULT_CAP = 256 * 1024 * 1024      # one broadcast matrix
DEFAULT_BLOCK = 64 * 1024 * 1024     # one cogroup cell / kernel working set


def broadcast_cap(spark: SparkSession) -> int:
    return int(spark.conf.get(CAP_KEY, str(DEFAULT_CAP)))


def block_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_KEY, str(DEFAULT_BLOCK)))


def rows_per_block(spark: SparkSession, bytes_per_row: int, cap: int | None = None) -> int:
    cap = cap or broadcast_cap(spark)
    return max(1, cap // max(1, bytes_per_row))


def fits(spark: SparkSession, rows: int, bytes_per_row: int, cap: int | None = None) -> bool:
    return rows * bytes_per_row <= (cap or broadcast_cap(spark))
