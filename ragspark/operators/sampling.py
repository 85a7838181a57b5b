"""Sampling and splits (SMP1-5) by seeded hash order.

The reference shuffles with an unseeded RNG; here the shuffle is the rank of
a 32-bit md5 prefix of ``seed:id`` (the same in the oracle SQL), computed
with the distributed ``global_rank`` - exact sizes, no ``randomSplit``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank


def seeded_hash(col: str, seed: str = "42") -> Column:
    s = F.concat(F.lit(seed + ":"), F.col(col).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def permute(df: DataFrame, id_col: str, seed: str = "42", out: str = "perm_rank") -> DataFrame:
    """SMP3: dense random order; a row keeps its id and payload together."""
    return global_rank(df.withColumn("_h", seeded_hash(id_col, seed)), ["_h", id_col], out=out).drop("_h")


def split(df: DataFrame, id_col: str, train_share: float, seed: str = "42") -> DataFrame:
    """SMP1: the first int(n * (1 - train_share)) rows of the shuffle are test,
    the rest train, at every table size; the original index is kept."""
    test_size = int(df.count() * (1 - train_share))
    p = permute(df, id_col, seed)
    return p.withColumn("split", F.when(F.col("perm_rank") < test_size, F.lit("test")).otherwise(F.lit("train"))) \
        .withColumn("orig_index", F.col(id_col))


BUCKETS = 1 << 16


def least(df: DataFrame, id_col: str, k: int, seed: str = "42") -> DataFrame:
    """The first ``k`` rows of the shuffle without shuffling the table: a
    histogram of the hashes (``BUCKETS`` counts at most) finds the bucket in which
    the k-th row lies, a finer one inside it the hash itself; rows below that hash
    are kept where they are, and only the rows of that one hash are put in order."""
    rows = df.withColumn("_h", F.coalesce(seeded_hash(id_col, seed), F.lit(-1).cast("bigint")))    # a null id comes first
    lo, hi, need = -1, 1 << 32, k
    while need > 0 and hi - lo > 1:
        width = -(-(hi - lo) // BUCKETS)
        hist = rows.where((F.col("_h") >= lo) & (F.col("_h") < hi)).groupBy(
            F.floor((F.col("_h") - lo) / width).cast("bigint").alias("b")).count().collect()
        before, at = 0, None
        for b, c in sorted(map(tuple, hist)):
            if before + c > need:
                at = b
                break
            before += c
        if at is None:                       # the whole range is wanted
            lo, need = hi, 0
            break
        lo, hi, need = lo + at * width, min(hi, lo + (at + 1) * width), need - before
    kept = rows.where(F.col("_h") < lo)
    if need > 0:
        last = global_rank(rows.where(F.col("_h") == lo), [id_col], out="_at")
        kept = kept.unionByName(last.where(F.col("_at") < need).drop("_at"))
    return kept.drop("_h")


def train_sample(df: DataFrame, id_col: str, nlist: int, per_list: int = 39, seed: str = "42") -> DataFrame:
    """SMP2: uniform sample without replacement of min(per_list * nlist, n) rows, in shuffled order."""
    return permute(least(df, id_col, per_list * nlist, seed), id_col, seed)


def cap(df: DataFrame, id_col: str, share: float, seed: str = "42") -> DataFrame:
    """SMP4: the first ``ceil(share * n)`` rows of the shuffled set, in order."""
    return permute(least(df, id_col, math.ceil(df.count() * share), seed), id_col, seed)


def cycle(requests: DataFrame, perm: DataFrame, nq: int, rid: str = "rid") -> DataFrame:
    """SMP5: request r uses the shuffled query at position r mod nq (queries
    recycled) - an equi-join on the computed position."""
    return requests.withColumn("perm_rank", F.pmod(F.col(rid), F.lit(nq))).join(perm, "perm_rank")
