"""Interval lookups as equi-joins (LAT7, HIT10).

An interval of length l lies in at most two cells of width 2^ceil(log2 l).  It
is filed under those cells; a point looks into its own cell of every width
that occurs (a handful).  So points meet only intervals of their own
neighbourhood, by an ordinary hash or merge join on (keys, width, cell) that
Spark may broadcast, shuffle or split by skew; neither side is collected and
nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST = -40         # the narrowest cells: 2^-40


def _width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def interval_join(points: DataFrame, intervals: DataFrame, x: str, start: str, end: str, *, keys: Sequence[str] = (),
                  closed: str = "both", how: str = "inner") -> DataFrame:
    """Every row of ``points`` with the intervals that contain its ``x`` (and
    equal its ``keys``).  ``closed``: ``both``, ``left`` [start, end) or ``right``
    (start, end].  Ends are finite; an interval with a NULL end holds nothing."""
    lo, hi = F.col(start).cast("double"), F.col(end).cast("double")
    filed = intervals.where(lo <= hi).withColumn(
        "_level", F.greatest(F.ceil(F.log2(F.greatest(hi - lo, _width(F.lit(_LEAST))))), F.lit(_LEAST)).cast("int"))
    levels = [r[0] for r in filed.select("_level").distinct().collect()]       # at most the exponents of a double
    width = _width(F.col("_level"))
    filed = filed.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(lo / width), F.floor(hi / width)))))
    own = [c for c in filed.columns if c not in keys]
    filed = filed.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *own)
    v = F.col(x).cast("double")
    look = points.withColumn("_pl", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    look = look.withColumn("_pc", F.floor(v / _width(F.col("_pl"))))
    cond = (F.col("_pl") == F.col("_level")) & (F.col("_pc") == F.col("_cell"))
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    cond = cond & (v >= lo if closed in ("both", "left") else v > lo) & (v <= hi if closed in ("both", "right") else v < hi)
    return look.join(filed, cond, how).drop("_pl", "_pc", "_level", "_cell", *[f"_k_{c}" for c in keys])
