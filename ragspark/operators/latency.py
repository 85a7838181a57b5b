"""Latency model over request logs (LAT1-9).

Per-batch-size means are a grouped aggregate; breaks are exact quantiles;
the continuous piecewise-linear fit reduces the data to hinge-feature sums
(X^T X, X^T y) with one distributed aggregate and solves the tiny system per
component in ``applyInPandas``; range fits are ``regr_slope``/``regr_intercept``.
Prediction is an interval join against the (config-sized, broadcast)
segments table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.stats import exact_percentiles
from ragspark.operators.asof import interval_join

_SEG_SCHEMA = "component string, seg int, start double, end double, slope double, intercept double"
COMPONENTS = {"search": ["ann_search"], "quantize": ["quantize"], "lut": ["lut_compute", "lut_scan"]}


def by_batch(requests: DataFrame, cols: Sequence[str], x: str = "batch_size") -> DataFrame:
    """LAT1: mean of each column per batch size (NaN already NULL)."""
    return requests.groupBy(x).agg(*[F.avg(c).alias(c) for c in cols])


def component_long(lat: DataFrame, x: str = "batch_size") -> DataFrame:
    """(x, component, y) with lut = lut_compute + lut_scan."""
    parts = []
    for comp, cols in COMPONENTS.items():
        y = F.col(cols[0])
        for c in cols[1:]:
            y = y + F.col(c)
        parts.append(lat.select(F.col(x).cast("double").alias("x"), F.lit(comp).alias("component"), y.alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def breaks(lat: DataFrame, x: str = "batch_size", sections: int = 4) -> list[float]:
    """LAT4: quantiles of x at 0, 1/s, ..., 1 plus {1, 2}, unique, sorted.
    (A handful of numbers: the result is needed to build the hinge basis.)"""
    ps = [i / sections for i in range(sections + 1)]
    q = exact_percentiles(lat.select(F.col(x).cast("double").alias("x")), [], "x", ps,
                          [f"q{i}" for i in range(len(ps))]).first()
    if q is None or q["q0"] is None:
        return []                                  # no sizes, no breaks
    vals = {float(q[f"q{i}"]) for i in range(len(ps))} | {1.0, 2.0}
    return sorted(vals)


def piecewise(lat: DataFrame, brks: Sequence[float], x: str = "batch_size") -> DataFrame:
    """LAT5: continuous piecewise-linear least squares with the given breaks,
    per component -> (component, seg, start, end, slope, intercept); no rows
    without two breaks at or above the smallest size."""
    long = component_long(lat, x)
    if len(brks) < 2:
        return long.sparkSession.createDataFrame([], _SEG_SCHEMA)
    # breaks below the smallest size have no data: their segments continue the first fitted line
    least = lat.agg(F.min(F.col(x).cast("double")).alias("m")).first()["m"]
    before = [float(b) for b in brks if least is not None and b < least]
    brks = [b for b in brks if b not in before]
    if len(brks) < 2:
        return long.sparkSession.createDataFrame([], _SEG_SCHEMA)
    interior = list(brks[1:-1])
    feats = [F.lit(1.0), F.col("x")] + [F.greatest(F.col("x") - F.lit(b), F.lit(0.0)) for b in interior]
    k = len(feats)
    aggs = []
    for i in range(k):
        for j in range(i, k):
            aggs.append(F.sum(feats[i] * feats[j]).alias(f"a_{i}_{j}"))
        aggs.append(F.sum(feats[i] * F.col("y")).alias(f"b_{i}"))
    sums = long.groupBy("component").agg(*aggs)
    bk = [float(b) for b in brks]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        A = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                A[i, j] = A[j, i] = row[f"a_{i}_{j}"]
        b = np.array([row[f"b_{i}"] for i in range(k)])
        theta = np.linalg.lstsq(A, b, rcond=None)[0]
        out = []
        for s, (lo, hi) in enumerate(zip(before, [*before[1:], bk[0]])):
            out.append((row["component"], s, lo, hi, float(theta[1]), float(theta[0])))
        for s in range(len(bk) - 1):
            slope = theta[1] + theta[2:2 + s].sum()
            f_at = theta[0] + theta[1] * bk[s] + sum(theta[2 + j] * max(bk[s] - interior[j], 0.0)
                                                     for j in range(len(interior)))
            out.append((row["component"], len(before) + s, bk[s], bk[s + 1], float(slope), float(f_at - slope * bk[s])))
        return pd.DataFrame(out, columns=["component", "seg", "start", "end", "slope", "intercept"])
    return sums.groupBy("component").applyInPandas(solve, _SEG_SCHEMA)


def range_fit(lat: DataFrame, width: int, x: str = "batch_size") -> DataFrame:
    """LAT6: an independent line per range [b, min(b + width - 1, largest size)],
    b = 1, 1 + width, ...; ranges without data are skipped.  The largest size
    is the data's own, so every batch size is covered."""
    long = component_long(lat, x).where(F.col("x") >= 1)
    top = F.broadcast(lat.agg(F.max(F.col(x).cast("double")).alias("_top")))       # one row
    long = long.withColumn("seg", F.floor((F.col("x") - 1) / width).cast("int"))
    g = long.groupBy("component", "seg").agg(F.regr_slope("y", "x").alias("slope"),
                                             F.regr_intercept("y", "x").alias("intercept"))
    start = F.col("seg") * width + 1
    return g.crossJoin(top).select("component", "seg", start.cast("double").alias("start"),
                                   F.least((start + width - 1).cast("double"), F.col("_top")).alias("end"), "slope", "intercept")


def predict(points: DataFrame, segments: DataFrame, rule: str = "closed_last", x: str = "batch_size") -> DataFrame:
    """LAT7: evaluate the segment containing x.  ``closed_last``: both ends
    inclusive, the later segment wins at a shared break (CPU tier);
    ``halfopen_first``: [start, end), first match wins (accelerated tier).
    Points without a segment get no row.  The lookup is a join on range cells,
    whatever the number of points and segments."""
    pts = points.select(x).distinct()
    closed = "both" if rule == "closed_last" else "left"
    j = interval_join(pts, segments, x, "start", "end", closed=closed)
    pick = F.max_by if rule == "closed_last" else F.min_by
    best = j.groupBy(x, "component").agg(pick(F.struct("slope", "intercept"), F.col("start")).alias("_s"))
    return best.select(x, "component", (F.col("_s.slope") * F.col(x) + F.col("_s.intercept")).alias("pred"))


def miss_scaled(points: DataFrame, cpu: DataFrame, gpu: DataFrame | None, hit: str = "hit_rate",
                x: str = "batch_size") -> DataFrame:
    """LAT8: lut x (1 - hit); search_1 = lut + quantize; with no miss the
    accelerated tier's search line applies (unchanged if no range covers x), or
    search_1 / 8 when no accelerated model exists;
    search_0 = the plain search line."""
    p = predict(points, cpu, "closed_last", x)
    wide = p.groupBy(x).pivot("component", ["search", "quantize", "lut"]).agg(F.first("pred"))
    out = points.join(wide, x, "left")
    miss = F.lit(1.0) - F.col(hit)
    out = (out.withColumn("lut_latency", F.col("lut") * miss)
           .withColumn("cq_latency", F.col("quantize"))
           .withColumn("search_0", F.col("search"))
           .withColumn("search_1", F.col("lut_latency") + F.col("cq_latency")))
    if gpu is not None:
        g = predict(points, gpu.where(F.col("component") == "search"), "halfopen_first", x) \
            .select(x, F.col("pred").alias("_gpu"))
        out = out.join(g, x, "left")
        # a fitted accelerated model without a matching range leaves search_1 as is
        out = out.withColumn("search_1", F.when(miss == 0, F.coalesce(F.col("_gpu"), F.col("search_1")))
                             .otherwise(F.col("search_1"))).drop("_gpu")
    else:
        out = out.withColumn("search_1", F.when(miss == 0, F.col("search_1") / F.lit(8.0)).otherwise(F.col("search_1")))
    return out.drop("search", "quantize", "lut")
