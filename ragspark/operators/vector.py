"""Exact vector operators: distances, nearest reference rows, exact kNN,
top-k merge.

* ``nearest``  - every *base* row gets its k nearest *reference* rows
  (assignment: vectors vs centroids; probing: queries vs centroids).  A
  reference side under the broadcast cap (its size is measured first) is
  broadcast, and the kernel output is final without a shuffle.
* ``exact_knn`` - every *query* gets its k nearest base rows.  Both sides may
  be data-sized: they are dealt into blocks, and each (query block, base
  block) cell is one cogroup of bounded size on the executors.  ``nearest``
  takes the same grid for a reference side beyond the cap.

A cell or kernel emits at most k rows per query, never all pairs; ties go to
the smaller id whatever the block layout, because every candidate at the k-th
distance is kept until distances, measured exactly, and ids have decided.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import sizing
from ragspark.functions.vecmath import exact_pairs, l2sq, nearest_rows, pairwise_l2sq, sub, to_matrix

_CHUNK_ELEMS = 4_000_000  # distance-matrix cells per numpy step (~32 MB)


def vector_dim(df: DataFrame, vec_col: str) -> int:
    row = df.select(F.size(vec_col).alias("d")).where(F.col("d") > 0).first()
    return int(row["d"]) if row else 0


def ref_matrix(ref: DataFrame, ref_id: str, ref_vec: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The reference side as (ids, matrix) if it is under the broadcast cap
    (measured by one job), else None: it then stays on the executors."""
    stats = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(ref_vec)).alias("d")).first()
    if not sizing.fits(ref.sparkSession, int(stats["n"]), max(1, int(stats["d"] or 0)) * 8 + 8):
        return None
    tbl = ref.select(ref_id, ref_vec).toArrow()
    return tbl.column(0).to_numpy(zero_copy_only=False).astype(np.int64), to_matrix(tbl.column(1))


_NEAR = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_v", T.LongType()),
                      T.StructField("_d", T.DoubleType())])


def _steps(n: int, m: int):
    step = max(1, _CHUNK_ELEMS // max(1, m))
    return ((s, min(n, s + step)) for s in range(0, n, step))


def _near_table(q_ids, q, ids, x, k: int, of=pa.RecordBatch):
    """(_q, _v, _d) of the k nearest rows of ``x`` for each row of ``q``."""
    got = [(q_ids[s:t], *nearest_rows(q[s:t], x, ids, k)) for s, t in _steps(len(q_ids), len(ids))]
    cols = [np.concatenate([own[r] for own, r, _, _ in got]) if got else np.empty(0, np.int64),
            np.concatenate([v for _, _, v, _ in got]) if got else np.empty(0, np.int64),
            np.concatenate([d for _, _, _, d in got]) if got else np.empty(0)]
    return of.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                          names=["_q", "_v", "_d"])


def _ids(table, col) -> np.ndarray:
    return table.column(col).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(table, pa.RecordBatch) \
        else table.column(col).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _grid(queries: DataFrame, q_id: str, q_vec: str, items: DataFrame, i_id: str, i_vec: str, k: int) -> DataFrame:
    """At most k (_q, _v, _d) per query and cell, both sides dealt into blocks
    of about the kernel's block size (at least one item block per core)."""
    spark = queries.sparkSession
    dim = vector_dim(items, i_vec)
    rows = max(1, sizing.block_bytes(spark) // (max(1, dim) * 16))
    nq = max(1, math.ceil(queries.count() / rows))
    ni = max(spark.sparkContext.defaultParallelism, math.ceil(items.count() / rows))
    left = (queries.select(F.col(q_id).cast("bigint").alias("_id"), F.col(q_vec).alias("_x"))
            .withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(nq)).cast("int"))
            .withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(ni - 1)))))
    right = (items.select(F.col(i_id).cast("bigint").alias("_id"), F.col(i_vec).alias("_x"))
             .withColumn("_ib", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(ni)).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))

    def cell(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.Table.from_batches([], pa.schema([("_q", pa.int64()), ("_v", pa.int64()), ("_d", pa.float64())]))
        return _near_table(_ids(q, "_id"), to_matrix(q.column("_x")), _ids(x, "_id"), to_matrix(x.column("_x")), k, pa.Table)
    return left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInArrow(cell, _NEAR)


def nearest(base: DataFrame, ref: DataFrame, k: int, *, base_id: str, base_vec: str,
            ref_id: str, ref_vec: str, out_base: str, out_ref: str,
            out_rank: str = "rank", out_dist: str = "dist", matrix=None) -> DataFrame:
    """For each base row, its k nearest reference rows (ties by reference id).
    ``matrix`` (from ``ref_matrix``) reuses a reference that was measured before."""
    matrix = matrix if matrix is not None else ref_matrix(ref, ref_id, ref_vec)
    if matrix is None:
        near = merge_topk(_grid(base, base_id, base_vec, ref, ref_id, ref_vec, k).toDF("_b", "_r", "_d"), k,
                          key="_b", item="_r", dist="_d", out_rank="_rank")
    else:
        bc = base.sparkSession.sparkContext.broadcast(matrix)

        def run(batches):
            ids, mat = bc.value
            for b in batches:
                if b.num_rows and len(ids):
                    t = _near_table(_ids(b, 0), to_matrix(b.column(1)), ids, mat, k)
                    at = np.arange(t.num_rows) % min(k, len(ids))        # every base row has as many
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(at, pa.int64())], names=["_b", "_r", "_d", "_rank"])
        near = base.select(base_id, base_vec).mapInArrow(run, "_b bigint, _r bigint, _d double, _rank bigint")
    return near.select(F.col("_b").alias(out_base), F.col("_r").alias(out_ref),
                       F.col("_rank").alias(out_rank), F.col("_d").alias(out_dist))


def assign_carrying(vectors: DataFrame, centroids: DataFrame, matrix=None) -> DataFrame:
    """VEC5 and VEC7 in one pass: (vec_id, list_id, dist, embedding, res), every
    vector with its nearest list and its residual to that list's centroid (float
    arithmetic).  Beyond the broadcast cap both are joined back by key."""
    matrix = matrix if matrix is not None else ref_matrix(centroids, "list_id", "centroid")
    if matrix is None:
        near = nearest(vectors, centroids, 1, base_id="vec_id", base_vec="embedding", ref_id="list_id",
                       ref_vec="centroid", out_base="vec_id", out_ref="list_id").drop("rank")
        both = near.join(vectors.select("vec_id", "embedding"), "vec_id").join(centroids.select("list_id", "centroid"), "list_id")
        return both.select("vec_id", "list_id", "dist", "embedding", sub("embedding", "centroid").alias("res"))
    bc = vectors.sparkSession.sparkContext.broadcast(matrix)
    kind = pa.list_(pa.float32())

    def run(batches):
        ids, mat = bc.value
        order = np.argsort(ids)
        for b in batches:
            if b.num_rows and len(ids):
                own, x = _ids(b, 0), to_matrix(b.column(1))
                t = _near_table(np.arange(len(own)), x, ids, mat, 1)     # one row each, in order
                near = t.column(1).to_numpy()
                at = order[np.searchsorted(ids, near, sorter=order)]
                res = x.astype(np.float32) - mat[at].astype(np.float32)
                ends = pa.array(np.arange(0, res.size + 1, res.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), t.column(1), t.column(2), b.column(1).cast(kind),
                     pa.ListArray.from_arrays(ends, pa.array(res.ravel()))],
                    names=["vec_id", "list_id", "dist", "embedding", "res"])
    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "vec_id bigint, list_id bigint, dist double, embedding array<float>, res array<float>")


def within(base: DataFrame, ref: DataFrame, *, base_id: str, base_vec: str, radius: str, ref_id: str, ref_vec: str,
           matrix=None) -> DataFrame:
    """(base_id, ref_id, dist): the reference rows at most ``radius`` (a column of
    ``base``, Euclidean) away; ``dist`` is the squared distance."""
    spark = base.sparkSession
    matrix = matrix if matrix is not None else ref_matrix(ref, ref_id, ref_vec)

    def near(q_ids, q, r, ids, x, of):
        got = []
        for s, t in _steps(len(q_ids), len(ids)):
            d = pairwise_l2sq(q[s:t], x)
            most = r[s:t] * r[s:t]
            slack = 1e-9 * (1.0 + np.einsum("ij,ij->i", q[s:t], q[s:t]) + np.einsum("ij,ij->i", x, x).max())
            i, j = np.nonzero(d <= (most + slack)[:, None])
            exact = exact_pairs(q[s:t], i, x, j)
            keep = np.sqrt(exact) <= r[s:t][i]
            got.append((q_ids[s:t][i[keep]], ids[j[keep]], exact[keep]))
        cols = [np.concatenate([g[c] for g in got]) if got else np.empty(0) for c in range(3)]
        return of.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)),
                               pa.array(cols[2].astype(np.float64))], names=["_q", "_v", "_d"])
    rows = base.select(F.col(base_id).cast("bigint").alias("_id"), F.col(base_vec).alias("_x"),
                       F.col(radius).cast("double").alias("_r"))
    if matrix is not None:
        bc = spark.sparkContext.broadcast(matrix)

        def run(batches):
            ids, mat = bc.value
            for b in batches:
                if b.num_rows and len(ids):
                    yield near(_ids(b, 0), to_matrix(b.column(1)), b.column(2).to_numpy(), ids, mat, pa.RecordBatch)
        out = rows.mapInArrow(run, _NEAR)
    else:
        dim = max(1, vector_dim(ref, ref_vec))
        block = max(1, sizing.block_bytes(spark) // (dim * 16))
        nq, ni = max(1, math.ceil(base.count() / block)), max(1, math.ceil(ref.count() / block))
        left = rows.withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(nq))).withColumn(
            "_ib", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
        right = ref.select(F.col(ref_id).cast("bigint").alias("_id"), F.col(ref_vec).alias("_x")).withColumn(
            "_ib", F.pmod(F.xxhash64("_id"), F.lit(ni)).cast("int")).withColumn(
            "_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

        def cell(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return pa.Table.from_batches([], pa.schema([("_q", pa.int64()), ("_v", pa.int64()), ("_d", pa.float64())]))
            radius_ = q.column("_r").combine_chunks().to_numpy(zero_copy_only=False)
            return near(_ids(q, "_id"), to_matrix(q.column("_x")), radius_, _ids(x, "_id"), to_matrix(x.column("_x")), pa.Table)
        out = left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInArrow(cell, _NEAR)
    return out.select(F.col("_q").alias(base_id), F.col("_v").alias(ref_id), F.col("_d").alias("dist"))


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id",
              vec_col: str = "embedding", qid: str = "qid", q_col: str = "embedding") -> DataFrame:
    """VEC2: exact top-k base vectors per query -> (qid, rank, vec_id, dist)."""
    return merge_topk(_grid(queries, qid, q_col, vectors, vec_id, vec_col, k).toDF("qid", "vec_id", "dist"), k)


def merge_topk(candidates: DataFrame, k: int, *, key: str = "qid", item: str = "vec_id",
               dist: str = "dist", out_rank: str = "rank") -> DataFrame:
    """VEC13: k smallest distances per key over candidate rows from any number
    of shards; pad rows (item = -1 or infinite distance) are dropped.  Ties go
    to the smaller item id.  Planned as WindowGroupLimit (partial) + shuffle
    by key + final row_number filter."""
    c = candidates.where((F.col(item) >= 0) & F.col(dist).isNotNull() & (F.col(dist) < float("inf")))
    w = Window.partitionBy(key).orderBy(F.col(dist), F.col(item))
    return (c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .withColumn(out_rank, (F.col("_rn") - 1).cast("bigint")).drop("_rn"))


def pair_distance(left: DataFrame, right: DataFrame, on: str, lcol: str, rcol: str) -> DataFrame:
    """VEC1: squared L2 between matched rows, computed JVM-side in DOUBLE."""
    return left.join(right, on).withColumn("dist", l2sq(lcol, rcol))
