"""Exact top-k inner products by norm buckets.

Vectors are sorted by length (norm) and cut into buckets of about equal
length.  A query's k-th best score so far, divided by the query's length and a
bucket's largest length, is the least cosine that a vector of the bucket needs:
above 1 the bucket is skipped; when it is high, the query's largest coordinate
bounds the same coordinate of any vector that can qualify (coordinate pruning);
else only the bucket's longer vectors qualify (length pruning).  What is left
is verified by exact products.

On the cluster, the sorted vectors are dealt into slabs of buckets and the
queries into blocks; each (block, slab) pair that can still hold a result is
one group.  A first round over the slab of longest vectors gives each query a
starting bound, and the bounds decide which later slabs its block needs.  A
group sends on at most k rows per query; nothing of unbounded size is in one
task or on the driver: a slab's largest length and the least length a block
needs are rows of a table, whose running count tells how many slabs each block
reaches.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part; of rows with one id, the vector with the smallest bytes counts,
so repeated rows count once and a row is never its own candidate; a null id
takes no part; shorter vectors are padded with zeros; scaled components are
whole numbers of any size (one that overflows a double counts as non-finite)
and products are exact, but a score beyond 64 bits is held to +-(2^63 - 1);
ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions.ranks import global_rank, prefix_sum, snapshot

BUCKET = 1024             # vectors of about one length
SLAB = 8 * BUCKET         # vectors of one group
BLOCK = 20 * BUCKET       # ranks whose queries share a block
COORDINATE_FROM = 0.5     # least cosine from which coordinates prune
_MOST = 2 ** 63 - 1
_LARGEST = np.finfo(float).max


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as little-endian int32 if all fit, else as doubles; the last byte tells the width."""
    if len(x) and np.abs(x).max() >= 2 ** 31:
        return x.astype("<f8").tobytes() + b"\x08"
    return x.astype("<i4").tobytes() + b"\x04"


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f8" if b[-1] == 8 else "<i4", count=len(b) // b[-1])


def _norms(x: np.ndarray) -> np.ndarray:
    """Length of each row, without overflow."""
    top = np.abs(x).max(1, initial=1.0)
    with np.errstate(over="ignore"):
        return np.minimum(np.sqrt(np.square(x / top[:, None]).sum(1)) * top, _LARGEST)


def integers(table: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, v, norm): floor(scale * x) as packed bytes; one row per id."""
    def run(batches):
        for b in batches:
            ids, out, norms = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.asarray(v, np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                out.append(_packed(x))
                norms.append(float(_norms(x[None, :])[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())],
                names=["vec_id", "v", "norm"])
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), vec_col).mapInArrow(
        run, "vec_id bigint, v binary, norm double")
    # rows of one id with one norm are rare: the smallest bytes of the id count
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("m")).select("vec_id", "m.v", "m.norm")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column.to_pylist()):
        x = _unpacked(x)
        out[i, :len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles for pairs whose sums stay below 2^53, int64
    while they stay below 2^62, else integers of any size held to 64 bits."""
    long_a, long_b = _norms(a), _norms(b)
    with np.errstate(over="ignore", invalid="ignore"):
        top = long_a.max(initial=0.0) * long_b.max(initial=0.0)
        if top < 2.0 ** 52:
            return (a @ b.T).astype(np.int64)
        if max(top, long_a.max(), long_b.max()) < 2.0 ** 62:
            return a.astype(np.int64) @ b.astype(np.int64).T
        wide = np.multiply.outer(long_a, long_b) >= 2.0 ** 52
        out = np.where(wide, 0, a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    for i in np.nonzero(wide.any(1))[0]:
        at = np.nonzero(wide[i])[0]
        exact = whole(b[at]) @ whole(a[i])
        out[i, at] = [max(-_MOST, min(_MOST, x)) for x in exact]
    return out


def _best(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int):
    """The k best (score, smaller id) of each row of flat candidates."""
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    first = np.searchsorted(row, row)                    # where each row's candidates begin
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], vec[keep]


class _Search:
    """Top-k of a block of queries over buckets given longest first."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int):
        self.q, self.ids, self.k = q, q_ids, k
        self.norm = _norms(q)
        self.unit = q / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(self.unit).argmax(1) if q.shape[1] else np.zeros(len(q), int)
        self.bound = bound.astype(float)                 # at least the k-th best score, -inf if unknown
        self.row, self.score, self.vec = (np.empty(0, np.int64) for _ in range(3))
        self.verified = 0

    def bucket(self, v: np.ndarray, v_ids: np.ndarray) -> None:
        norm = _norms(v)                                 # descending
        longest = norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.norm > 0, self.bound / self.norm, np.where(self.bound > 0, np.inf, -np.inf))
            cosine = np.where(need > 0, need / longest, -1.0) if longest > 0 else np.where(need > 0, np.inf, -1.0)
        slack = 1e-9
        by_coordinate = (cosine >= COORDINATE_FROM) & (cosine <= 1 + slack)
        by_length = np.nonzero(cosine < COORDINATE_FROM)[0]
        rows, scores, vecs = [self.row], [self.score], [self.vec]
        if len(by_length):
            reach = int((norm >= need[by_length].min() * (1 - slack)).sum()) if need[by_length].min() > 0 else len(v)
            s = _products(self.q[by_length], v[:reach])
            self.verified += s.size
            self._take(rows, scores, vecs, by_length, s, v_ids[:reach])
        if by_coordinate.any():
            unit = v / np.maximum(norm, 1e-300)[:, None]
            for i in np.nonzero(by_coordinate)[0]:
                c, f = min(cosine[i], 1.0), self.focus[i]
                mid, side = self.unit[i, f] * c, np.sqrt(max(0.0, (1 - c * c) * (1 - self.unit[i, f] ** 2)))
                low, high = mid - side, mid + side
                # beyond the cap's own edge larger cosines reach the coordinate itself
                low, high = min(low, self.unit[i, f]) - 1e-6, max(high, self.unit[i, f]) + 1e-6
                if self.unit[i, f] >= c:
                    high = 1.0 + 1e-6
                if -self.unit[i, f] >= c:
                    low = -1.0 - 1e-6
                at = np.nonzero((unit[:, f] >= low) & (unit[:, f] <= high) & (norm >= need[i] * (1 - slack)))[0]
                if len(at):
                    s = _products(self.q[i:i + 1], v[at])
                    self.verified += s.size
                    self._take(rows, scores, vecs, np.array([i]), s, v_ids[at])
        if len(rows) > 1:
            self.row, self.score, self.vec = _best(np.concatenate(rows), np.concatenate(scores), np.concatenate(vecs), self.k)
            n = np.bincount(self.row, minlength=len(self.q))
            last = np.cumsum(n) - 1
            full = n >= self.k
            self.bound[full] = np.maximum(self.bound[full], self.score[last[full]])

    def _take(self, rows, scores, vecs, which, s, v_ids) -> None:
        """Candidates at or above the bound and among the k best of this bucket, ties included."""
        floor = self.bound[which].copy()
        if s.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(s, s.shape[1] - self.k - 1, axis=1)[:, -self.k - 1])
        r, c = np.nonzero((s >= floor[:, None]) & (v_ids[None, :] != self.ids[which][:, None]))
        rows.append(which[r])
        scores.append(s[r, c])
        vecs.append(v_ids[c])


def _kernel(k: int):
    def run(group: pa.Table) -> pa.Table:
        """One (block, slab): queries have a bound, vectors none."""
        group = group.combine_chunks()
        is_q = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        queries, vectors = group.filter(pa.array(is_q)), group.filter(pa.array(~is_q)).sort_by("rank")
        dim = max((len(x) // x[-1] for x in group.column("v").to_pylist()), default=0)
        ids = queries.column("vec_id").to_numpy()
        found = _Search(_matrix(queries.column("v"), dim), ids,
                        queries.column("bound").to_numpy(zero_copy_only=False).astype(float), k)
        v, v_ids = _matrix(vectors.column("v"), dim), vectors.column("vec_id").to_numpy()
        for at in range(0, len(v) if len(ids) else 0, BUCKET):
            found.bucket(v[at:at + BUCKET], v_ids[at:at + BUCKET])
        return pa.table({"query_id": pa.array(ids[found.row], pa.int64()), "vec_id": pa.array(found.vec, pa.int64()),
                         "score": pa.array(found.score, pa.int64())})
    return run


_OUT = "query_id bigint, vec_id bigint, score bigint"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Search every (block, slab) group of rows with those two columns."""
    cols = ["block", "slab", "is_query", "vec_id", "rank", "v", "bound"]
    both = queries.withColumn("is_query", F.lit(True)).select(*cols).unionByName(
        vectors.withColumn("is_query", F.lit(False)).withColumn("bound", F.lit(None).cast("double")).select(*cols))
    return both.groupBy("block", "slab").applyInArrow(_kernel(k), _OUT)


def _reach(slabs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, last): the last slab, from 1 on, whose longest vector (slab, m; falling)
    is as long as a block's queries need (block, m)."""
    none = F.lit(None).cast("int")
    need = F.when(F.col("m") > 0, F.col("m") * (1 - 1e-9)).otherwise(F.lit(-1.0))
    both = slabs.select(none.alias("block"), "m", F.lit(1).cast("bigint").alias("one")).unionByName(
        blocks.select("block", need.alias("m"), F.lit(0).cast("bigint").alias("one")))
    counted = prefix_sum(both, [F.col("m").desc(), F.col("one").desc(), "block"], "one", "reached")
    return counted.where("block is not null and reached > 1").select("block", (F.col("reached") - 1).cast("int").alias("last"))


def top_k(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows.

    ``is_query`` is a condition on ``vec_id``."""
    rows = global_rank(integers(table, id_col, vec_col, scale), [F.col("norm").desc(), "vec_id"], out="rank")
    rows = snapshot(rows.withColumn("slab", F.floor(F.col("rank") / SLAB).cast("int"))
                    .withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int")), "norm-buckets")
    n = rows.count()
    n_blocks = (n + BLOCK - 1) // BLOCK
    queries = rows.where(is_query)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))))
    unknown = F.lit(float("-inf"))
    first = _pairs(queries.withColumn("bound", unknown).withColumn("slab", F.lit(0)),
                   rows.where("slab = 0").withColumn("block", blocks), k)
    first = snapshot(first, "norm-first")
    if n <= SLAB:
        return _out(_ranked(first, k))
    bounds = first.groupBy("query_id").agg(F.min("score").alias("b"), F.count(F.lit(1)).alias("n"))
    queries = queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left").withColumn(
        "bound", F.when(F.col("n") >= k, F.col("b").cast("double")).otherwise(unknown)).drop("query_id", "b", "n")
    queries = snapshot(queries, "norm-queries")
    # the shortest vector that may still matter to some query of a block
    need = F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(
        F.when(F.col("bound") > 0, F.lit(float("inf"))).otherwise(unknown))
    reach = _reach(rows.groupBy("slab").agg(F.max("norm").alias("m")), queries.groupBy("block").agg(F.min(need).alias("m")))
    pairs = snapshot(reach.select("block", F.explode(F.sequence(F.lit(1), "last")).alias("slab")), "norm-reach")
    later_q = queries.drop("slab").join(pairs, "block")
    later_v = rows.drop("block").join(pairs, "slab")
    return _out(_ranked(first.unionByName(_pairs(later_q, later_v, k)), k))


def _out(d: DataFrame) -> DataFrame:
    return d.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
