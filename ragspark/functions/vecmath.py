"""Vector expressions kept JVM-side (whole-stage codegen) and numpy helpers
used inside Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two float arrays, accumulated in DOUBLE."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, z: acc + z)


def sub(a: Column | str, b: Column | str) -> Column:
    """Element-wise difference a - b as float array (residual)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.zip_with(a, b, lambda x, y: (x - y).cast("float"))


def to_matrix(arr: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list<float> column -> 2-D float64 matrix (rows of equal length)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float64)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def smallest(d: np.ndarray, ids: np.ndarray, k: int, slack: np.ndarray | None = None,
             exact=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k columns of least (distance, id) in each row of ``d`` (n x m), ties
    included: flat (row, id, distance), sorted by row, distance, id.

    All columns at the k-th distance (plus ``slack`` per row, where ``d`` is only
    approximate) stay candidates until they are ordered; ``exact(rows, cols)``
    then gives the distances that decide."""
    n, m = d.shape
    if n == 0 or m == 0 or k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    kth = np.partition(d, min(k, m) - 1, axis=1)[:, min(k, m) - 1]
    rows, cols = np.nonzero(d <= (kth if slack is None else kth + slack)[:, None])
    dist = d[rows, cols] if exact is None else exact(rows, cols)
    order = np.lexsort((ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[cols[keep]], dist[keep]


def nearest_rows(x: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of ``r`` nearest to each row of ``x`` by (exact distance, id).
    The matrix product only selects; survivors are measured by differences."""
    d = pairwise_l2sq(x, r)
    size = np.einsum("ij,ij->i", x, x) + (np.einsum("ij,ij->i", r, r).max() if len(r) else 0.0)
    return smallest(d, ids, k, slack=1e-12 * size * max(1, x.shape[1]), exact=lambda i, j: exact_pairs(x, i, r, j))


def pairwise_l2sq(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """|x_i - r_j|^2 for all i, j via one matrix product (ordering only)."""
    xx = np.einsum("ij,ij->i", x, x)[:, None]
    rr = np.einsum("ij,ij->i", r, r)[None, :]
    d = xx + rr - 2.0 * (x @ r.T)
    np.maximum(d, 0.0, out=d)
    return d


def exact_l2sq(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Row-wise |x_i - r_i|^2 for matching rows (exact reported distance)."""
    diff = x - r
    return np.einsum("ij,ij->i", diff, diff)


_PAIR_ELEMS = 1_000_000     # vector components gathered at a time on each side (8 MB)


def exact_pairs(x: np.ndarray, i: np.ndarray, r: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_l2sq`` of the rows ``x[i]`` and ``r[j]``; any number of pairs in
    bounded memory, because their vectors are gathered a block at a time."""
    out = np.empty(len(i))
    step = max(1, _PAIR_ELEMS // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        out[s:s + step] = exact_l2sq(x[i[s:s + step]], r[j[s:s + step]])
    return out


_STEP_ELEMS = 1_000_000     # distances measured at a time (8 MB, so the passes over them stay in cache)


class Best:
    """The k nearest rows of n queries over any number of row sets, by (exact
    distance, id): a query's k-th distance so far bounds what a further set can add,
    so candidates are few and a cell holds about ``held`` of them at most."""

    def __init__(self, q: np.ndarray, k: int, held: int = 1_000_000):
        self.q, self.k, self.held = q, k, held
        self.size = np.einsum("ij,ij->i", q, q)
        self.bound = np.full(len(q), np.inf)
        self.found, self.n = [], 0

    def add(self, at: np.ndarray, x: np.ndarray, ids: np.ndarray, tag: int = 0) -> None:
        """Measure the queries ``at`` (a query may be named again) to the rows ``x``,
        whose ``tag`` comes back with them."""
        if not len(x) or self.k <= 0:
            return
        most = np.einsum("ij,ij->i", x, x).max()
        step = max(1, _STEP_ELEMS // len(x))
        for s in range(0, len(at), step):
            rows = at[s:s + step]
            part, bound = self.q[rows], self.bound[rows]
            d = pairwise_l2sq(part, x)
            first = np.isinf(bound)
            if len(x) > self.k and first.any():
                bound[first] = np.partition(d[first], self.k - 1, axis=1)[:, self.k - 1]
            slack = 1e-12 * (self.size[rows] + most) * max(1, x.shape[1])
            i, j = np.nonzero(d <= (bound + slack)[:, None])
            if len(i):
                self.found.append((rows[i], ids[j], exact_pairs(part, i, x, j), np.full(len(i), tag)))
                self.n += len(i)
            if self.n > self.held:
                self._settle()

    def _settle(self) -> None:
        rows, ids, dist, tags = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((ids, dist, rows))
        rows, ids, dist, tags = rows[order], ids[order], dist[order], tags[order]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = at < self.k
        self.bound[rows[at == self.k - 1]] = dist[at == self.k - 1]
        self.found, self.n = [(rows[keep], ids[keep], dist[keep], tags[keep])], 0       # what is kept is at most k a query

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``q``, id, distance, tag), sorted; at most k a query."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self._settle()
        return self.found[0]
