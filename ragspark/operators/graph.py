"""Coarse probing by a layered neighbour graph over the centroids (VEC6).

Layer 0 holds every centroid, each higher layer about one in ``FAN`` of the
layer below, chosen by hash.  In a layer every node is linked to its
``degree`` nearest nodes, found by the exact blocked search, and to the nodes
that chose it, of which the nearest ``2 * degree`` links stay.  Layers and
links are tables; a node of the highest layer is the entry.

A query walks each upper layer to its nearest node and then searches layer 0
with a beam of ``width * nprobe`` nodes: the nearest node not yet expanded is
expanded until the beam holds no such node.  Batches of queries walk together,
one expansion a step, so a task holds its batch's visited marks and beams next
to the graph.  The graph is broadcast behind a measured size; beyond the cap
the probes are exact (``vector.nearest`` over blocks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import sizing
from ragspark.functions.ranks import snapshot
from ragspark.functions.vecmath import to_matrix
from ragspark.operators import vector as V

FAN = 16
DEGREE = 16
_MARKS = 32_000_000      # visited marks of a batch of queries, a byte each


def build(centroids: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(layer, node, peer, dist): links of all layers, both ways."""
    spark = centroids.sparkSession
    node = centroids.select("list_id", "centroid", F.xxhash64("list_id", F.lit(7)).alias("_h"))
    node = snapshot(node, "graph-nodes")
    out, layer, here = None, 0, node
    n = here.count()
    while n > 0:
        near = V.nearest(here, here, degree + 1, base_id="list_id", base_vec="centroid", ref_id="list_id",
                         ref_vec="centroid", out_base="node", out_ref="peer")
        near = near.where(F.col("node") != F.col("peer")).select("node", "peer", "dist")
        both = near.unionByName(near.select(F.col("peer").alias("node"), F.col("node").alias("peer"), "dist")).distinct()
        best = F.row_number().over(Window.partitionBy("node").orderBy("dist", "peer"))
        links = both.withColumn("_rn", best).where(F.col("_rn") <= 2 * degree).drop("_rn")
        # a layer of one node has no links: the node alone marks it
        alone = here.select(F.col("list_id").alias("node"), F.lit(None).cast("bigint").alias("peer"),
                            F.lit(None).cast("double").alias("dist"))
        links = links.unionByName(alone).withColumn("layer", F.lit(layer)).select("layer", "node", "peer", "dist")
        out = links if out is None else out.unionByName(links)
        layer += 1
        here = node.where(F.pmod("_h", F.lit(FAN ** layer)) == 0)
        n = here.count()
    if out is None:
        return spark.createDataFrame([], "layer int, node bigint, peer bigint, dist double")
    return snapshot(out, "graph-links")


def _arrays(centroids: DataFrame, links: DataFrame):
    """Node ids, vectors and, per layer, padded rows of neighbours (by index)."""
    t = centroids.orderBy("list_id").select("list_id", "centroid").toArrow()
    ids, mat = t.column(0).to_numpy(zero_copy_only=False).astype(np.int64), to_matrix(t.column(1))
    e = links.orderBy("layer", "node", "dist", "peer").toArrow()
    layer, node = e.column("layer").to_numpy(), np.searchsorted(ids, e.column("node").to_numpy())
    some = ~e.column("peer").is_null().to_numpy()
    peer = np.searchsorted(ids, e.column("peer").fill_null(int(ids[0]) if len(ids) else 0).to_numpy())
    layers = []
    for y in range(int(layer.max()) + 1 if len(layer) else 0):
        here = np.unique(node[layer == y])
        pick = (layer == y) & some
        a, b = node[pick], peer[pick]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        table = np.full((len(ids), int(rank.max()) + 1 if len(a) else 1), -1, np.int32)
        table[a, rank] = b
        layers.append((here, table))
    return ids, mat, layers


def _beam(q: np.ndarray, mat: np.ndarray, table: np.ndarray, start: np.ndarray, width: int):
    """(nodes, distances) of the ``width`` best nodes reached, per query, nearest first (-1: none)."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(mat)), bool)
    nodes = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf)
    done = np.ones((n, width), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((q - mat[start]) ** 2).sum(axis=1)
    seen[rows[:, 0], start] = True
    live = np.arange(n)
    while len(live):
        at = np.where(done[live], np.inf, dist[live]).argmin(axis=1)
        here = nodes[live, at]
        done[live, at] = True
        peers = table[here].astype(np.int64)
        new = (peers >= 0) & ~seen[live[:, None], peers]
        i, j = np.nonzero(new)
        seen[live[i], peers[i, j]] = True
        d = np.full(peers.shape, np.inf)
        d[i, j] = ((q[live[i]] - mat[peers[i, j]]) ** 2).sum(axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_n = np.concatenate([nodes[live], np.where(new, peers, -1)], axis=1)
        all_f = np.concatenate([done[live], ~new], axis=1)
        best = np.lexsort((all_n, all_d), axis=1)[:, :width]
        dist[live] = np.take_along_axis(all_d, best, 1)
        nodes[live] = np.take_along_axis(all_n, best, 1)
        done[live] = np.take_along_axis(all_f, best, 1)
        live = live[~done[live].all(axis=1)]
    return nodes, dist


def walk(q: np.ndarray, graph, width: int):
    """Beam search of a batch of queries through all layers."""
    ids, mat, layers = graph
    start = np.full(len(q), layers[-1][0][0])
    for here, table in reversed(layers[1:]):
        start = _beam(q, mat, table, start, 1)[0][:, 0]
    return _beam(q, mat, layers[0][1], start, min(width, len(ids)))


def probe(queries: DataFrame, centroids: DataFrame, links: DataFrame, nprobe: int, width: float = 1.5) -> DataFrame:
    """(qid, probe_rank, list_id, cdist): about the ``nprobe`` nearest lists."""
    spark = queries.sparkSession
    n, dim = centroids.count(), V.vector_dim(centroids, "centroid")
    n_links = links.count()
    if not sizing.fits(spark, 1, n * (dim * 8 + 8) + n_links * 16):
        return V.nearest(queries, centroids, nprobe, base_id="qid", base_vec="embedding", ref_id="list_id",
                         ref_vec="centroid", out_base="qid", out_ref="list_id", out_rank="probe_rank", out_dist="cdist")
    bc = spark.sparkContext.broadcast(_arrays(centroids, links))
    beam = max(nprobe, int(np.ceil(width * nprobe)))

    def run(batches):
        graph = bc.value
        ids = graph[0]
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            qid, q = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), to_matrix(b.column(1))
            step = max(1, _MARKS // len(ids))
            for s in range(0, len(q), step):
                nodes, dist = (x[:, :nprobe] for x in walk(q[s:s + step], graph, beam))
                i, j = np.nonzero(nodes >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[s:s + step][i]), pa.array(j.astype(np.int64)), pa.array(ids[nodes[i, j]]), pa.array(dist[i, j])],
                    names=["qid", "probe_rank", "list_id", "cdist"])
    return queries.select("qid", "embedding").mapInArrow(run, "qid bigint, probe_rank bigint, list_id bigint, cdist double")
