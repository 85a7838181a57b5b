"""Vector kernels against numpy brute force; blocked and salted plans equal
the single-block ones."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragspark.functions import sizing, vecmath
from ragspark.operators import quantize as QZ
from ragspark.operators import search as S
from ragspark.operators import vector as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    vecs = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id bigint, embedding array<float>")
    qs = vecs.where(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    cent = vecs.where(F.col("vec_id") < 12).select(F.col("vec_id").alias("list_id"), F.col("embedding").alias("centroid"))
    return x, vecs, qs, cent


def brute(x, qids, k):
    out = {}
    for q in qids:
        d = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(x)), d))[:k]
        out[q] = list(order)
    return out


def test_exact_knn_vs_numpy(spark, data):
    x, vecs, qs, _ = data
    res = V.exact_knn(vecs, qs, 5)
    got = {}
    for r in res.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == brute(x, sorted(got), 5)


def test_blocked_broadcast_equals_single(spark, data):
    _, vecs, qs, cent = data
    one = V.exact_knn(vecs, qs, 5).collect()
    spark.conf.set(sizing.CAP_KEY, str(16 * 8 * 10))   # ~9 rows per block
    try:
        many = V.exact_knn(vecs, qs, 5).collect()
        probes_many = V.nearest(qs, cent, 3, base_id="qid", base_vec="embedding", ref_id="list_id",
                                ref_vec="centroid", out_base="qid", out_ref="list_id").collect()
    finally:
        spark.conf.unset(sizing.CAP_KEY)
    probes_one = V.nearest(qs, cent, 3, base_id="qid", base_vec="embedding", ref_id="list_id",
                           ref_vec="centroid", out_base="qid", out_ref="list_id").collect()
    key = lambda r: (r.qid, r["rank"])
    assert [(r.qid, r.vec_id) for r in sorted(one, key=key)] == [(r.qid, r.vec_id) for r in sorted(many, key=key)]
    assert sorted((r.qid, r.list_id, r["rank"]) for r in probes_one) == \
        sorted((r.qid, r.list_id, r["rank"]) for r in probes_many)


def test_all_probes_equals_exact_and_salting(spark, data):
    x, vecs, qs, cent = data
    asg = V.nearest(vecs, cent, 1, base_id="vec_id", base_vec="embedding", ref_id="list_id", ref_vec="centroid",
                    out_base="vec_id", out_ref="list_id").select("vec_id", "list_id")
    members = asg.join(vecs, "vec_id")
    probes = V.nearest(qs, cent, 12, base_id="qid", base_vec="embedding", ref_id="list_id", ref_vec="centroid",
                       out_base="qid", out_ref="list_id", out_rank="probe_rank")
    exact = sorted((r.qid, r["rank"], r.vec_id) for r in V.exact_knn(vecs, qs, 5).collect())
    full = sorted((r.qid, r["rank"], r.vec_id) for r in S.ivf_search(probes, qs, members, 5).collect())
    assert full == exact
    spark.conf.set(sizing.BLOCK_KEY, str(16 * 16 * 4))  # cells of ~4 vectors / queries
    try:
        salted = sorted((r.qid, r["rank"], r.vec_id) for r in S.ivf_search(probes, qs, members, 5).collect())
    finally:
        spark.conf.unset(sizing.BLOCK_KEY)
    assert salted == exact


def test_pq_encode_vs_numpy(spark, data):
    x, vecs, _, _ = data
    rng = np.random.default_rng(5)
    cb = rng.normal(size=(8, 16, 2))
    res = vecs.select("vec_id", F.lit(0).cast("bigint").alias("list_id"), F.col("embedding").alias("res"))
    got = {r.vec_id: list(r.code) for r in QZ.pq_encode(res, cb).collect()}
    for i in (0, 17, 299):
        sub = x[i].astype(np.float64).reshape(8, 1, 2)
        want = ((sub - cb) ** 2).sum(axis=2).argmin(axis=1)
        assert got[i] == list(want)


def test_kmeans_inertia_non_increasing(spark, data):
    _, vecs, _, cent = data
    inertia = []
    c = cent.select("list_id", F.transform("centroid", lambda v: v.cast("double")).alias("centroid"))
    for _ in range(3):
        asg, c = QZ.lloyd_step(vecs, c)
        inertia.append(asg.agg(F.sum("dist")).first()[0])
        c = c.checkpoint(eager=True)
    assert all(b <= a + 1e-9 for a, b in zip(inertia, inertia[1:]))


@pytest.mark.parametrize("cap", (None, "1"))
def test_a_list_without_members_keeps_its_centroid(spark, cap):
    """Of two equal centroids the smaller list takes all members; the other stays as it is."""
    vecs = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(6)], "vec_id bigint, embedding array<float>")
    cent = spark.createDataFrame([(0, [0.0, 3.0]), (1, [0.0, 3.0]), (2, [9.0, 9.0])], "list_id bigint, centroid array<float>")
    if cap:
        spark.conf.set("ragspark.broadcast.capBytes", cap)
    try:
        _, got = QZ.kmeans(vecs, cent, iters=3)
        rows = {r.list_id: (list(r.centroid), r.n_members) for r in got.collect()}
    finally:
        spark.conf.unset("ragspark.broadcast.capBytes")
    assert rows == {0: ([0.5, 1.0], 6), 1: ([0.0, 3.0], 0), 2: ([9.0, 9.0], 0)}


def test_ties_go_to_the_smaller_id_for_any_layout(spark):
    """200 equal vectors and a few others: the k best are the least ids."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [float(i), 0.0, 1.0]) for i in range(200, 210)]
    q = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [5.0, 5.0, 5.0])], "qid bigint, embedding array<float>")
    for parts in (1, 3, 7):
        d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts, "vec_id")
        got = V.exact_knn(d, q, 5).where("qid = 0").orderBy("rank").collect()
        assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
        near = V.nearest(q, d, 5, base_id="qid", base_vec="embedding", ref_id="vec_id", ref_vec="embedding",
                         out_base="qid", out_ref="vec_id").where("qid = 0").orderBy("rank").collect()
        assert [r.vec_id for r in near] == [0, 1, 2, 3, 4] and [r["rank"] for r in near] == [0, 1, 2, 3, 4]


def test_nearest_is_the_same_beyond_the_broadcast_cap(spark, data):
    _, vecs, _, cent = data
    args = dict(base_id="vec_id", base_vec="embedding", ref_id="list_id", ref_vec="centroid", out_base="vec_id", out_ref="list_id")
    want = sorted(map(tuple, V.nearest(vecs, cent, 2, **args).collect()))
    spark.conf.set("ragspark.broadcast.capBytes", "64")
    try:
        got = sorted(map(tuple, V.nearest(vecs, cent, 2, **args).collect()))
        new = {r.list_id: r.centroid for r in QZ.lloyd_update(vecs, cent).collect()}
    finally:
        spark.conf.unset("ragspark.broadcast.capBytes")
    assert got == want
    for r in QZ.lloyd_update(vecs, cent).collect():
        assert np.allclose(r.centroid, new[r.list_id])


def test_codebook_training_lowers_the_error(spark, data):
    x, vecs, _, _ = data
    res = vecs.select("vec_id", F.col("embedding").alias("res"))

    def error(words):
        book = np.zeros((8, 16, 2))
        for r in words.collect():
            book[r.m, r.code] = r.word
        sub = x.astype(np.float64).reshape(len(x), 8, 1, 2)
        return ((sub - book[None]) ** 2).sum(axis=3).min(axis=2).sum()
    errors = [error(QZ.pq_train(res, iters=i)) for i in (0, 1, 4)]
    assert errors[0] >= errors[1] >= errors[2] and errors[2] < errors[0]


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_exact_distances_of_many_pairs_take_bounded_memory():
    """400,000 chosen pairs of 64 dimensions (205 MB a side if gathered at once)."""
    rng = np.random.default_rng(3)
    x, r, ids = rng.normal(size=(20_000, 64)), rng.normal(size=(25, 64)), np.arange(25)
    got = []
    assert _peak_mb(lambda: got.append(vecmath.nearest_rows(x, r, ids, 20))) < 150
    rows, cols, dist = got[0]
    assert len(rows) == 400_000
    assert np.array_equal(dist[:2000], vecmath.exact_l2sq(x[rows[:2000]], r[cols[:2000]]))


def test_code_scan_of_a_short_list_takes_bounded_memory():
    """20,000 queries of a list with one member: 32 sub-spaces of 16 words each."""
    rng = np.random.default_rng(4)
    words = rng.normal(size=(32, 16, 2))
    q, code = rng.normal(size=(20_000, 64)), rng.integers(0, 16, (1, 32))
    as_list = lambda a: pa.array(list(a), pa.list_(pa.float64()))                     # noqa: E731
    qt = pa.table({"list_id": pa.array(np.zeros(20_000, np.int64)), "qid": pa.array(np.arange(20_000)), "qvec": as_list(q)})
    vt = pa.table({"vec_id": pa.array([7]), "payload": as_list(code.astype(float))})
    got = []
    kernel = S._scan_kernel(10, "pq", SimpleNamespace(value=words))
    assert _peak_mb(lambda: got.append(kernel(qt, vt))) < 200
    want = ((q.reshape(-1, 32, 2) - words[np.arange(32), code[0]]) ** 2).sum(axis=(1, 2))
    assert np.allclose(got[0].column("dist").to_numpy(), want)
