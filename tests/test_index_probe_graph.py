"""Clustered index, calibrated probes and the centroid graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions import sizing, vecmath
from ragspark.functions.stats import order_statistic
from ragspark.operators import graph as G
from ragspark.operators import index_table as IX
from ragspark.operators import probe as PR
from ragspark.operators import quantize as QZ
from ragspark.operators import search as S
from ragspark.operators import vector as V
from ragspark.plans import vector_plans as VP

SF = "/root/testdata/sf0.001"

NEAR = dict(base_id="qid", base_vec="embedding", ref_id="list_id", ref_vec="centroid", out_base="qid", out_ref="list_id")


@pytest.fixture(scope="module")
def data(spark):
    """Vectors around 12 centres, a third of them in one list."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(12, 8)) * 3
    pick = np.where(rng.random(600) < 0.33, 0, rng.integers(0, 12, 600))
    x = (centre[pick] + rng.normal(size=(600, 8))).astype(np.float32)
    vecs = spark.createDataFrame([(i, x[i].tolist()) for i in range(600)], "vec_id bigint, embedding array<float>")
    cent = spark.createDataFrame([(i, centre[i].astype(np.float32).tolist()) for i in range(12)], "list_id bigint, centroid array<float>")
    qs = vecs.where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return x, vecs, cent, qs


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_assignment_carries_vector_and_residual(spark, data):
    x, vecs, cent, _ = data
    want = {r.vec_id: (r.list_id, r.dist) for r in V.nearest(
        vecs, cent, 1, base_id="vec_id", base_vec="embedding", ref_id="list_id", ref_vec="centroid",
        out_base="vec_id", out_ref="list_id").collect()}
    c = {r.list_id: np.array(r.centroid, np.float32) for r in cent.collect()}
    one = {r.vec_id: r for r in V.assign_carrying(vecs, cent).collect()}
    spark.conf.set(sizing.CAP_KEY, "64")
    try:
        other = {r.vec_id: r for r in V.assign_carrying(vecs, cent).collect()}
    finally:
        spark.conf.unset(sizing.CAP_KEY)
    for got in (one, other):
        assert {i: (r.list_id, r.dist) for i, r in got.items()} == want
        for i in (0, 7, 599):
            assert np.array_equal(np.array(got[i].res, np.float32), x[i] - c[got[i].list_id])
            assert np.array_equal(np.array(got[i].embedding, np.float32), x[i])


def test_search_does_not_move_the_members(spark, data):
    """The member side of the cogroup is read from the buckets; rows equal the exact search."""
    _, vecs, cent, qs = data
    index = IX.build(V.assign_carrying(vecs, cent), "embedding", 8)
    probes = V.nearest(qs, cent, 12, **NEAR)
    cand = IX.scan(index, probes, qs, 5)
    plan = cand._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index(f"spark_catalog.default.{index.table}") - 400:]
    assert plan.count("Exchange") == plan[:plan.index(index.table)].count("Exchange") and "Bucketed: true" in plan, side
    want = _rows(V.exact_knn(vecs, qs, 5), "qid", "rank", "vec_id")
    assert _rows(V.merge_topk(cand.drop("list_id"), 5), "qid", "rank", "vec_id") == want
    index.drop()


def test_large_lists_and_hot_lists_give_the_same_rows(spark, data):
    """Lists of many cells, and lists with more probes than a block holds."""
    _, vecs, cent, qs = data
    assigned = V.assign_carrying(vecs, cent)
    probes = V.nearest(qs, cent, 3, **NEAR)
    want = _rows(S.ivf_search(probes, qs, assigned.select("vec_id", "list_id", "embedding"), 5), "qid", "rank", "vec_id")
    spark.conf.set(sizing.BLOCK_KEY, str(8 * 16 * 40))      # 40 vectors a cell, 40 queries a block
    try:
        index = IX.build(assigned, "embedding", 8)
        assert index.salts >= 5
        got = _rows(V.merge_topk(IX.scan(index, probes, qs, 5).drop("list_id"), 5), "qid", "rank", "vec_id")
    finally:
        spark.conf.unset(sizing.BLOCK_KEY)
    assert got == want


def test_queries_of_many_lists_go_to_blocks_of_lists(spark, data, monkeypatch):
    """The same rows as lists scanned one by one, with repeated queries, vectors and probes, lists of
    many cells, probed lists without members; candidates follow the cells, not the probes."""
    _, vecs, cent, qs = data
    more = vecs.unionByName(vecs.where("vec_id % 5 = 0"))
    qs = qs.unionByName(qs.where("qid % 9 = 0"))
    probes = V.nearest(qs, cent, 10, **NEAR).where("(qid + list_id) % 7 > 0").select("qid", "list_id")
    probes = probes.unionByName(spark.createDataFrame([(0, 77), (3, 77), (9999, 1)], "qid bigint, list_id bigint"))
    members = V.assign_carrying(more, cent)

    def scan():
        index = IX.build(members, "embedding", 8)
        cand = IX.scan(index, probes, qs, 5)
        rows = (cand.count(), sorted(map(tuple, cand.where("list_id < 0 or list_id > 11").collect())), index.salts,
                _rows(V.merge_topk(cand.drop("list_id"), 5), "qid", "rank", "vec_id", "dist"))
        home = {(r.vec_id, r.list_id) for r in members.select("vec_id", "list_id").collect()}
        assert {(r.vec_id, r.list_id) for r in cand.select("vec_id", "list_id").distinct().collect()} <= home
        index.drop()
        return rows
    n, strange, salts, want = scan()
    assert salts == 1 and not strange
    monkeypatch.setattr(IX, "MANY", 2)
    for vectors in (400, 40):                    # of a block: lists of one cell, of several
        spark.conf.set(sizing.BLOCK_KEY, str(8 * 16 * vectors))
        try:
            blocks, strange, salts, got = scan()
        finally:
            spark.conf.unset(sizing.BLOCK_KEY)
        assert got == want and not strange and (salts > 1) == (vectors == 40)
        if vectors == 400:
            assert blocks < 0.8 * n


def test_best_rows_of_several_sets_equal_those_of_one():
    rng = np.random.default_rng(4)
    x, q = rng.integers(0, 3, (400, 4)).astype(float), rng.integers(0, 3, (30, 4)).astype(float)     # many ties
    ids = rng.permutation(400)
    want = vecmath.nearest_rows(q, x, ids, 7)
    for held in (1, 100, 10_000):
        best = vecmath.Best(q, 7, held)
        for s in range(0, 400, 3 if held == 1 else 90):
            best.add(np.arange(30), x[s:s + (3 if held == 1 else 90)], ids[s:s + (3 if held == 1 else 90)], s)
        got = best.rows()
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert len(vecmath.Best(q, 7).rows()[0]) == 0


def test_clustered_codes_score_as_numpy(spark, data):
    x, vecs, cent, qs = data
    res = V.assign_carrying(vecs, cent)
    book = QZ.train_codebook(res, 2, 16, iters=3)
    index = IX.build(QZ.pq_encode(res, book), "code", 8)
    probes = V.nearest(qs, cent, 2, **NEAR)
    got = {(r.qid, r.vec_id): r.dist for r in IX.scan(index, probes, qs, 600, mode="pq", centroids=cent, codebook=book).collect()}
    lists = {r.vec_id: r.list_id for r in res.collect()}
    c = {r.list_id: np.array(r.centroid, np.float32) for r in cent.collect()}
    asked = {(r.qid, r.list_id) for r in probes.collect()}
    for (q, v), d in list(got.items())[::97]:
        assert (q, lists[v]) in asked
        r = (x[v] - c[lists[v]]).astype(np.float64).reshape(4, 2)
        word = np.array([book[m, ((r[m] - book[m]) ** 2).sum(axis=1).argmin()] for m in range(4)])
        assert abs(((x[q] - c[lists[v]]).astype(np.float64).reshape(4, 2) - word).__pow__(2).sum() - d) < 1e-9
    assert len(got) == sum(1 for q, y in asked for v in lists if lists[v] == y)


def test_lists_within_a_radius(spark, data):
    x, _, cent, qs = data
    q = qs.withColumn("r", F.when(F.col("qid") % 2 == 0, 4.0).otherwise(9.0))
    args = dict(base_id="qid", base_vec="embedding", radius="r", ref_id="list_id", ref_vec="centroid")
    c = np.array([r.centroid for r in cent.orderBy("list_id").collect()])
    want = sorted((i, j) for i in range(0, 600, 3) for j in range(12)
                  if np.linalg.norm(x[i].astype(np.float64) - c[j]) <= (4.0 if i % 2 == 0 else 9.0))
    one = _rows(V.within(q, cent, **args), "qid", "list_id")
    spark.conf.set(sizing.CAP_KEY, "64")
    try:
        blocks = _rows(V.within(q, cent, **args), "qid", "list_id")
    finally:
        spark.conf.unset(sizing.CAP_KEY)
    assert one == blocks == want


def test_order_statistic_is_the_least_value_of_the_share(spark):
    d = spark.createDataFrame([(g, float(v)) for g in (None, 1, 2) for v in range(10 if g != 2 else 1)] + [(1, None)], "g int, v double")
    got = {r.g: (r.x, r.n) for r in order_statistic(d, ["g"], "v", 0.75, "x").collect()}
    assert got == {None: (7.0, 10), 1: (7.0, 10), 2: (0.0, 1)}


def test_calibrated_reach_finds_the_target_share(spark, data):
    _, vecs, cent, qs = data
    asg = V.assign_carrying(vecs, cent).select("vec_id", "list_id")
    truth = V.exact_knn(vecs, qs, 5).select("qid", "vec_id")
    near = PR.two_nearest(qs, cent)
    members = IX.build(V.assign_carrying(vecs, cent), "embedding", 8)
    sizes = []
    for target in (0.8, 0.95, 1.0):
        reach = PR.calibrate(truth, asg, qs, cent, near, target)
        probes = PR.probe(qs, cent, near, reach)
        got = PR.recall(V.merge_topk(IX.scan(members, probes, qs, 5).drop("list_id"), 5), truth)
        assert got.agg(F.sum("n_found") / F.sum("n_true")).first()[0] >= target - 1e-12
        sizes.append(probes.count())
    assert sizes == sorted(sizes) and sizes[0] < 12 * qs.count()
    # a class that the calibration never saw takes the widest reach
    one = PR.calibrate(truth.limit(0), asg, qs, cent, near, 0.9)
    assert PR.probe(qs, cent, near, one).groupBy("qid").count().agg(F.min("count")).first()[0] == 1


def test_registered_policy_reaches_the_recall(spark):
    got = VP.vec_probe_policy(spark, SF)
    r = {x["calibrated"]: x["r"] for x in got.groupBy("calibrated").agg(F.avg("recall").alias("r")).collect()}
    assert r[True] >= 0.95 - 1e-9 and r[False] >= 0.9
    rec = {x["search"]: x["recall"] for x in VP.vec_recall(spark, SF).collect()}
    assert rec["flat_policy"] >= 0.9 and rec["flat_policy"] > rec["flat_fixed"] >= rec["pq_fixed"]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(13)
    c = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 16))).astype(np.float32)
    cent = spark.createDataFrame([(i * 3, c[i].tolist()) for i in range(3000)], "list_id bigint, centroid array<float>")
    q = (c[rng.integers(0, 3000, 200)] + rng.normal(size=(200, 16)) * 0.5).astype(np.float32)
    qs = spark.createDataFrame([(i, q[i].tolist()) for i in range(200)], "qid bigint, embedding array<float>")
    return cent, qs


def test_graph_probes_hold_the_exact_lists(spark, many):
    cent, qs = many
    links = G.build(cent)
    assert links.agg(F.max("layer")).first()[0] >= 2
    assert links.where("peer is not null").groupBy("layer", "node").count().agg(F.max("count")).first()[0] <= 2 * G.DEGREE
    exact = {(r.qid, r.list_id) for r in V.nearest(qs, cent, 20, **NEAR).collect()}
    shares = []
    for width in (1.1, 1.5):
        got = G.probe(qs, cent, links, 20, width).collect()
        by = {}
        for r in got:
            by.setdefault(r.qid, []).append(r)
        for rs in by.values():
            rs.sort(key=lambda r: r.probe_rank)
            assert [r.probe_rank for r in rs] == list(range(20)) and len({r.list_id for r in rs}) == 20
            assert all(a.cdist <= b.cdist for a, b in zip(rs, rs[1:]))
        shares.append(len({(r.qid, r.list_id) for r in got} & exact) / len(exact))
    assert shares[0] >= 0.9 and shares[1] >= shares[0]


def test_graph_beyond_the_cap_is_exact_and_small_graphs_work(spark, many):
    cent, qs = many
    links = G.build(cent.limit(50))
    spark.conf.set(sizing.CAP_KEY, "64")
    try:
        got = _rows(G.probe(qs, cent.limit(50), links, 5), "qid", "probe_rank", "list_id")
    finally:
        spark.conf.unset(sizing.CAP_KEY)
    assert got == _rows(V.nearest(qs, cent.limit(50), 5, out_rank="probe_rank", **NEAR), "qid", "probe_rank", "list_id")
    for n in (1, 2):
        few = cent.orderBy("list_id").limit(n)
        assert G.probe(qs, few, G.build(few), 5).count() == n * 200
    none = cent.limit(0)
    assert G.build(none).count() == 0 and G.probe(qs, none, G.build(none), 5).count() == 0


def test_registered_graph_probes(spark):
    got = VP.vec_graph_probe(spark, SF)
    assert got.agg(F.avg(F.col("exact").cast("int"))).first()[0] >= 0.9
