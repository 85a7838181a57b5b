"""Hand-worked micro-cases (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from ragspark.operators import capacity as cp
from ragspark.operators import hitrate as hr
from ragspark.operators import latency as lt
from ragspark.operators import placement as pl
from ragspark.operators import reports as rp
from ragspark.operators import routing as rt
from ragspark.operators import tail as tl
from ragspark.operators import telemetry as tel
from ragspark.operators import text as tx
from ragspark.operators.vector import merge_topk
from ragspark.sources import tables as tb


def probes_df(spark, rows):
    return spark.createDataFrame([(q, r, l) for q, ls in enumerate(rows) for r, l in enumerate(ls)],
                                 "qid bigint, probe_rank bigint, list_id bigint")


def cents(spark, n):
    return spark.range(n).select(F.col("id").alias("list_id"))


def test_g1_access_skew(spark):
    probes = probes_df(spark, [[0, 1], [0, 2], [0, 1], [3, 1]])
    freq = hr.frequency(probes, cents(spark, 5))
    assert {r.list_id: r.freq for r in freq.collect()} == {0: 3, 1: 3, 2: 1, 3: 1, 4: 0}
    cdf = hr.cdf(freq, 2 * 4).orderBy("hot_rank").collect()
    assert [r.list_id for r in cdf] == [0, 1, 2, 3, 4]
    assert [r.cdf for r in cdf] == pytest.approx([0.375, 0.75, 0.875, 1.0, 1.0])
    hot = hr.half_set(hr.cdf(freq, 8))
    assert [r.list_id for r in hot.collect()] == [0]
    hits = hr.per_query(probes, hot, 2)
    assert sorted(r.hit_rate for r in hits.collect()) == [0.0, 0.5, 0.5, 0.5]
    m = hr.moments(hits).first()
    assert m["mean"] == pytest.approx(0.375) and m["var"] == pytest.approx(0.046875)
    b = hr.beta_params(spark.createDataFrame([(0.375,)], "m double"), m["var"]).first()
    assert b["c"] == pytest.approx(4.333333, abs=1e-6)
    pref = hr.prefix_for_targets(hr.cdf(freq, 8), [0.3, 0.6, 0.75, 0.9])
    assert [r.prefix_len for r in pref.orderBy("target").collect()] == [1, 2, 2, 4]


def g2(spark):
    sizes = spark.createDataFrame([(7, 10), (3, 4), (9, 25), (1, 4), (4, 12)], "list_id bigint, n bigint")
    return pl.place(sizes.select("list_id"), sizes, 2)


def test_g2_placement(spark):
    p = g2(spark)
    got = sorted((r.list_id, r.shard, r.local_id) for r in p.collect())
    assert got == sorted([(1, 0, 0), (3, 1, 0), (7, 0, 1), (4, 1, 1), (9, 0, 2)])
    per = {r.shard: r.n_vectors for r in pl.shard_summary(p).collect()}
    assert per == {0: 39, 1: 16}
    lut = {r.list_id: (r.shard, r.local_id) for r in pl.full_lut(cents(spark, 10), p, 10).collect()}
    assert lut[0] == (-1, 0) and lut[9] == (0, 2)


def test_g3_routing(spark):
    lut = pl.full_lut(cents(spark, 10), g2(spark), 10)
    probes = probes_df(spark, [[1, 7, 0], [3, 2, 5]])
    routed = rt.route(probes, lut, 10)
    got = sorted((r.qid, r.shard, r.pos, r.local_id) for r in routed.collect())
    assert got == sorted([(0, 0, 0, 0), (0, 0, 1, 1), (0, -1, 0, 0), (1, 1, 0, 0), (1, -1, 0, 2), (1, -1, 1, 5)])
    w = {r.shard: r.width for r in rt.widths(routed, [0, 1, -1]).collect()}
    assert w == {0: 2, 1: 1, -1: 2}
    qs = spark.createDataFrame([(0,), (1,)], "qid bigint")
    pad = {(r.qid, r.shard): list(r.padded) for r in rt.padded(routed, qs, [0, 1, -1]).collect()}
    assert pad[(0, 0)] == [0, 1] and pad[(1, 0)] == [-1, -1]
    assert pad[(0, 1)] == [-1] and pad[(1, 1)] == [0]
    assert pad[(0, -1)] == [0, -1] and pad[(1, -1)] == [2, 5]
    m = {r.qid: (r.misses, r.hit_rate) for r in rt.misses(routed, 3).collect()}
    assert m[0][0] == 1 and m[1][0] == 2
    assert m[0][1] == pytest.approx(2 / 3) and m[1][1] == pytest.approx(1 / 3)
    assert rt.hot_only(routed).count() == 0


def test_g4_stages(spark):
    row = [(0, 10.0, 10.2, 10.3, 10.7, 10.75, 10.95, 13.51, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 256)]
    df = spark.createDataFrame(row, "rid bigint, arrival double, last_arrival double, start double, callback double, "
                                    "submit double, first_token double, done double, breakdown array<double>, "
                                    "output_len int")
    r = tel.stages(df, "output_len").first()
    expect = dict(ann_batch=0.2, ann_pending=0.1, ann_queue=0.3, ann_search=0.4, llm_queue=0.05, prefill=0.2,
                  tpot=0.01, ttft=0.95, e2e=3.51, ann_e2e=0.7, quantize=1, lut_compute=5, lut_scan=15)
    for k, v in expect.items():
        assert r[k] == pytest.approx(v, abs=1e-9), k


def test_g5_summary(spark):
    df = spark.createDataFrame([(1, v, None) for v in (0.1, 0.2, 0.3, 0.4, 0.5)], "run int, a double, b double")
    out = {r.metric: r for r in tel.summarize(df, ["run"], ["a", "b"]).collect()}
    a = out["a"]
    assert (a.avg, a.p50, a.p90, a.p95) == pytest.approx((0.3, 0.3, 0.46, 0.48))
    b = out["b"]
    assert (b.avg, b.p50, b.p90, b.p95) == (0.0, 0.0, 0.0, 0.0)


def test_g6_tail_closed_form(spark):
    cases = [(0.5, 4, 1 / 3), (2.0, 16, 1 / 33), (7.0, 1, 0.125)]
    rows = [(i, 1 / (1 + b), 1 + b) for i, (b, _, _) in enumerate(cases)]
    means = spark.createDataFrame(rows, "case int, m double, c double")
    t = {(r.case, r.n): r.tail for r in tl.tail(means, [1, 4, 16]).collect()}
    for i, (_, n, want) in enumerate(cases):
        assert t[(i, n)] == pytest.approx(want, abs=2e-5)
    for i, (b, _, _) in enumerate(cases):       # n = 1 returns the mean
        assert t[(i, 1)] == pytest.approx(1 / (1 + b), abs=2e-5)
    edge = spark.createDataFrame([(0, 0.0, 3.0), (1, 1.0, 3.0)], "case int, m double, c double")
    e = {(r.case, r.n): r.tail for r in tl.tail(edge, [1, 8]).collect()}
    assert e[(0, 8)] == 0.0 and e[(1, 8)] == 1.0


def test_g6_tail_decreasing_and_empirical(spark):
    means = spark.createDataFrame([(0.6, 4.0)], "m double, c double")
    ts = [r.tail for r in tl.tail(means, [1, 2, 4, 8, 16, 32]).orderBy("n").collect()]
    assert all(a > b for a, b in zip(ts, ts[1:]))
    hits = spark.createDataFrame([(0.2,), (0.5,), (0.9,)], "hit_rate double")
    emp = {r.n: r.tail for r in tl.tail_empirical(hits, [1, 2]).collect()}
    assert emp[2] == pytest.approx(0.377778, abs=1e-6)
    assert emp[1] == pytest.approx((0.2 + 0.5 + 0.9) / 3)


def test_g7_memory(spark):
    row = [(1.0, 1.0, 262144, 87555327, 768, 384, 2, 16, 8, 8)]
    df = spark.createDataFrame(row, "p double, share double, nlist_cat int, ntotal_cat bigint, d int, m_sub int, "
                                    "msub int, ksub int, ngpu int, n_ded int")
    r = cp.memory(df).first()
    assert r.mem_centroids == pytest.approx(0.75, abs=1e-4)
    assert r.mem_codes == pytest.approx(15.6561, abs=1e-4)
    assert r.mem_ids == pytest.approx(0.3262, abs=1e-4)
    assert r.mem_whole == pytest.approx(18.7323, abs=1e-4)
    assert r.mem_split == pytest.approx(4.0916, abs=1e-4)


def test_g8_ladder(spark):
    df = spark.createDataFrame([(41.23,), (6.97,)], "ceiling double").select("ceiling", cp.ladder(F.col("ceiling")).alias("l"))
    got = {r.ceiling: list(r.l) for r in df.collect()}
    assert got[41.23] == [21, 26, 31, 33, 35, 36, 37, 39, 40, 41, 43]
    assert got[6.97][0] == pytest.approx(3.485) and got[6.97][-1] == pytest.approx(7.1878, abs=1e-4)


def test_g9_piecewise(spark):
    lat = spark.createDataFrame([(x, 2 + 0.5 * x, 0.0, 0.0, 0.0) for x in range(1, 33)],
                                "batch_size int, ann_search double, quantize double, lut_compute double, lut_scan double")
    brks = lt.breaks(lat)
    assert brks == pytest.approx([1, 2, 8.75, 16.5, 24.25, 32])
    segs = lt.piecewise(lat, brks).where(F.col("component") == "search").collect()
    assert len(segs) == 5
    for s in segs:
        assert s.slope == pytest.approx(0.5, abs=1e-6) and s.intercept == pytest.approx(2.0, abs=1e-5)


def test_g10_topk_merge(spark):
    a = spark.createDataFrame([(0, 0.3, 5), (0, 0.7, 1)], "qid bigint, dist double, vec_id bigint")
    b = spark.createDataFrame([(0, 0.3, 2), (0, math.inf, -1)], "qid bigint, dist double, vec_id bigint")
    out = merge_topk(a.unionByName(b), 2).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [2, 5] and [r.dist for r in out] == [0.3, 0.3]


def test_g11_chunks(spark):
    docs = spark.createDataFrame([(0, "One two three four. Too short. A b c d e!")], "doc_id bigint, text string")
    ch = tx.chunk(docs).orderBy("chunk_id").collect()
    assert [r.text for r in ch] == ["One two three four.", "A b c d e!"]
    assert [r.chunk_key for r in ch] == ["000000000000", "000000000001"]


def test_g12_slo_share(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.5), (1, None), (1, 0.2)], "run int, ttft double")
    r = rp.slo_attainment(df, ["run"], "ttft", 0.3).first()
    assert r.attainment == pytest.approx(0.5)


def test_g13_upsert(spark):
    base = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "db string, slo int, mem int")
    upd = spark.createDataFrame([("b", 1, 25), ("c", 1, 5)], "db string, slo int, mem int")
    got = sorted(tuple(r) for r in tb.upsert(base, upd, ["db", "slo"]).collect())
    assert got == [("a", 1, 10), ("b", 1, 25), ("c", 1, 5)]


def test_summary_approx_option(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1001)], "run int, a double")
    ex = tel.summarize(df, ["run"], ["a"]).first()
    ap = tel.summarize(df, ["run"], ["a"], approx=True).first()
    assert ex.p90 == pytest.approx(900.0) and abs(ap.p90 - 900.0) <= 1.0 and ap.exact is False
