"""Interval lookups, k least hashes, chunk numbers and model embeddings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import capacity as cp
from ragspark.operators import sampling as smp
from ragspark.operators import text as tx
from ragspark.operators.asof import interval_join
from ragspark.plans import text_plans as TP


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.choice("ab"), float(rnd.choice([rnd.randint(-50, 50), rnd.uniform(-50, 50), 1e6]))) for i in range(300)]
    pts += [(300, None, 3.0), (301, "a", None)]
    ivs = [(i, rnd.choice("ab"), *sorted((float(rnd.randint(-60, 60)), float(rnd.randint(-60, 60))))) for i in range(40)]
    ivs += [(40, "a", -1e7, 1e7), (41, "b", 3.0, 3.0), (42, None, 2.5, 3.5), (43, "a", None, 5.0), (44, "a", 1e-9, 2e-9), (45, "a", 9.0, 8.0)]
    return (pts, ivs, spark.createDataFrame(pts, "id int, g string, x double"),
            spark.createDataFrame(ivs, "iv int, g string, lo double, hi double"))


@pytest.mark.parametrize("closed", ["both", "left", "right"])
def test_interval_join_equals_comparing_all(sides, closed):
    pts, ivs, p, v = sides
    inside = {"both": lambda x, a, b: a <= x <= b, "left": lambda x, a, b: a <= x < b, "right": lambda x, a, b: a < x <= b}[closed]
    want = sorted((i, j) for i, g, x in pts for j, h, a, b in ivs
                  if x is not None and a is not None and a <= b and g == h and inside(x, a, b))
    out = interval_join(p, v, "x", "lo", "hi", keys=["g"], closed=closed)
    assert sorted((r.id, r.iv) for r in out.collect()) == want and len(want) > 500
    assert out.columns == ["id", "g", "x", "iv", "lo", "hi"]


def test_interval_join_is_no_nested_loop(sides, spark):
    _, _, p, v = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = interval_join(p, v, "x", "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    assert interval_join(p, v.limit(0), "x", "lo", "hi").count() == 0


def test_needs_look_up_the_first_mean_that_reaches_them(spark):
    rnd = random.Random(5)
    tab = [(n, m / 100, m / 100 / n if rnd.random() < 0.8 else 0.01) for n in (1, 4) for m in range(101)]
    needs = [(i, rnd.choice([1, 4]), x) for i, x in enumerate([-0.5, 0.0, 1.0, 1.5, 0.25, 0.01] + [rnd.random() for _ in range(200)])]
    got = {r.i: r.mean for r in cp.lookup_mean(
        spark.createDataFrame(needs, "i int, n int, need double"), spark.createDataFrame(tab, "n int, m double, tail double"),
        "need", "mean", ["i"]).collect()}
    for i, n, x in needs:
        want = x if x <= 0 or x >= 1 else min([m for k, m, t in tab if k == n and t >= x], default=1.0)
        assert got[i] == want


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 5000])
def test_least_rows_equal_the_full_ranking(spark, k):
    d = spark.createDataFrame([(i if i % 50 else None,) for i in range(1000)], "i bigint").repartition(3)
    want = sorted((r.perm_rank, r.i) for r in smp.permute(d, "i").where(F.col("perm_rank") < k).collect())
    got = smp.permute(smp.least(d, "i", k), "i")
    assert sorted(((r.perm_rank, r.i) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_least_rows_need_no_range_shuffle(spark, monkeypatch):
    d = spark.range(2000).select(F.col("id").alias("i"))
    monkeypatch.setattr(smp, "BUCKETS", 16)             # many rounds of the histogram
    out = smp.least(d, "i", 321)
    assert out.count() == 321
    repeated = d.limit(1).crossJoin(spark.range(300)).select("i")
    assert smp.least(repeated, "i", 123).count() == 123  # one hash for all rows


def test_chunk_numbers_follow_documents_and_positions(spark):
    texts = {5: "One two three four. Too short. Here are more words again!", 3: "Only one long sentence without an end",
             9: "", 7: None, 1: "A b c d. " * 40}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in tx.chunk(d).orderBy("chunk_id").select("chunk_id", "doc_id", "pos", "text", "tokens").collect()]
    flat = [(k, s.pos, s.sentence, s.tokens) for k in sorted(texts) for s in tx.min_tokens(
        tx.split_sentences(d.where(F.col("doc_id") == k))).orderBy("pos").collect()]
    assert got == [(i, *row) for i, row in enumerate(flat)] and len(got) == 43
    # repeated and null keys: still dense, nothing lost
    twice = d.unionByName(d).unionByName(spark.createDataFrame([(None, "no key but four words.")], d.schema))
    ids = [r.chunk_id for r in tx.chunk(twice).collect()]
    assert sorted(ids) == list(range(2 * 43 + 1))
    assert tx.chunk(d.limit(0)).count() == 0


def test_a_model_is_loaded_by_the_workers_and_keeps_the_order(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", ""]) for _ in range(rnd.randint(0, 9)))) for i in range(400)]
    d = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(5)
    predict = TP._projection_model()
    want = dict(zip([r[0] for r in rows], predict(np.array([r[1] for r in rows], dtype=object))))
    for batch in (1, 7, 128):
        got = tx.embed(d, make_predict_fn=TP._projection_model, batch_size=batch, element="double").collect()
        assert len(got) == 400
        for r in got:
            assert np.array_equal(np.array(r.embedding), want[r.chunk_id])

    def sized():
        def run(texts):
            return np.full((len(texts), 1), float(len(texts)))
        return run
    sizes = {r.embedding[0] for r in tx.embed(d, make_predict_fn=sized, batch_size=16).collect()}
    assert max(sizes) <= 16.0


def test_hashed_counts_hash_a_token_once(spark):
    """Equal to hashing word by word; the plan has no hash inside a loop over the buckets."""
    texts = ["a b  a\tc", "", None, "x " * 5000, "é ü é", " lead and trail\n"] + [f"w{i} w{i % 7} end" for i in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    out = d.select("id", tx.hashed_counts("text", 16).alias("c"))
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.c for r in out.collect()}
    for i, t in enumerate(texts):
        want = [0] * 16
        for w in (t or "").split():
            want[int(hashlib.md5(f"42:{w}".encode()).hexdigest()[:8], 16) % 16] += 1
        assert got[i] == ([None] * 16 if t is None else want)


def test_wanted_chunks_are_cut_alone(spark, monkeypatch):
    """Chunks asked for by number equal those of the whole numbering; no sentence is stored for it."""
    rows = [(d * 3 % 50, " ".join(f"Word{i} of document {d} stands here." for i in range(d * d * 40 % 90 + (1500 if d == 4 else 0))))
            for d in range(50) if d != 7] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    every = {r.chunk_id: tuple(r) for r in tx.chunk(docs).collect()}
    n, stored, keep = len(every), [], tx.snapshot
    ids = [0, 1, n // 3, n // 3, n // 2, n - 1, n, n + 5000, -4, None]
    monkeypatch.setattr(tx, "snapshot", lambda df, name: stored.append(dict(df.dtypes)) or keep(df, name))
    wanted = spark.createDataFrame([(i,) for i in ids], "chunk_id bigint")
    got = tx.chunk(docs, ids=wanted).collect()
    assert sorted(map(tuple, got)) == sorted(every[i] for i in {i for i in ids if i is not None and 0 <= i < n})
    assert n > 2500 and stored and not any(t.startswith(("array", "string")) for s in stored for t in s.values())
    again = docs.unionByName(docs.where("doc_id = 3"))                       # a repeated key: sentences are ranked
    assert {r.chunk_id for r in tx.chunk(again, ids=wanted).collect()} == {0, 1, n // 3, n // 2, n - 1, n} - {
        i for i in (n,) if i >= tx.chunk(again).count()}
