"""Text and sampling operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from ragspark.operators import sampling as smp
from ragspark.operators import text as tx


def test_sentences_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world. How are you?\nFine!  ok"), (2, "   ")], "doc_id bigint, text string")
    s = tx.split_sentences(docs).orderBy("doc_id", "pos").collect()
    assert [r.sentence for r in s] == ["Hello world.", "How are you?", "Fine!", "ok"]
    t = docs.select(tx.token_count("text").alias("n")).orderBy("n").collect()
    assert [r.n for r in t] == [0, 7]


def test_embed_normalised(spark):
    ch = spark.createDataFrame([(0, "a b c a"), (1, "")], "chunk_id bigint, text string")
    e = {r.chunk_id: r.embedding for r in tx.embed(ch, dim=8).collect()}
    assert sum(x * x for x in e[0]) == pytest.approx(1.0, abs=1e-6)
    assert sum(e[1]) == 0


def test_split_sizes_exact(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "qid")
    out = smp.split(df, "qid", 0.2)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 800, "train": 200}
    assert out.select("perm_rank").distinct().count() == 1000


def test_parse_kv(spark):
    lines = spark.createDataFrame([("rate=16",), ("util=0.95",), ("flag=True",), ("tag=main",), ("l=[1, 2]",), ("on=false",)], "line string")
    got = {r.k: (r.v_long, r.v_double, r.v_bool, r.v_str) for r in tx.parse_kv(lines).collect()}
    lists = {r.k: r.v_list for r in tx.parse_kv(lines).collect()}
    assert got["rate"] == (16, 16.0, None, None)
    assert got["util"] == (None, 0.95, None, None)
    assert got["flag"] == (None, None, True, None)
    assert got["tag"] == (None, None, None, "main") and got["l"] == (None, None, None, None)
    assert lists["l"] == [1.0, 2.0] and lists["tag"] is None and got["on"] == (None, None, False, None)


def test_run_name(spark):
    df = spark.createDataFrame([(150, 1024, 256, 10.0, 8, True), (0, 512, 128, 10.6667, 6, False)],
                               "s int, i int, o int, r double, n int, d boolean")
    name = tx.run_name(F.col("s"), F.col("i"), F.col("o"), F.col("r"), F.col("n"), F.lit(0.95), F.lit(2048), F.col("d"))
    got = [r.x for r in df.select(name.alias("x")).collect()]
    assert got == ["S150_I1024_O256_R10_N8_U95_P2048", "S0_I512_O128_R10.67_N6_U95_P2048_Dx"]
